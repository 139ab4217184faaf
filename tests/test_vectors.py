import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lexiloom.operators import encode, levels, neighbours, reduction, scaling


def frame(spark, x):
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, a array<double>")
    return df.withColumn("v", array_to_vector("a")).repartition(4)


def matrix(df, column):
    return np.array([r[1] for r in df.select("id", vector_to_array(column)).orderBy("id").collect()])


def test_column_scaler(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    scaler = scaling.fit_column_scaler(train, ["x", "y"])
    assert sorted(map(tuple, scaler.transform(train).collect())) == [(-1.0, 0.0), (1.0, 0.0)]
    other = spark.createDataFrame([(5.0, 7.0)], "x double, y double")
    assert tuple(scaler.transform(other).first()) == (3.0, 2.0)


def test_vector_scaler(spark):
    x = np.random.default_rng(1).normal(3, [1, 5, 0, 2], (200, 4))
    df = frame(spark, x)
    got = matrix(PipelineModel(scaling.fit_vector_scaler(df, "v", "z")).transform(df), "z")
    std = x.std(axis=0)
    np.testing.assert_allclose(got, (x - x.mean(axis=0)) / np.where(std > 0, std, 1), atol=1e-10)


def test_one_hot(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "s string")
    known = levels.fit_levels(train, "s")
    assert {r.s: r.position for r in known.collect()} == {"a": 0, "b": 1, None: 2}
    other = spark.createDataFrame([("a",), ("new",), (None,)], "s string")
    got = levels.level_positions(other, known, "s").withColumn("o", levels.slots("position", 3))
    assert {r.s: (r.position, r.o) for r in got.collect()} == {"a": (0, [1, 0, 0]), "new": (None, [0, 0, 0]), None: (2, [0, 0, 1])}


def test_many_levels(spark):
    df = spark.range(20_000, numPartitions=7).selectExpr("format_string('%06d', (id * 7919) % 10007) as s")
    known = levels.fit_levels(df, "s")
    assert [(r.s, r.position) for r in known.orderBy("s").collect()] == [(f"{i:06d}", i) for i in range(10_007)]
    assert levels.fit_levels(df.where("false"), "s").count() == 0


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    df = frame(spark, x)
    got = matrix(PipelineModel(reduction.fit_pca(df, "v", "p", 3)).transform(df), "p")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    axes = np.linalg.svd(z, full_matrices=False)[2][:3]
    axes *= np.sign(axes[np.arange(3), np.abs(axes).argmax(axis=1)])[:, None]
    np.testing.assert_allclose(got, z @ axes.T, atol=1e-8)
    smaller = matrix(PipelineModel(reduction.fit_pca(df, "v", "p", 2)).transform(df), "p")
    np.testing.assert_allclose(smaller, got[:, :2], atol=1e-8)
    np.testing.assert_allclose(reduction.correlation_matrix(df, "v"), np.corrcoef(x.T), atol=1e-10)


def brute_force(x, k):
    n = np.linalg.norm(x, axis=1)
    unit = np.hstack([x / np.where(n > 0, n, 1)[:, None], (n == 0)[:, None]])
    d = np.rint((1 - unit @ unit.T) * 1e12).astype(np.int64)
    np.fill_diagonal(d, np.iinfo(np.int64).max)
    return [sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k] for i in range(len(x))]


def neighbour_ids(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["neighbour"])
    return [out[i] for i in sorted(out)]


@pytest.mark.parametrize("rows_per_pivot,block_rows", [(10_000, 4096), (10_000, 40), (12, 16)])
def test_neighbours_match_brute_force(spark, rows_per_pivot, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, 240)] + rng.normal(scale=0.1, size=(240, 8))
    got = neighbours.knn_cosine(frame(spark, x), "id", "a", 5, rows_per_pivot, block_rows)
    assert neighbour_ids(got) == brute_force(x, 5)


@pytest.mark.parametrize("rows_per_pivot,block_rows", [(10_000, 4096), (12, 16)])
def test_neighbours_with_a_third_of_copies(spark, rows_per_pivot, block_rows):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(180, 5))
    x[::3] = x[0]
    x[[7, 20, 31]] = x[5]
    x[[2, 50]] = 0
    got = neighbours.knn_cosine(frame(spark, x), "id", "a", 4, rows_per_pivot, block_rows)
    # scaled copies are equal up to rounding; brute force rounds the same way
    assert neighbour_ids(got) == brute_force(x, 4)


def test_cells_leave_out_what_cannot_match(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 16))
    x = centres[rng.integers(0, 10, 400)] + rng.normal(scale=0.02, size=(400, 16))
    rows = frame(spark, x).select("id", F.col("a").alias("v"))
    cells = neighbours._fit_cells(rows, 5, 20, 64)
    visits = cells.visits(neighbours._units(x), 5)
    assert visits.mean() < 0.5


def test_fewer_rows_than_neighbours(spark):
    got = neighbours.knn_cosine(frame(spark, [[1, 0], [0, 1], [1, 1]]), "id", "a", 15)
    assert neighbour_ids(got) == [[2, 1], [2, 0], [0, 1]]


def test_fuzzy_weights_sum_to_log2_k(spark):
    x = np.random.default_rng(6).normal(size=(60, 4))
    near = neighbours.knn_cosine(frame(spark, x), "id", "a", 8)
    weights = neighbours.fuzzy_weights(near, "id")
    sums = [r.s for r in weights.groupBy("id").agg(F.sum("weight").alias("s")).collect()]
    np.testing.assert_allclose(sums, 3.0, atol=1e-6)
    w = {(r.id, r.neighbour): r.weight for r in weights.collect()}
    for r in neighbours.fuzzy_union(weights, "id").collect():
        a, b = w.get((r.a, r.b), 0), w.get((r.b, r.a), 0)
        assert r.weight == pytest.approx(a + b - a * b)


def test_encoder_is_deterministic_and_truncates(spark):
    df = spark.createDataFrame([(0, "un deux trois"), (1, ""), (2, None), (3, "un deux quatre")], "id long, text string")
    got = {r.id: r.vector for r in encode.encode_texts(df, "id", "text", max_length=2).collect()}
    assert got[0] == got[3] and not any(got[1]) and any(got[2])  # a missing text is the word nan
    again = {r.id: r.vector for r in encode.encode_texts(df.repartition(4), "id", "text", max_length=2).collect()}
    assert got == again


def test_own_encoder(spark):
    class Lengths:
        def encode(self, tokens):
            return np.array([[float(len(t))] for t in tokens])

    df = spark.createDataFrame([("a", "un deux"), ("b", "")], "k string, text string")
    assert dict(encode.encode_texts(df, "k", "text", Lengths).collect()) == {"a": [2.0], "b": [0.0]}


def test_one_long_word_costs_its_own_length():
    """Memory follows the characters there are, not the longest word times the words."""
    import tracemalloc

    words = [f"w{i % 500}" for i in range(40_000)]
    texts = [np.array(words[i : i + 100], dtype=object) for i in range(0, 40_000, 100)]
    texts.append(np.array(["x" * 20_000], dtype=object))
    tracemalloc.start()
    got = encode.HashEncoder(8).encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    assert [list(r) for r in encode.HashEncoder(8).encode(texts[-2:])] == [list(r) for r in got[-2:]]


def test_encoder_sees_bounded_slices(spark):
    class Counted:
        def encode(self, tokens):
            return np.full((len(tokens), 1), float(len(tokens)))

    df = spark.range(5000, numPartitions=1).selectExpr("id", "concat('mot', id) AS text")
    seen = [r.vector[0] for r in encode.encode_texts(df, "id", "text", Counted).collect()]
    assert len(seen) == 5000 and max(seen) <= encode.ROWS


def test_token_table_pooling(spark):
    rows = [(1, 0, 1, [1.0, 2.0]), (1, 1, 1, [3.0, 4.0]), (1, 2, 0, [9.0, 9.0]), (2, 0, 0, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, pos int, mask int, vec array<double>")
    assert dict(encode.pool_token_table(df, "id", "vec", "mask", 2).collect()) == {1: [2.0, 3.0], 2: [0.0, 0.0]}
    assert dict(encode.first_token_table(df, "id", "vec", "pos").collect()) == {1: [1.0, 2.0], 2: [5.0, 5.0]}


def test_python_tasks_do_not_need_the_package():
    """What a task gets carries its own code."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    payload = cloudpickle.dumps(encode.HashEncoder)
    code = "import sys, pickle; e = pickle.load(sys.stdin.buffer)(4); print(e.encode([['a', 'b'], []]).tolist())"
    done = subprocess.run([sys.executable, "-c", code], input=payload, capture_output=True, cwd="/", check=True)
    assert done.stdout.decode().strip() == str(encode.HashEncoder(4).encode([["a", "b"], []]).tolist())


def test_pivots_and_blocks_do_not_add_to_what_travels(spark):
    """Without clusters a row is sent once for each group of the other side, whatever the number of cells and blocks."""
    x = np.random.default_rng(8).normal(size=(1500, 12))
    rows = frame(spark, x).select("id", F.col("a").alias("v"))
    ids = np.arange(1500)
    for pivots, block_rows in (2, 4096), (60, 16):
        cells = neighbours._fit_cells(rows, 6, pivots, block_rows)
        inside = [cells.group_cells(g, 6) for g in range(6)]
        assert np.bincount(cells.groups(cells.distances(neighbours._units(x)).argmin(axis=1), ids, 6)).max() < 500 or block_rows > 16
        for queries in (True, False):
            sent = sum(len(r[2]) // 8 for r in neighbours._placed(ids, x, cells, inside, 6, queries))
            assert 1500 <= sent <= 1500 * 6
    assert neighbour_ids(neighbours.knn_cosine(frame(spark, x), "id", "a", 6, 25, 16)) == brute_force(x, 6)


def test_close_neighbours_beyond_single_precision(spark):
    """Distances that single precision cannot tell apart keep their order."""
    rng = np.random.default_rng(9)
    x = np.ones((2500, 6)) + rng.normal(scale=3e-5, size=(2500, 6))
    got = neighbours.knn_cosine(frame(spark, x), "id", "a", 5)
    assert neighbour_ids(got) == brute_force(x, 5)
