"""Neighbour descent against the exact search."""

import numpy as np
import pytest

from lexiloom.operators import descent
from lexiloom.operators.neighbours import knn_cosine


def table(spark, x):
    return spark.createDataFrame([(i * 3 + 1, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)


def found(df):
    return {(r.id, r.neighbour): r.distance for r in df.collect()}


@pytest.mark.parametrize(("shape", "k"), [("even", 15), ("clusters", 10)])
def test_recall_and_distances(spark, shape, k):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 24))
    if shape == "clusters":
        x = rng.normal(size=(12, 24))[rng.integers(0, 12, 1200)] * 3 + x
    df = table(spark, x)
    got = descent.knn_descent(df, "id", "v", k, pool=40)
    exact = knn_cosine(df, "id", "v", k)
    share = descent.recall(got, exact, "id").first()
    assert share.wanted == 1200 * k and share.hits >= 0.95 * share.wanted
    mine, best = found(got), found(exact)
    assert all(abs(best[p] - d) < 1e-11 for p, d in mine.items() if p in best)
    ranks = got.groupBy("id").agg({"rank": "max"}).collect()
    assert len(ranks) == 1200 and all(r[1] == k for r in ranks)


def test_small_tables_copies_and_zeros_are_exact(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(30, 5)), np.zeros((3, 5)), np.ones((40, 5))])
    df = table(spark, x)
    assert found(descent.knn_descent(df, "id", "v", 4)) == found(knn_cosine(df, "id", "v", 4))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert descent.knn_descent(empty, "id", "v").collect() == []
    one = spark.createDataFrame([(1, [1.0]), (2, None)], "id long, v array<double>")
    assert descent.knn_descent(one, "id", "v").collect() == []
    with pytest.raises(ValueError, match="pool"):
        descent.knn_descent(one, "id", "v", 5, pool=4)


def test_a_hub_is_not_a_group(spark):
    """All rows but a few point at one row; the lists stay whole and bounded."""
    rng = np.random.default_rng(3)
    spokes = np.hstack([np.eye(300), np.full((300, 1), 2.0)]) + rng.normal(size=(300, 301)) * 1e-3
    hub = np.zeros((1, 301))
    hub[0, 300] = 1
    df = table(spark, np.vstack([spokes, hub]))
    got = descent.knn_descent(df, "id", "v", 3, pool=10)
    nearest = {r.id: r.neighbour for r in got.where("rank = 1").collect()}
    assert sum(nearest[i * 3 + 1] == 901 for i in range(300)) >= 0.9 * 300


def test_a_vector_travels_once_to_a_group(spark):
    """Not once for each of the up to 2 * pool links of its row; one round then finds most of what there is."""
    rng = np.random.default_rng(4)
    df = table(spark, rng.normal(size=(1200, 24)))
    lists = [(i * 3 + 1, [(i + j) % 1200 * 3 + 1 for j in range(1, 41)]) for i in range(1200)]
    held = [(i, np.array(n).tobytes(), np.arange(40).tobytes(), b"\1" * 40) for i, n in lists]
    graph = spark.createDataFrame([(i, bytearray(n), bytearray(d), bytearray(f)) for i, n, d, f in held], descent.LISTS)
    pairs = [(i, j) for i, n in lists for j in n]
    both = spark.createDataFrame(pairs + [(j, i) for i, j in pairs], "owner long, id long")
    packed = df.select("id", df.v.cast("string").cast("binary").alias("v"))
    sent = [(r.g, r.id) for r in descent._sent(both, graph, packed, 40, 4).collect()]
    assert len(sent) == len(set(sent)) <= 4 * 1200
    group = {r.id: r.g for r in df.select("id", descent._group("id", 4).alias("g")).collect()}
    assert set(sent) == {(group[i], j) for i, j in pairs} | {(group[j], i) for i, j in pairs} | {(group[i], i) for i, _ in pairs}

    share = descent.recall(descent.knn_descent(df, "id", "v", 15, pool=40, rounds=1), knn_cosine(df, "id", "v", 15), "id").first()
    assert share.hits >= 0.95 * share.wanted
