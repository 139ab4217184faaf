"""Low-dimensional layout of a weighted neighbour graph (V7), and places for new rows.

The start is spectral: the leading eigenvectors of the normalised edge table after the trivial one, by
orthogonal iteration. Then every epoch draws edges in proportion to their weight, pulls their ends
together, and pushes rows away from a few others, along the gradient of the fuzzy cross-entropy with
the curve ``1 / (1 + a d^(2b))``. A row moves by the mean of its pulls and pushes.

Scale: an iteration or epoch is a join of the edges with the coordinates and one combined sum per row;
rows with many edges are sums like all others. Rows to push away from are a sample of ``AWAY`` rows an
epoch, whatever the table's size. What is drawn is a hash of edge and epoch. Coordinates are written
every epoch, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.neighbours import CHUNK_ROWS, STEPS, _units, fuzzy_weights
from lexiloom.session import materialise

EPOCHS, ITERATIONS = 60, 20
#: fixed values: the curve fitted to a least distance of 0.1 and a spread of 1
CURVE_A, CURVE_B = 1.5769434602, 0.8950608778
PUSHES, AWAY = 5, 4096
CLIP, GAIN = 4.0, 2.0
WIDTH = 10.0
BLOCK = 4096


def layout(edges: DataFrame, components: int = 2, epochs: int = EPOCHS, iterations: int = ITERATIONS, seed: int = 42) -> DataFrame:
    """``id, coords`` for every row of the undirected edges ``a, b, weight``."""
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight")
    )
    both = materialise(both.where("weight > 0"), "layout-edges")
    strongest = both.agg(F.max("weight")).first()[0]
    coords = spectral(both, components, iterations, seed)
    for epoch in range(epochs if strongest else 0):
        coords = materialise(_epoch(both, coords, components, epoch, epochs, float(strongest), seed), "layout")
    return coords


def _uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def spectral(both: DataFrame, components: int, iterations: int, seed: int) -> DataFrame:
    """Leading eigenvectors of ``(I + D^-1/2 W D^-1/2) / 2`` but the first, scaled to +-WIDTH, with a little noise."""
    k = components + 1
    degree = materialise(both.groupBy("src").agg(F.sum("weight").alias("degree")).withColumnRenamed("src", "id"), "layout-degrees")
    other = degree.select(F.col("id").alias("dst"), F.col("degree").alias("of_dst"))
    own = degree.select(F.col("id").alias("src"), F.col("degree").alias("of_src"))
    scaled = both.join(other, "dst").join(own, "src")
    scaled = materialise(scaled.select("src", "dst", (F.col("weight") / F.sqrt(F.col("of_src") * F.col("of_dst"))).alias("w")), "layout-scaled")
    # the trivial vector is known, so it stays first and the others are kept apart from it
    start = [F.sqrt("degree"), *(_uniform(F.col("id"), F.lit(seed), F.lit(i)) - 0.5 for i in range(1, k))]
    x = _orthonormal(materialise(degree.select("id", F.array(*start).alias("v")), "layout-start"), k)
    for _ in range(iterations):
        x = materialise(x, "layout-vectors")
        sums = [F.sum(F.col("w") * F.col("v")[i]).alias(f"s{i}") for i in range(k)]
        moved = scaled.join(x.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(*sums)
        both_parts = x.join(moved.withColumnRenamed("src", "id"), "id")
        x = both_parts.select("id", F.array(*((F.col("v")[i] + F.col(f"s{i}")) / 2 for i in range(k))).alias("v"))
        x = _orthonormal(materialise(x, "layout-vectors"), k)
    x = materialise(x, "layout-vectors")
    widest = x.agg(*(F.max(F.abs(F.col("v")[i])) for i in range(1, k))).first()
    out = [
        F.col("v")[i] * (WIDTH / (widest[i - 1] or 1.0)) + (_uniform(F.col("id"), F.lit(seed + 1), F.lit(i)) - 0.5) * 2e-4
        for i in range(1, k)
    ]
    return materialise(x.select("id", F.array(*out).alias("coords")), "layout")


def _orthonormal(x: DataFrame, k: int) -> DataFrame:
    """The same space with orthonormal columns, in order: a Cholesky factor of the k x k products."""
    cells = [F.sum(F.col("v")[i] * F.col("v")[j]) for i in range(k) for j in range(k)]
    products = np.array([c or 0.0 for c in x.agg(*cells).first()]).reshape(k, k)
    size = np.trace(products)
    if not size > 0:
        return x
    # directions that are not there (fewer rows than columns) stay small instead of failing
    turn = np.linalg.inv(np.linalg.cholesky(products + np.eye(k) * size * 1e-14)).T
    columns = [sum((F.col("v")[i] * float(turn[i, j]) for i in range(j + 1)), F.lit(0.0)) for j in range(k)]
    return x.select("id", F.array(*columns).alias("v"))


def _epoch(both: DataFrame, coords: DataFrame, components: int, epoch: int, epochs: int, strongest: float, seed: int) -> DataFrame:
    """The coordinates after one epoch."""
    away = coords.withColumn("_h", F.xxhash64("id", F.lit(seed), F.lit(epoch))).orderBy("_h").limit(AWAY).select("id", "coords").collect()
    ids, places = np.array([r.id for r in away], np.int64), np.array([r.coords for r in away], float).reshape(len(away), components)

    def moves(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for src, x, y, draw in batches:
            own, x, y = (a.to_numpy(zero_copy_only=False) for a in (src, x.flatten(), y.flatten()))
            x, y = x.reshape(-1, components), y.reshape(-1, components)
            gap = x - y
            d = (gap * gap).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                pull = np.where(d > 0, -2 * CURVE_A * CURVE_B * d ** (CURVE_B - 1) / (1 + CURVE_A * d**CURVE_B), 0)
            total = np.clip(pull[:, None] * gap, -CLIP, CLIP)
            rng_key = draw.to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(PUSHES):
                pick = ((rng_key >> np.uint64(12 * i)) ^ (rng_key * np.uint64(2 * i + 3))) % np.uint64(max(len(ids), 1))
                pick = pick.astype(np.int64)
                gap = x - places[pick]
                d = (gap * gap).sum(axis=1)
                push = 2 * CURVE_B / ((0.001 + d) * (1 + CURVE_A * d**CURVE_B))
                total += np.clip(np.where((ids[pick] != own) & (d > 0), push, 0)[:, None] * gap, -CLIP, CLIP)
            yield pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), components).cast(pa.list_(pa.float64()))

    drawn = both.where(_uniform("src", "dst", F.lit(seed), F.lit(epoch)) * strongest < F.col("weight")).select("src", "dst")
    ends = drawn.join(coords.select(F.col("id").alias("dst"), F.col("coords").alias("y")), "dst")
    ends = ends.join(coords.select(F.col("id").alias("src"), F.col("coords").alias("x")), "src")
    move = F.arrow_udf(moves, "array<double>")("src", "x", "y", F.xxhash64("dst", "src", F.lit(seed), F.lit(epoch)))
    sums = ends.select("src", move.alias("g")).groupBy("src").agg(*(F.avg(F.col("g")[i]).alias(f"g{i}") for i in range(components)))
    step = GAIN * (1 - epoch / epochs)
    moved = [F.col("coords")[i] + step * F.coalesce(F.col(f"g{i}"), F.lit(0.0)) for i in range(components)]
    return coords.join(sums.withColumnRenamed("src", "id"), "id", "left").select("id", F.array(*moved).alias("coords"))


def knn_between(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 15, block_rows: int = BLOCK) -> DataFrame:
    """``key, rank, neighbour, distance``: for each query the k nearest of other rows by ``1 - cosine``, exactly.

    Queries and rows are cut into blocks by a hash; a task multiplies one pair of blocks and keeps the
    nearest k of each query. That is queries x rows products: for queries that are few against the rows.
    """
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // block_rows)), max(1, -(-n_queries // block_rows))

    def side(df: DataFrame, own: int, other: int, name: str, against: str) -> DataFrame:
        some = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        block = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")
        return some.select("id", "v", block.alias(name), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(against))

    def match(q: pa.Table, m: pa.Table) -> pa.Table:
        out = []
        if len(q) and len(m):
            names = m.column(0).to_numpy()
            order = np.argsort(names)
            names, members = names[order], _units(m.column(1).to_pylist())[order]
            bits, place = max(1, (len(names) - 1).bit_length()), np.arange(len(names), dtype=np.int64)
            for i in range(0, len(q), CHUNK_ROWS):
                part = q.slice(i, CHUNK_ROWS)
                steps = np.rint((1 - _units(part.column(1).to_pylist()) @ members.T) / STEPS).astype(np.int64)
                best = np.sort((steps << bits) | place, axis=1)[:, :k]
                ids = np.repeat(part.column(0).to_numpy(), best.shape[1])
                out.append((ids, names[best.ravel() & ((1 << bits) - 1)], best.ravel() >> bits))
        ids, found, d = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"id": ids, "n": found, "d": d})

    left, right = side(queries, query_blocks, row_blocks, "qb", "mb"), side(rows, row_blocks, query_blocks, "mb", "qb")
    pairs = left.groupBy("qb", "mb").cogroup(right.groupBy("qb", "mb")).applyInArrow(match, "id long, n long, d long")
    best = Window.partitionBy("id").orderBy("d", "n")
    top = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    distance = F.greatest(F.col("d") * F.lit(STEPS), F.lit(0.0))
    return top.select(F.col("id").alias(key), "rank", F.col("n").alias("neighbour"), distance.alias("distance"))


def place_new(neighbours: DataFrame, coords: DataFrame, key: str, components: int = 2) -> DataFrame:
    """``key, coords`` of new rows: the mean of their neighbours' places by fuzzy weight.

    ``neighbours`` are those of the new rows among the rows that ``coords`` knows. A row at distance 0 from
    a known one takes its place.
    """
    weights = fuzzy_weights(neighbours, key).join(neighbours.select(key, "neighbour", "distance"), [key, "neighbour"])
    known = weights.join(coords.select(F.col("id").alias("neighbour"), "coords"), "neighbour")
    same = F.col("distance") < STEPS * 1000
    known = known.withColumn("weight", F.when(same, F.lit(1e6)).otherwise(F.col("weight")))
    total = F.sum("weight")
    return known.groupBy(key).agg(F.array(*(F.sum(F.col("weight") * F.col("coords")[i]) / total for i in range(components))).alias("coords"))
