"""Exact cosine neighbours (V6) and fuzzy neighbour weights (V7).

The neighbour join follows the pivot idea of Lu et al., "Efficient Processing of
k Nearest Neighbor Joins using MapReduce" (VLDB 2012): vectors are assigned to
the nearest of a bounded number of pivots, and a query only visits the cells
that the triangle inequality cannot rule out. Cells are cut into blocks, so a
dense cell becomes many tasks, each one a matrix product with a local top-k.
Bitwise copies are searched once and expanded at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.operators.splits import split_hash
from lexiloom.session import materialise

MAX_PIVOTS = 2048
MAX_PIVOT_BYTES = 64 << 20  # what is broadcast grows with pivots x dimensions, never with the rows
ROWS_PER_PIVOT = 4000
BLOCK_ROWS = 4096
CHUNK_ROWS = 512
GROUPS, LEAST_ROWS = 8, 256  # groups of a side, unless they hold fewer rows than this
GROUP_ROWS, GROUP_BYTES = 1 << 16, 64 << 20
TILES = 1 << 10, 1 << 13  # members of the first product of a chunk, and of the largest one
NO_KEY = np.iinfo(np.int64).min
NEAR = 8  # pivots that bound the distance of the k-th neighbour
STEPS = 1e-12  # resolution at which distances are compared; ties go to the smaller id
SLACK = 1e-9  # on squared distances, far above STEPS and rounding


@dataclass(frozen=True)
class Cells:
    """Pivots, and per cell its extent and members: size bounded by MAX_PIVOTS."""

    pivots: np.ndarray
    far: np.ndarray
    close: np.ndarray
    nearest: np.ndarray
    members: np.ndarray
    block_rows: int

    def distances(self, units: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (units @ self.pivots.T), 0))

    def visits(self, units: np.ndarray, k: int) -> np.ndarray:
        """Which cells can hold one of the k nearest of each row, or an equally distant one."""
        d = self.distances(units)
        rows = np.arange(len(d))
        own = d.argmin(axis=1)
        near = np.argpartition(d, NEAR, axis=1)[:, :NEAR] if d.shape[1] > NEAR else np.tile(np.arange(d.shape[1]), (len(d), 1))
        upper = (d[rows[:, None], near][:, :, None] + self.nearest[near]).reshape(len(d), -1)
        bound = np.partition(upper, k, axis=1)[:, k] if upper.shape[1] > k else np.full(len(d), np.inf)
        between = np.sqrt(np.maximum(2 - 2 * (self.pivots[own] @ self.pivots.T), 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(between > 0, (d**2 - d[rows, own][:, None] ** 2) / (2 * between), 0)
        lower = np.maximum.reduce([d - self.far, self.close - d, plane, np.zeros_like(d)])
        return (lower**2 <= bound[:, None] ** 2 + SLACK) & (self.members > 0)

    def groups(self, cell: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
        """Which of ``count`` groups each row of a cell is in: that of its block, dealt in cell order."""
        spread = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        block = (spread % self._blocks()[cell].astype(np.uint64)).astype(np.int64)
        return self._dealt(cell, block, count)

    def group_cells(self, group: int, count: int) -> np.ndarray:
        """The cells that have a block in a group."""
        every = np.arange(len(self.members))
        first, last = self._dealt(every, np.zeros(len(every), np.int64), count), self._dealt(every, self._blocks() - 1, count)
        return np.flatnonzero((first <= group) & (group <= last) & (self.members > 0))

    def _blocks(self) -> np.ndarray:
        return np.maximum(-(-self.members // self.block_rows), 1)

    def _dealt(self, cell: np.ndarray, block: np.ndarray, count: int) -> np.ndarray:
        before = np.cumsum(self.members) - self.members
        place = before[cell] + block * self.members[cell] // self._blocks()[cell]
        return np.minimum(place * count // max(int(self.members.sum()), 1), count - 1)


def knn_cosine(
    df: DataFrame,
    key: str,
    vector: str,
    k: int = 15,
    rows_per_pivot: int = ROWS_PER_PIVOT,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``key, rank, neighbour, distance``: the k nearest other rows by ``1 - cosine``.

    Exact; equal distances go to the smaller key. A zero vector is at distance 1
    from all others and 0 from another zero vector.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    unique, copies = _without_copies(rows, k)
    found = _search(unique, k, rows_per_pivot, block_rows)
    if copies is None:
        best = Window.partitionBy("id").orderBy("d", "n")
        top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    else:
        top = _expand(found, copies, k)
    distance = F.greatest(F.col("d") * F.lit(STEPS), F.lit(0.0))
    return top.select(F.col("id").alias(key), "rank", F.col("n").alias("neighbour"), distance.alias("distance"))


def fuzzy_weights(neighbours: DataFrame, key: str, steps: int = 64) -> DataFrame:
    """``key, neighbour, weight``: ``exp(-(d - rho) / sigma)`` with rho the smallest positive distance.

    Sigma is bisected so that the weights of a row sum to ``log2(k)``.
    """
    per_row = neighbours.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("distance", "neighbour"))).alias("near")  # k entries
    )
    distances = F.transform("near", lambda x: x["distance"])
    positive = F.filter(distances, lambda d: d > 0)
    per_row = per_row.select(
        key, "near", distances.alias("ds"), F.coalesce(F.get(positive, F.lit(0)), F.lit(0.0)).alias("rho")
    )
    gaps = F.transform("ds", lambda d: F.greatest(d - F.col("rho"), F.lit(0.0)))
    per_row = per_row.select(key, "near", "rho", gaps.alias("gaps"), F.log2(F.size("ds")).alias("target"))

    def halve(s, _):
        mid = s["mid"]
        total = F.aggregate("gaps", F.lit(0.0), lambda acc, g: acc + F.exp(-g / mid))
        too_wide = total > F.col("target")
        lo = F.when(too_wide, s["lo"]).otherwise(mid)
        hi = F.when(too_wide, mid).otherwise(s["hi"])
        nxt = F.when(hi == F.lit(float("inf")), lo * 2).otherwise((lo + hi) / 2)
        return F.struct(lo.alias("lo"), hi.alias("hi"), nxt.alias("mid"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("mid"))
    fitted = per_row.select(
        key,
        "near",
        "rho",
        F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["mid"].alias("sigma"),
    )
    edges = fitted.select(key, "rho", "sigma", F.inline("near"))
    gap = F.greatest(F.col("distance") - F.col("rho"), F.lit(0.0))
    return edges.select(key, "neighbour", F.exp(-gap / F.col("sigma")).alias("weight"))


def fuzzy_union(weights: DataFrame, key: str) -> DataFrame:
    """Undirected edges ``a < b`` with ``w_ab + w_ba - w_ab * w_ba``: one combined aggregation."""
    pairs = weights.select(
        F.least(key, "neighbour").alias("a"), F.greatest(key, "neighbour").alias("b"), "weight"
    )
    both = F.count(F.lit(1)) == 2
    product = F.min("weight") * F.max("weight")
    return pairs.groupBy("a", "b").agg((F.sum("weight") - F.when(both, product).otherwise(0.0)).alias("weight"))


@dataclass(frozen=True)
class Copies:
    """All rows that have bitwise copies, and per group its vector, lowest key and lowest ``k + 1`` keys."""

    rows: DataFrame
    groups: DataFrame


def _without_copies(rows: DataFrame, k: int) -> tuple[DataFrame, Copies | None]:
    """Rows with one representative per group of bitwise copies, and the copies.

    A group keeps its ``k + 1`` smallest keys: no row can have a further member
    among its k neighbours, since ties go to the smaller key.
    """
    hashed = rows.withColumn("h", F.xxhash64("v"))
    repeated = materialise(hashed.groupBy("h").count().filter("count > 1").select("h"), "copies")
    if repeated.isEmpty():
        return rows, None
    order = Window.partitionBy("v").orderBy("id")
    copies = hashed.join(repeated, "h", "left_semi").select("id", "v")
    smallest = copies.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    groups = smallest.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"))
    groups = materialise(groups, "copy-groups")
    singles = hashed.join(repeated, "h", "left_anti").select("id", "v")
    unique = materialise(singles.unionByName(groups.select("id", "v")), "distinct-vectors")
    return unique, Copies(copies, groups)


def _expand(found: DataFrame, copies: Copies, k: int) -> DataFrame:
    """From neighbours among representatives to neighbours among all rows."""
    ids = copies.groups.select(F.col("id").alias("n"), "ids")
    others = found.join(ids, "n", "left").select(
        "id", "d", F.explode(F.coalesce("ids", F.array("n"))).alias("n")
    )
    own = copies.groups.select("id", F.lit(0).cast("long").alias("d"), F.explode("ids").alias("n"))
    best = Window.partitionBy("id").orderBy("d", "n")
    # one more than k, as each member leaves itself out
    top = others.unionByName(own).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    lists = top.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d", "n"))).alias("near"))
    lists = materialise(lists, "neighbour-lists")

    # only copies need a join; it is on the few groups, so a hot one is a broadcast or an AQE skew split
    shared = materialise(lists.join(copies.groups.select("id", "v"), "id").select("v", "near"), "group-lists")
    members = lists.join(copies.groups.select("id"), "id", "left_anti").unionByName(
        copies.rows.join(shared, "v").select("id", "near")
    )
    near = F.slice(F.filter("near", lambda x: x["n"] != F.col("id")), 1, k)
    return members.select("id", F.posexplode(near).alias("p", "x")).select(
        "id", (F.col("p") + 1).alias("rank"), "x.d", "x.n"
    )


PACKED = "mg int, qg int, ids binary, cells binary, visits binary, v binary"
FOUND = "id long, n long, d long"


def _search(rows: DataFrame, k: int, rows_per_pivot: int, block_rows: int) -> DataFrame:
    """``id, n, d``: candidates that include the k nearest of each row; ``d`` counts STEPS."""
    n = rows.count()
    sample = _units([r["v"] for r in rows.limit(1).collect()] or [[0.0]])
    width = sample.shape[1]
    pivots = min(MAX_PIVOTS, MAX_PIVOT_BYTES // (8 * width), math.ceil(n / rows_per_pivot))
    if pivots <= 1:
        one = np.zeros(1)
        cells = Cells(sample, one + 2, one, np.full((1, k + 1), np.inf), np.array([n]), block_rows)
    else:
        cells = _fit_cells(rows, k, pivots, block_rows)
    most = max(1, min(GROUP_ROWS, GROUP_BYTES // (8 * width)))
    count = max(math.ceil(n / most), min(GROUPS, math.ceil(n / LEAST_ROWS)), 1)
    inside = [cells.group_cells(g, count) for g in range(count)]
    # vectors travel as they are stored
    kind = np.float32 if rows.schema["v"].dataType == T.ArrayType(T.FloatType()) else np.float64

    def placed(batches: Iterator[pa.RecordBatch], queries: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).fill_null(NO_KEY).to_numpy(), _entries(batch.column(1)).astype(kind)
            yield _packed_rows(_placed(ids, x, cells, inside, k, queries))

    def match(q: pa.Table, m: pa.Table) -> pa.Table:
        if not (len(q) and len(m)):
            return _found([])
        here = inside[m.column("mg")[0].as_py()]
        ids, names = (np.frombuffer(_joined(t, "ids"), np.int64) for t in (q, m))
        own, cell = (np.frombuffer(_joined(t, "cells"), np.int32) for t in (q, m))
        bits = np.frombuffer(_joined(q, "visits"), np.uint8).reshape(len(ids), -1)
        queries, members = (np.frombuffer(_joined(t, "v"), kind).reshape(len(i), -1) for t, i in ((q, ids), (m, names)))
        order = np.argsort(cell, kind="stable")
        names, cell, members = names[order], cell[order], _units(members[order])
        rough = members.astype(np.float32)
        order = np.argsort(own, kind="stable")
        out = []
        for i in range(0, len(order), CHUNK_ROWS):
            at = order[i : i + CHUNK_ROWS]
            met = here[np.unpackbits(bits[at], axis=1, count=len(here)).any(axis=0)]
            some = slice(None) if len(met) == len(here) else np.flatnonzero(np.isin(cell, met))
            out.append(_nearest(ids[at], _units(queries[at]), names[some], members[some], rough[some], k))
        return _found(out)

    # the groups of one task each; their number is known, so nothing merges them again
    sides = (rows.mapInArrow(lambda b, queries=queries: placed(b, queries), PACKED) for queries in (True, False))
    q, m = (side.repartition(count * count, "mg", "qg").groupBy("mg", "qg") for side in sides)
    found = q.cogroup(m).applyInArrow(match, FOUND)
    return found.select(*(F.nullif(c, F.lit(int(NO_KEY))).alias(c) for c in ("id", "n")), "d")


def _placed(ids: np.ndarray, x: np.ndarray, cells: Cells, inside: list[np.ndarray], k: int, queries: bool) -> list[tuple]:
    """Rows of PACKED: each row as a member once for every group of queries, or as a query for the groups it visits."""
    units, count = _units(x), len(inside)
    chunks = [units[i : i + CHUNK_ROWS] for i in range(0, len(ids), CHUNK_ROWS)]
    own = np.concatenate([cells.distances(c).argmin(axis=1) for c in chunks])
    visits = np.concatenate([cells.visits(c, k) for c in chunks]) if queries else None
    group = cells.groups(own, ids, count)
    out = []
    for g in np.unique(group).tolist():
        mine = np.flatnonzero(group == g)
        for other in range(count):
            at, seen = mine, b""
            if visits is not None:
                meets = visits[np.ix_(mine, inside[other])]
                met = meets.any(axis=1)
                at, seen = mine[met], np.packbits(meets[met], axis=1).tobytes()
            if len(at):
                place = (other, g) if queries else (g, other)
                out.append((*place, ids[at].tobytes(), own[at].astype(np.int32).tobytes(), seen, x[at].tobytes()))
    return out


def _entries(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column, which must have one length."""
    lengths = np.unique(np.diff(column.offsets.to_numpy()))
    if len(lengths) > 1:
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["mg", "qg", "ids", "cells", "visits", "v"])


def _joined(table: pa.Table, name: str) -> bytes:
    return b"".join(table.column(name).to_pylist())


def _found(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    ids, names, d = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    return pa.table({"id": ids, "n": names, "d": d})


def _fit_cells(rows: DataFrame, k: int, count: int, block_rows: int) -> Cells:
    """Pivots by lowest hash; then cell extents: one pass without a big shuffle."""
    picked = rows.withColumn("h", split_hash("id")).orderBy("h").limit(count).collect()  # MAX_PIVOTS at most
    pivots = np.unique(_units([r["v"] for r in picked]), axis=0)
    size = len(pivots)
    none = np.zeros(size)
    bare = Cells(pivots, none, none, np.full((size, k + 1), np.inf), none, block_rows)

    def extents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = []
        for batch in _chunks(batches):
            d = bare.distances(_units(batch["v"]))
            own = d.argmin(axis=1)
            parts.append(pd.DataFrame({"cell": own, "d": d[np.arange(len(d)), own], "n": 1}))
            if len(parts) > 64:
                parts = [_extent(pd.concat(parts), k)]
        if parts:
            yield _extent(pd.concat(parts), k)

    # per task and cell: its k + 1 closest, its farthest, and their count on the first row
    seen = rows.mapInPandas(extents, "cell int, d double, n long")
    rank = Window.partitionBy("cell").orderBy("d")
    far = seen.groupBy("cell").agg(F.max("d").alias("far"), F.sum("n").alias("n"))
    close = seen.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k + 1)
    close = close.groupBy("cell").agg(F.sort_array(F.collect_list("d")).alias("ds"))
    members, farthest, nearest = np.zeros(size, dtype=np.int64), np.zeros(size), np.full((size, k + 1), np.inf)
    for r in far.join(close, "cell").collect():  # one row per pivot
        members[r["cell"]], farthest[r["cell"]] = r["n"], r["far"]
        nearest[r["cell"], : len(r["ds"])] = r["ds"]
    closest = np.where(members > 0, nearest[:, 0], 0)
    return Cells(pivots, farthest, closest, nearest, members, block_rows)


def _extent(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of each cell the k + 1 closest rows and the farthest one; counts move to its first row."""
    ordered = rows.sort_values(["cell", "d"])
    grouped = ordered.groupby("cell")
    keep = (grouped.cumcount() <= k) | (grouped.cumcount(ascending=False) == 0)
    total = grouped["n"].transform("sum")
    first = grouped.cumcount() == 0
    return ordered.assign(n=total.where(first, 0))[keep]


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), CHUNK_ROWS):
            yield batch.iloc[start : start + CHUNK_ROWS]


def _units(vectors) -> np.ndarray:
    """Rows of length one. An extra dimension holds the zero vectors."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.hstack([x / np.where(norm > 0, norm, 1), (norm == 0).astype(float)])


def _nearest(
    ids: np.ndarray, queries: np.ndarray, names: np.ndarray, members: np.ndarray, rough: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local top-k of some queries among members: ids, neighbours, STEPS.

    ``rough`` are the members in single precision. Its products are off by less than ``off``; whatever
    comes within that of a query's k-th best so far is compared in double.
    """
    off = (queries.shape[1] + 8) * 2.0**-23
    asked = queries.astype(np.float32)
    # a row is no neighbour of its own, nor are others of its key
    order = np.argsort(names, kind="stable")
    low, high = (np.searchsorted(names[order], ids, side) for side in ("left", "right"))
    same = np.where(ids == NO_KEY, 0, high - low)
    own_row = np.repeat(np.arange(len(ids)), same)
    own_at = order[np.repeat(low, same) + np.arange(len(own_row)) - np.repeat(np.cumsum(same) - same, same)]

    floor = np.full(len(ids), -np.inf)
    row, at, d = (np.zeros(0, np.int64) for _ in range(3))
    start, tile = 0, TILES[0]
    while start < len(names):
        stop = min(start + tile, len(names))
        near = asked @ rough[start:stop].T
        own = (own_at >= start) & (own_at < stop)
        near[own_row[own], own_at[own] - start] = -np.inf
        if not start and stop > k:
            floor = np.partition(near, -k, axis=1)[:, -k].astype(float) - 2 * off
        i, j = np.divmod(np.flatnonzero(near >= floor.astype(np.float32)[:, None]), stop - start)
        valid = near[i, j] > -np.inf
        i, j = i[valid], j[valid] + start
        steps = np.rint((1 - np.einsum("ij,ij->i", queries[i], members[j])) / STEPS).astype(np.int64)
        row, at, d = np.concatenate((row, i)), np.concatenate((at, j)), np.concatenate((d, steps))
        by = np.lexsort((names[at], d, row))
        row, at, d = row[by], at[by], d[by]
        counts = np.bincount(row, minlength=len(ids))
        first = np.cumsum(counts) - counts
        kept = np.arange(len(row)) - first[row] < k
        full = np.flatnonzero(counts >= k)
        floor[full] = 1 - d[first[full] + k - 1] * STEPS - 2 * off
        row, at, d = row[kept], at[kept], d[kept]
        start, tile = stop, min(2 * tile, TILES[1])
    return ids[row], names[at], d
