"""Approximate cosine neighbours by neighbour descent (V6), for tables where all pairs are too many.

After Dong, Moses and Li, "Efficient k-nearest neighbor graph construction for generic similarity
measures" (WWW 2011): a neighbour of a neighbour is likely a neighbour. Every row keeps its ``pool``
nearest rows so far. They start as rows next to each other in several orders by the signs of random
hyperplanes. In a round, each row looks at the rows on both ends of its links, compares all pairs among
them of which one is new, and tells both ends what they did not have. Rounds end when few lists change.
All distances are exact; only which pairs are compared is a matter of chance.

Rows start from the nearest rows of their blocks: consecutive rows of an order, all compared with each
other. Lists that start near leave few pairs to send in a round.

Scale: the owners of links are dealt to groups, and a vector travels once to each group that looks at it, not
once for each link. A group has as many owners as keep its vectors under ``GROUP_BYTES``, so groups and what
is sent in a round are linear in rows x pool at most; a list is one packed row. A row that many others link to
answers ``pool`` of them in a round, so no group grows with the table. A round reads and writes tables in
the shared folder. Bitwise copies are searched once and expanded exactly, as in the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.operators.neighbours import NO_KEY, STEPS, _entries, _expand, _units, _without_copies
from lexiloom.session import materialise

POOL, TABLES, ROUNDS, CHANGED = 60, 8, 12, 0.002
SIGNS = 48
SEED = 42
BLOCK = 1 << 11  # rows compared with each other at the start
GROUPS, GROUP_BYTES = 16, 512 << 20  # groups of owners at least, and the vectors that one of them may see
LISTS = "id long, n binary, d binary, fresh binary"  # neighbours of a row, nearest first, or some of them
FLAT = "id long, n long, d long, fresh boolean, rank int"
ROWS = 1 << 12  # lists merged at a time
PAIRS = 1 << 21  # found pairs held before they are merged
FAR = 2**62


def knn_descent(
    df: DataFrame,
    key: str,
    vector: str,
    k: int = 15,
    pool: int = POOL,
    tables: int = TABLES,
    rounds: int = ROUNDS,
    changed: float = CHANGED,
    seed: int = SEED,
) -> DataFrame:
    """``key, rank, neighbour, distance`` as ``knn_cosine`` gives them, most of them right.

    ``pool`` is the trade: larger lists find more and cost their square. It must be ``k`` at least.
    """
    if pool < k:
        raise ValueError("pool must not be smaller than k")
    rows = df.filter(F.col(vector).isNotNull()).select(F.coalesce(F.col(key).cast("long"), F.lit(int(NO_KEY))).alias("id"), F.col(vector).alias("v"))
    unique, copies = _without_copies(rows, k)
    # vectors travel as they are stored
    kind = np.float32 if unique.schema["v"].dataType == T.ArrayType(T.FloatType()) else np.float64
    packed = materialise(unique.mapInArrow(lambda b: _packed(b, kind), "id long, v binary"), "descent-vectors")
    size = packed.select(F.count(F.lit(1)), F.max(F.length("v"))).first()
    owners = max(1, GROUP_BYTES // ((2 * pool + 1) * max(size[1] or 1, 1)))
    groups = max(GROUPS, -(-size[0] // owners))

    def flat(lists: DataFrame, most: int) -> DataFrame:
        return lists.mapInArrow(lambda b: _flat(b, most), FLAT)

    graph = materialise(_merged(_starts(packed, kind, pool, tables, seed), pool), "descent")
    links = flat(graph, pool).count()
    for _ in range(rounds if links else 0):
        graph = materialise(_round(graph, packed, kind, pool, groups), "descent")
        if flat(graph, pool).where("fresh").count() <= changed * links:
            break
    found = flat(graph, k).select("id", "n", "d", "rank")
    top = found if copies is None else _expand(found.select("id", "n", "d"), copies, k)
    top = top.select(*(F.nullif(c, F.lit(int(NO_KEY))).alias(c) for c in ("id", "n")), "rank", "d")
    distance = F.greatest(F.col("d") * F.lit(STEPS), F.lit(0.0))
    return top.select(F.col("id").alias(key), "rank", F.col("n").alias("neighbour"), distance.alias("distance"))


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """``hits, wanted``: how many of the exact neighbours of the rows in ``exact`` were found."""
    hit = exact.join(found.select(key, "neighbour", F.lit(1).alias("hit")), [key, "neighbour"], "left")
    return hit.agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("wanted"))


def _packed(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes."""
    for batch in batches:
        if batch.num_rows:
            x = _entries(batch.column(1)).astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "v"])


def _matrix(vectors: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), kind).reshape(len(vectors), -1)


def _steps(sims: np.ndarray) -> np.ndarray:
    return np.rint((1 - sims) / STEPS).astype(np.int64)


def _lists(ids: np.ndarray, n: np.ndarray, d: np.ndarray, fresh: np.ndarray, most: int) -> pa.RecordBatch:
    """Rows of LISTS from pairs: of equal pairs one, then the nearest ``most`` of each row."""
    by = np.lexsort((fresh, d, n, ids))
    first = np.ones(len(by), bool)
    first[1:] = (ids[by[1:]] != ids[by[:-1]]) | (n[by[1:]] != n[by[:-1]])
    old = np.minimum.reduceat(fresh[by], np.flatnonzero(first)) if len(by) else fresh
    by = by[first]
    ids, n, d = ids[by], n[by], d[by]
    by = np.lexsort((n, d, ids))
    ids, n, d, fresh = ids[by], n[by], d[by], old[by]
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(ids))
    stops = np.minimum(ends, starts + most)
    held = [[c[a:b].tobytes() for a, b in zip(starts, stops, strict=True)] for c in (n, d, fresh.astype(np.int8))]
    return pa.RecordBatch.from_arrays([pa.array(ids[starts]), *(pa.array(c, pa.binary()) for c in held)], names=["id", "n", "d", "fresh"])


def _pairs(table: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs in rows of LISTS, and the place of each in its row."""
    n, d, fresh = (np.frombuffer(b"".join(table.column(i).to_pylist()), t) for i, t in ((1, np.int64), (2, np.int64), (3, np.int8)))
    counts = np.array([len(x) for x in table.column(3).to_pylist()], np.int64)
    place = np.arange(len(n)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(table.column(0).to_numpy(), counts), n, d, fresh, place


def _flat(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n, d, fresh, place = _pairs(batch)
        at = place < most
        held = [ids[at], n[at], d[at], fresh[at].astype(bool), (place[at] + 1).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["id", "n", "d", "fresh", "rank"])


def _merged(lists: DataFrame, most: int) -> DataFrame:
    """One list for each row, of its nearest ``most``."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if len(rest) < ROWS:
                continue
            ids = rest.column(0).to_numpy()
            last = int(np.searchsorted(ids, ids[-1]))  # its row may go on
            if last:
                yield _lists(*_pairs(rest.slice(0, last))[:4], most)
                rest = rest.slice(last).combine_chunks()
        if rest is not None and len(rest):
            yield _lists(*_pairs(rest)[:4], most)

    return lists.repartition("id").sortWithinPartitions("id").mapInArrow(merged, LISTS)


def _starts(packed: DataFrame, kind: type, pool: int, tables: int, seed: int) -> DataFrame:
    """The nearest rows of each row in its block of every order; an order is split into even ranges."""
    parts = packed.rdd.getNumPartitions()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = _units(_matrix(batch.column(1), kind))
                planes = np.random.default_rng(seed).normal(size=(tables, units.shape[1], SIGNS))
                weights = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
                codes = [pa.array(((units @ p) > 0) @ weights) for p in planes]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *codes], names=["id", "v", *names])

    def block(table: pa.Table) -> pa.RecordBatch:
        ids, units = table.column(0).to_numpy(), _units(_matrix(table.column(1), kind))
        sims = units @ units.T
        sims[ids[:, None] == ids[None, :]] = -np.inf
        most = min(pool, len(ids) - 1)
        near = np.argpartition(sims, -most, axis=1)[:, -most:] if most else np.zeros((len(ids), 0), np.int64)
        row, near = np.repeat(np.arange(len(ids)), most), near.ravel()
        some = sims[row, near] > -np.inf
        row, near = row[some], near[some]
        return _lists(ids[row], ids[near], _steps(sims[row, near]), np.ones(len(row), np.int8), pool)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            while len(rest) >= 2 * BLOCK:
                yield block(rest.slice(0, BLOCK))
                rest = rest.slice(BLOCK).combine_chunks()
        if rest is not None and len(rest):
            half = len(rest) if len(rest) <= BLOCK else len(rest) // 2
            for i in range(0, len(rest), half):
                yield block(rest.slice(i, half))

    names = [f"code{t}" for t in range(tables)]
    codes = materialise(packed.mapInArrow(coded, ", ".join(["id long", "v binary", *(f"{n} long" for n in names)])), "descent-codes")
    out = None
    for name in names:
        ordered = codes.select("id", "v", name).repartitionByRange(parts, name, F.xxhash64("id")).sortWithinPartitions(name, F.xxhash64("id"))
        lists = ordered.select("id", "v").mapInArrow(linked, LISTS)
        out = lists if out is None else out.unionByName(lists)
    return out


def _round(graph: DataFrame, packed: DataFrame, kind: type, pool: int, groups: int) -> DataFrame:
    """The lists after one exchange; ``fresh`` marks links that were not there before."""
    # a row answers at most ``pool`` of those that link to it, new links first
    answered = Window.partitionBy("n").orderBy(F.desc("fresh"), F.xxhash64("id", "n"))
    flat = graph.mapInArrow(lambda b: _flat(b, pool), FLAT).select("id", "n", "fresh")
    links = materialise(flat.withColumn("_r", F.row_number().over(answered)).where(F.col("_r") <= pool).drop("_r"), "descent-links")
    both = links.select(F.col("id").alias("owner"), F.col("n").alias("id"), "fresh").unionByName(
        links.select(F.col("n").alias("owner"), "id", "fresh")
    )

    members = both.select(_group("owner", groups).alias("g"), "owner", "id", "fresh")
    vectors = _sent(both, graph, packed, pool, groups)
    members, vectors = (side.repartition(groups, "g").groupBy("g") for side in (members, vectors))
    news = members.cogroup(vectors).applyInArrow(lambda m, v: _compared(m, v, kind, pool), LISTS)
    old = graph.select("id", "n", "d", F.unhex(F.repeat(F.lit("00"), F.length("fresh"))).alias("fresh"))
    return _merged(old.unionByName(news), pool)


def _group(owner: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(groups)).cast("int")


def _sent(both: DataFrame, graph: DataFrame, packed: DataFrame, pool: int, groups: int) -> DataFrame:
    """``g, id, v, worst``: each vector once for every group with an owner that looks at it, and what it must beat."""

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = [np.frombuffer(d, np.int64) for d in batch.column(2).to_pylist()]
            worst = np.array([d[-1] if len(d) >= pool else FAR for d in far], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(worst)], names=["id", "worst"])

    seen = both.select("id", _group("owner", groups).alias("g")).groupBy("id").agg(F.collect_set("g").alias("gs"))
    known = packed.join(graph.mapInArrow(limits, "id long, worst long"), "id").join(seen, "id", "left")
    every = F.array_union(F.coalesce("gs", F.array().cast("array<int>")), F.array(_group("id", groups)))
    return known.select(F.explode(every).alias("g"), "id", "v", "worst")


def _compared(members: pa.Table, vectors: pa.Table, kind: type, pool: int) -> pa.Table:
    """Pairs among the rows of one owner that at least one of them would take into its list."""
    out = [_lists(*(np.zeros(0, np.int64),) * 4, pool)]
    if not (len(members) and len(vectors)):
        return pa.Table.from_batches(out)
    names, worst = vectors.column(1).to_numpy(), vectors.column(3).to_numpy().copy()
    by = np.argsort(names, kind="stable")
    names, worst, x = names[by], worst[by], _matrix(vectors.column(2), kind)[by]

    owners, ids, fresh = (members.column(i).to_numpy() for i in (1, 2, 3))
    own = np.unique(owners)
    owners, ids, fresh = np.concatenate((owners, own)), np.concatenate((ids, own)), np.concatenate((fresh, np.zeros(len(own)))).astype(bool)
    by = np.lexsort((~fresh, ids, owners))
    owners, ids, fresh = owners[by], ids[by], fresh[by]
    first = np.concatenate(([True], (owners[1:] != owners[:-1]) | (ids[1:] != ids[:-1])))
    owners, ids, fresh = owners[first], ids[first], fresh[first]
    low, high = (np.searchsorted(names, ids, side) for side in ("left", "right"))
    same = high - low  # an id may stand on several vectors
    owners, fresh = np.repeat(owners, same), np.repeat(fresh, same)
    at = np.repeat(low, same) + np.arange(len(owners)) - np.repeat(np.cumsum(same) - same, same)

    def taken() -> None:
        one, two, d = (np.concatenate(c) for c in zip(*found, strict=True))
        lists = _lists(names[one], names[two], d, np.ones(len(one), np.int8), pool)
        out.append(lists)
        # what is farther than a whole list that this group sends is not taken
        full = [(i, np.frombuffer(far, np.int64)[-1]) for i, far in zip(lists.column(0).to_pylist(), lists.column(2).to_pylist(), strict=True) if len(far) == 8 * pool]
        for i, far in full:
            a, b = np.searchsorted(names, (i, i + 1))
            worst[a:b] = np.minimum(worst[a:b], far + 1)
        found.clear()

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    edges = [0, *(np.flatnonzero(owners[1:] != owners[:-1]) + 1).tolist(), len(owners)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        new = np.flatnonzero(fresh[a:b])
        if not len(new):
            continue
        mine = at[a:b]
        units, limit, called = _units(x[mine]), worst[mine], names[mine]
        d = _steps(units[new] @ units.T)
        d[called[new][:, None] == called[None, :]] = FAR
        i, j = np.nonzero(d < limit[new][:, None])
        found.append((mine[new][i], mine[j], d[i, j]))
        i, j = np.nonzero(d < limit[None, :])
        found.append((mine[j], mine[new][i], d[i, j]))
        held += len(found[-1][0]) + len(found[-2][0])
        if held >= PAIRS:
            taken()
            held = 0
    if found:
        taken()
    return pa.Table.from_batches(out)
