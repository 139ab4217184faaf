"""Near duplicates by SimHash: fingerprints, bit-sliced comparison, components.

Equal fingerprints are one node from the start, so copies are never paired. Nodes
within ``radius`` bits agree on ``kept`` of ``radius + kept`` stripes of the 64
bits, so comparing nodes that agree on such stripes misses no link. Nodes of one
bucket are stored as bit planes, 64 fingerprints to a machine word: one pass over
the planes updates 64 distances by carry-save counters, and a word is abandoned
once all its distances exceed the radius. A large bucket is dealt out as blocks,
and each pair of blocks is a task of its own; from a block only one link to the
smallest node of each group leaves the task, never all pairs.

Defined results: null, empty and blank texts have no words and fingerprint zero,
linked like any other; texts of one or two words have one shingle; repeated rows
are one node but each keeps its row. ``component_id`` is the smallest id that is
reachable; it is null only if all ids of a component are null.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.blocks import NOT_SPACE, Block, blocks, bounded_batches, ranges, words
from lexiloom.llm.components import stars
from lexiloom.session import materialise

SHINGLE = 3
RADIUS = 3
KEPT = 2
BLOCK = 4096
SEED = 42
SLICE = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def block_fingerprints(block: Block) -> np.ndarray:
    """Majority bits of the shingle hashes of each text, repeats counted."""
    w = words(block, NOT_SPACE)
    size = w.end - w.start
    # words of a text joined by one space
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = block.data[NOT_SPACE[block.data]]
    end = np.cumsum(size + 1) - 1
    start = end - size
    held = np.diff(w.bounds)
    n = np.where(held > 0, np.maximum(held - SHINGLE + 1, 1), 0)
    first = ranges(w.bounds[:-1], n)
    row = np.repeat(np.arange(block.rows), n)
    last = np.minimum(first + SHINGLE, w.bounds[1:][row]) - 1
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    counts = np.zeros((block.rows, 64), np.int64)
    for i in range(0, len(first), SLICE):
        a, b, own = start[first[i : i + SLICE]].tolist(), end[last[i : i + SLICE]].tolist(), row[i : i + SLICE]
        hashes = np.fromiter((digest(text[x:y], SEED) for x, y in zip(a, b, strict=True)), np.uint64, len(own))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        head = np.flatnonzero(np.diff(own, prepend=-1))
        counts[own[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        parts = [block_fingerprints(b) for b in blocks(texts)]
        yield pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))


def fingerprint(text: str | Column) -> Column:
    """64-bit SimHash of word shingles as a long."""
    return F.arrow_udf(_fingerprints, "long")(text)


def group_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b), and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], least)
        np.minimum.at(new, root[right], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def compare(left: list[np.ndarray], right: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``left[i]`` and ``right[i]`` for all i, as (node, smallest node of its group)."""
    n_words = np.array([-(-len(r) // 64) for r in right])
    first_word = np.concatenate(([0], np.cumsum(n_words)))
    lanes = np.zeros(first_word[-1] * 64, np.uint64)
    used = np.zeros(len(lanes), np.uint8)
    place = ranges(first_word[:-1] * 64, np.array([len(r) for r in right]))
    lanes[place], used[place] = np.concatenate(right), 1
    valid = np.packbits(used, bitorder="little").view(np.uint64)
    one = np.uint64(1)
    planes = [np.packbits(((lanes >> np.uint64(k)) & one).astype(np.uint8), bitorder="little").view(np.uint64) for k in range(64)]
    queries = np.concatenate(left)
    sizes = np.array([len(x) for x in left])
    task_words = np.repeat(n_words, sizes)
    tasks = np.concatenate(([0], np.cumsum(task_words)))
    firsts = np.repeat(first_word[:-1], sizes)
    counters = radius.bit_length()
    found_a, found_b = [], []
    i = 0
    while i < len(queries):
        j = max(i + 1, int(np.searchsorted(tasks, tasks[i] + SLICE, side="right")) - 1)
        query = np.repeat(queries[i:j], task_words[i:j])
        word = ranges(firsts[i:j], task_words[i:j])
        i = j
        sums = [np.zeros(len(query), np.uint64) for _ in range(counters)]
        over = ~valid[word]
        for step in range(64):
            k = step * 29 % 64  # stripes that a bucket has in common are spread over the pass
            carry = planes[k][word] ^ (np.uint64(0) - ((query >> np.uint64(k)) & one))
            for s in sums:
                up = s & carry
                s ^= carry
                carry = up
            over |= carry
            if step % 8 == 7:
                live = np.flatnonzero(over != ALL)
                if len(live) < len(over):
                    query, word, over, sums = query[live], word[live], over[live], [s[live] for s in sums]
        if not len(query):
            continue
        at, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a, b = query[at], lanes[word[at] * 64 + lane]
        near = (a != b) & (np.bitwise_count(a ^ b) <= radius)
        if near.any():
            node, root = group_roots(a[near].view(np.int64), b[near].view(np.int64))
            found_a.append(node)
            found_b.append(root)
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    node, root = group_roots(np.concatenate(found_a), np.concatenate(found_b))
    return node[node != root], root[node != root]


def _linker(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("left", "right"):
                column = batch.column(name)
                values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                sides.append(np.split(values, np.cumsum(np.diff(column.offsets.to_numpy()))[:-1]))
            a, b = compare(*sides, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return link


def stripe_masks(radius: int, kept: int) -> list[int]:
    """Bits of every choice of ``kept`` stripes, as signed longs."""
    n = radius + kept
    cuts = [64 * k // n for k in range(n + 1)]
    stripes = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(n)]
    masks = [sum(chosen) for chosen in combinations(stripes, kept)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, radius: int = RADIUS, kept: int = KEPT, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints ``fp`` to links (a, b) that connect all within ``radius`` bits."""
    keys = [F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(stripe_masks(radius, kept))]
    keyed = nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.table", "k.key")
    shared = keyed.groupBy("table", "key").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / block).cast("int"))
    dealt = (
        keyed.join(shared, ["table", "key"])
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .groupBy("table", "key", "parts", "part")
        .agg(F.collect_list("fp").alias("left"))
    )
    dealt = materialise(dealt, "buckets")
    alone = dealt.where("parts = 1").select("left", F.col("left").alias("right"))
    hot = dealt.where("parts > 1")
    others = hot.select("table", "key", F.col("part").alias("other"), F.col("left").alias("right"))
    pairs = hot.withColumn("other", F.explode(F.sequence("part", F.col("parts") - 1))).join(others, ["table", "key", "other"])
    tasks = alone.union(pairs.select("left", "right"))
    return tasks.mapInArrow(_linker(radius), "a long, b long")


def node_components(nodes: DataFrame, radius: int = RADIUS, kept: int = KEPT) -> DataFrame:
    """Distinct fingerprints to (fp, root): the root is one fingerprint of the component."""
    found = stars(links(nodes, radius, kept)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return nodes.select("fp").join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, kept: int = KEPT) -> DataFrame:
    """One row for each row: ``doc_id``, ``fingerprint`` (hex), ``component_id``; the texts are read once."""
    bounded_batches(docs.sparkSession)
    rows = materialise(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text).cast("string")).alias("fp")), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = materialise(nodes.join(node_components(nodes, radius, kept), "fp"), "roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = roots.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        F.col("doc_id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, kept: int = KEPT) -> DataFrame:
    """Of each component the row with the smallest id (null last; ties by a hash of the text), with all its columns.

    A row is known by its id and the hash of its text; of rows equal in both, one stays.
    """
    bounded_batches(docs.sparkSession)
    key = (F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__hash"))
    rows = materialise(docs.select(*key, fingerprint(F.col(text).cast("string")).alias("fp")), "fingerprints")
    order = F.struct(F.col("__id").isNull().alias("last"), F.col("__id").alias("id"), F.col("__hash").alias("hash"))
    known = rows.groupBy("__id", "__hash", "fp").agg(F.count("*").alias("n"))
    nodes = materialise(known.groupBy("fp").agg(F.min(F.struct(order.alias("o"), "n")).alias("best")), "nodes")
    chosen = nodes.join(node_components(nodes, radius, kept), "fp").groupBy("root").agg(F.min("best").alias("best"))
    chosen = materialise(chosen.select(F.col("best.o.id").alias("__keep"), F.col("best.o.hash").alias("__keep_hash"), "best.n"), "chosen")
    same = F.col("__keep").eqNullSafe(F.col(doc_id)) & (F.col("__keep_hash") == F.xxhash64(text))
    once = docs.join(chosen.where("n = 1").hint("shuffle_hash"), same, "left_semi")
    repeated = chosen.where("n > 1")
    if repeated.isEmpty():
        return once
    one = docs.join(repeated, same).dropDuplicates(["__keep", "__keep_hash"]).select(*docs.columns)
    return once.unionByName(one)
