"""Language-model scores: prediction by partial matching over bytes, and a unigram base.

The model is a trie of byte contexts up to ``ORDER`` bytes. A symbol is predicted
in the longest known context; if it was never seen there, the model pays the escape
probability (method C: as many escapes as distinct symbols) and goes on in the
context one byte shorter, where symbols that the longer one offers are excluded.
Below order 0 all remaining symbols are equally likely. Every text ends with an end
symbol, and begins in the context of end symbols.

Counting: tasks cut their texts into chunks of about ``CHUNK_BYTES``, and count the
distinct runs of ORDER + 1 symbols and the distinct tokens of each chunk. Both leave as
sorted packed arrays, one for each part of the key space; no run is a row. The part of a
run is a hash of its last two context bytes, so every context of two bytes and more is
whole in one part, where all orders are computed at once. Contexts of one byte and none
are one table of at most 66,049 counts. Every counted context is part of the model
(``min_share`` is 0), at any corpus size.

Scoring: the symbols seen after a context were also seen after its suffixes, so the
cost of a run follows from its own count, the sums of its context, and the run one
symbol shorter. Costs, and counts of tokens, go back to each chunk as packed arrays
ahead of its texts, and are looked up as the texts pass. Neither the driver nor a
broadcast holds the model; a part holds the runs of about ``PART_BYTES`` of text.

The base counts tokens exactly. Its sum over a text needs only the sum of
``log10(c + 1)`` and the number of tokens; the corpus totals join at the end.

Defined results: null and empty texts are one end symbol, one end token; a null id
is a training row; repeated rows all count; with no training text the model is
uniform and no token is known.
"""

from collections.abc import Callable, Iterator
from struct import pack, unpack_from
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.blocks import NOT_SPACE, Block, blocks, bounded_batches, mix, runs_hash, words
from lexiloom.session import materialise

ORDER = 5
SYMBOLS = 257
END = 256
BITS = 9
MIN_SHARE = 0.0
CHUNK_BYTES = 32 << 20
PART_BYTES = 16 << 20
#: context symbols that place a run; shorter contexts are one table
PLACING = 2
END_TOKEN = 0
FOLDS, HELD_OUT = 7, 2
RUN, TOKEN, TOTAL = "run", "token", "total"
CHUNK_COLUMNS = ["chunk", "__id", "__hash", "text", "kind", "part", "data"]


def symbol_runs(block: Block, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ``order`` end symbols and before one; where texts begin; places to predict."""
    size = np.diff(block.offsets)
    start = np.cumsum(size + order + 1) - (size + order + 1)
    symbols = np.full(int((size + order + 1).sum()), END, np.int64)
    symbols[np.arange(len(block.data)) + np.repeat((np.arange(block.rows) + 1) * order + np.arange(block.rows), size)] = block.data
    predicted = np.ones(len(symbols), bool)
    predicted[(start[:, None] + np.arange(order)).ravel()] = False
    return symbols, np.append(start, len(symbols)), np.flatnonzero(predicted)


def packed(symbols: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    key = symbols[at - order]
    for k in range(order - 1, -1, -1):
        key = (key << BITS) | symbols[at - k]
    return key


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)


def _shuffled(a: np.ndarray) -> bytes:
    """All first bytes, then all second bytes, and so on: high bytes repeat."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _unshuffled(raw: bytes, kind: type, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def pack_pairs(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Ascending 64-bit keys as their steps, and a value for each."""
    steps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    raw = _shuffled(steps) + _shuffled(np.ascontiguousarray(values))
    return pack("<I", len(keys)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack_pairs(data: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    (n,) = unpack_from("<I", data)
    raw = pa.Codec("zstd").decompress(data[4:], decompressed_size=n * (8 + np.dtype(kind).itemsize), asbytes=True)
    return np.cumsum(_unshuffled(raw, np.uint64, n, 0)), _unshuffled(raw, kind, n, 8 * n)


def token_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end tokens last, and the row of each."""
    w = words(block, NOT_SPACE)
    h = runs_hash(block.data, w.start, w.end)
    h[h == END_TOKEN] = 1
    return np.concatenate((h, np.full(block.rows, END_TOKEN, np.uint64))), np.concatenate((w.rows(), np.arange(block.rows)))


def run_parts(keys: np.ndarray, order: int, parts: int) -> np.ndarray:
    placing = min(PLACING, order)
    context = (keys >> np.uint64(BITS)) & np.uint64((1 << (BITS * placing)) - 1)
    return (mix(context + np.uint64(1)) % np.uint64(parts)).astype(np.int64)


def _chunks(order: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The texts, each with the number of its chunk, and after them the runs and tokens of the chunk with their training counts."""

    def packed_rows(chunk: int, kind: str, counted: list, kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        keys, counts = merge_counts(counted)
        part = run_parts(keys, order, parts) if kind == RUN else (keys % np.uint64(parts)).astype(np.int64)
        at = np.argsort(part, kind="stable")
        keys, counts, edges = keys[at], counts[at], np.searchsorted(part[at], np.arange(parts + 1))
        own = np.flatnonzero(np.diff(edges))
        data = [pack_pairs(keys[edges[p] : edges[p + 1]], counts[edges[p] : edges[p + 1]].astype(np.uint32)) for p in own]
        empty = [pa.nulls(len(own), t) for t in kinds]
        columns = [pa.array(np.full(len(own), chunk)), *empty, pa.array([kind] * len(own), pa.string()), pa.array(own.astype(np.int32)), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=CHUNK_COLUMNS)

    def counted(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, place = np.unique(keys, return_inverse=True)
        return distinct, np.bincount(place, weights=trained, minlength=len(distinct)).astype(np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, kinds = TaskContext.get().partitionId() << 32, 0, []
        runs: list = []
        tokens: list = []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in CHUNK_COLUMNS[1:4]]
            for block in blocks(batch.column("text")):
                trained = ~batch.column("__held").slice(block.first, block.rows).to_numpy(zero_copy_only=False).astype(bool)
                symbols, start, at = symbol_runs(block, order)
                runs.append(counted(packed(symbols, at, order).view(np.uint64), np.repeat(trained, np.diff(start) - order)))
                h, row = token_hashes(block)
                tokens.append(counted(h, trained[row]))
                if len(runs) > 3:
                    runs, tokens = [merge_counts(runs)], [merge_counts(tokens)]
                own = [batch.column(c).slice(block.first, block.rows) for c in CHUNK_COLUMNS[1:4]]
                none = [pa.nulls(block.rows, t) for t in (pa.string(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(block.rows, chunk)), *own, *none], names=CHUNK_COLUMNS)
                size += len(block.data)
                if size >= CHUNK_BYTES:
                    yield from packed_rows(chunk, RUN, runs, kinds)
                    yield from packed_rows(chunk, TOKEN, tokens, kinds)
                    chunk, size, runs, tokens = chunk + 1, 0, [], []
        if runs:
            yield from packed_rows(chunk, RUN, runs, kinds)
            yield from packed_rows(chunk, TOKEN, tokens, kinds)

    return rows


class Model(NamedTuple):
    """``table[row]`` holds log10 of the probability of each symbol; ``row`` is found by the last ``order`` symbols."""

    order: int
    code: np.ndarray  # symbol to its number in contexts; the last number stands for symbols no context has
    rows: np.ndarray
    table: np.ndarray


def _dense(keys: np.ndarray, contexts: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of all symbols in some of the sorted ``contexts``."""
    out = np.zeros((len(keys), SYMBOLS))
    first, last = np.searchsorted(grams >> BITS, keys), np.searchsorted(grams >> BITS, keys, side="right")
    n = last - first
    place = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    out[np.repeat(np.arange(len(keys)), n), grams[place] & ((1 << BITS) - 1)] = counts[place]
    return out


def costs(keys: np.ndarray, order: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probability of every symbol in each context, by escapes and exclusion down to order -1."""
    n = len(keys)
    p, left, excluded = np.zeros((n, SYMBOLS)), np.ones((n, 1)), np.zeros((n, SYMBOLS), bool)
    for k in range(order, -1, -1):
        seen = _dense(keys & ((1 << (BITS * k)) - 1), *levels[k])
        allowed = (seen > 0) & ~excluded
        total = (seen * allowed).sum(axis=1, keepdims=True)
        kinds = allowed.sum(axis=1, keepdims=True)
        excluded |= seen > 0
        kinds = np.where(excluded.all(axis=1, keepdims=True), 0, kinds)  # nothing to escape to
        whole = np.maximum(total + kinds, 1)
        p += np.where(allowed, left * seen / whole, 0)
        left = np.where(total > 0, left * kinds / whole, left)
    p += np.where(excluded, 0, left / np.maximum(SYMBOLS - excluded.sum(axis=1, keepdims=True), 1))
    return np.log10(p).astype(np.float32)


def build(order: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """The costs of a small model in one table. ``levels[k]``: kept contexts of k symbols, and the runs of k + 1 symbols in them with their counts, all ascending."""
    used = np.unique(np.concatenate([np.zeros(0, np.int64), *((c >> (BITS * j)) & ((1 << BITS) - 1) for k, (c, _, _) in enumerate(levels) for j in range(k))]))
    code = np.full(SYMBOLS, len(used), np.int64)
    code[used] = np.arange(len(used))
    width = len(used) + 1
    rows = np.zeros((width,) * order, np.int32)
    tables, at = [], 0
    for k, (contexts, _, _) in enumerate(levels):
        step = 2048
        tables += [costs(contexts[i : i + step], k, levels) for i in range(0, len(contexts), step)]
        # a context is the row of all longer ones until those set their own
        last = tuple(code[(contexts >> (BITS * j)) & ((1 << BITS) - 1)] for j in range(k - 1, -1, -1))
        rows[(..., *last)] = np.arange(at, at + len(contexts), dtype=np.int32)
        at += len(contexts)
    return Model(order, code, rows.ravel(), np.concatenate(tables))


class Sums(NamedTuple):
    """Of some runs of one length: training count, sum and kinds of their context, and the cost below it.

    ``deep`` is log10 of the last symbol's probability where the context has not seen it, without
    the escape from that context.
    """

    n: np.ndarray
    whole: np.ndarray
    kinds: np.ndarray
    deep: np.ndarray

    def at(self, place: np.ndarray) -> "Sums":
        return Sums(*(a[place] for a in self))


def next_sums(grams: np.ndarray, n: np.ndarray, low: Sums | None, least: float) -> Sums:
    """Sums of ascending runs; ``low`` are those of the same runs without their first symbol."""
    context = grams >> np.uint64(BITS)
    head = np.flatnonzero(np.concatenate((np.ones(min(len(grams), 1), bool), context[1:] != context[:-1])))
    size = np.diff(np.append(head, len(grams)))
    total = lambda x: np.repeat(np.add.reduceat(x, head), size) if len(head) else x
    whole, kinds = total(n), total((n > 0).astype(np.int64))
    if low is None:
        return Sums(n, whole, kinds, -np.log10(np.maximum(SYMBOLS - kinds, 1)))
    taken = total(np.where(n > 0, low.n, 0))
    if least:
        lost = whole < least
        n, whole, kinds, taken = (np.where(lost, 0, x) for x in (n, whole, kinds, taken))
    left = low.whole - taken
    escapes = np.where(low.kinds == SYMBOLS, 0, low.kinds - kinds)
    with np.errstate(divide="ignore", invalid="ignore"):
        seen, escaped = np.log10(low.n / (left + escapes)), np.log10(escapes / (left + escapes)) + low.deep
    return Sums(n, whole, kinds, np.where(left == 0, low.deep, np.where(low.n > 0, seen, escaped)))


def last_cost(s: Sums) -> np.ndarray:
    escapes = np.where(s.kinds == SYMBOLS, 0, s.kinds)
    whole = s.whole + escapes
    with np.errstate(divide="ignore", invalid="ignore"):
        known, escaped = np.log10(s.n / whole), np.log10(escapes / whole) + s.deep
    return np.where(s.n > 0, known, np.where(s.whole > 0, escaped, s.deep))


def short_sums(counts: np.ndarray, placing: int, least: float) -> Sums:
    """Sums of all runs of ``placing`` symbols, by their number, from their counts."""
    sums = None
    for k in range(placing):
        grams = np.arange(1 << (BITS * (k + 1)), dtype=np.uint64)
        n = counts.reshape(-1, len(grams)).sum(axis=0)
        sums = next_sums(grams, n, None if sums is None else sums.at((grams & np.uint64((1 << (BITS * k)) - 1)).astype(np.int64)), least)
    return sums


def run_costs(runs: np.ndarray, n: np.ndarray, order: int, short: Sums, least: float = 0.0) -> np.ndarray:
    """log10 of the probability of the last symbol of ascending runs of order + 1 symbols.

    All runs of their last ``min(PLACING, order)`` context symbols must be there.
    """
    placing = min(PLACING, order)
    below, sums = None, short
    for k in range(placing, order + 1):
        grams, place = np.unique(runs & np.uint64((1 << (BITS * (k + 1))) - 1), return_inverse=True)
        counts = np.bincount(place, weights=n, minlength=len(grams)).astype(np.int64)
        shorter = grams & np.uint64((1 << (BITS * k)) - 1)
        at = shorter.astype(np.int64) if below is None else np.searchsorted(below, shorter)
        below, sums = grams, next_sums(grams, counts, sums.at(at), least)
    return last_cost(sums)


ANSWERS = "chunk long, kind string, data binary, n long, v long"


def _answer(chunk: int, kind: str, data: bytes | None, n: int | None = None, v: int | None = None) -> pa.RecordBatch:
    columns = [pa.array([chunk], pa.int64()), pa.array([kind], pa.string()), pa.array([data], pa.binary()), pa.array([n], pa.int64()), pa.array([v], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "kind", "data", "n", "v"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """Chunks and keys of the packed arrays of a part, the distinct keys, and their summed counts."""
    chunks, keys, counts = [], [], []
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            k, c = unpack_pairs(data, np.uint32)
            chunks.append(chunk)
            keys.append(k)
            counts.append(c.astype(np.int64))
    distinct, n = merge_counts(list(zip(keys, counts, strict=True))) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return chunks, keys, distinct, n


def _cost_maker(order: int, short: Sums, least: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, keys, distinct, n = _gathered(batches)
        cost = run_costs(distinct, n, order, short, least).astype(np.float32)
        for chunk, own in zip(chunks, keys, strict=True):
            yield _answer(chunk, RUN, pack_pairs(own, cost[np.searchsorted(distinct, own)]))

    return rows


def _token_maker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks, keys, distinct, n = _gathered(batches)
    for chunk, own in zip(chunks, keys, strict=True):
        yield _answer(chunk, TOKEN, pack_pairs(own, n[np.searchsorted(distinct, own)]))
    yield _answer(-1, TOTAL, None, int(n.sum()), int((n > 0).sum()))


def _short_counter(placing: int):
    """Training counts of runs of ``placing`` symbols, a bounded table of each task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << (BITS * placing), np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                keys, counts = unpack_pairs(data, np.uint32)
                total += np.bincount((keys & np.uint64(len(total) - 1)).astype(np.int64), counts, len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    return rows


SCORES = "n_tokens long, n_known long, logs double, score double"


def _scored(order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows by chunk, its packed answers before its texts, to the numbers of each text."""

    def sorted_pairs(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, values = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        at = np.argsort(keys)
        return keys[at], values[at]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, known = None, {}, {}
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            is_text = batch.column("kind").is_null().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((chunks[1:] != chunks[:-1]) | (is_text[1:] != is_text[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(chunks)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if chunks[a] != chunk:
                    chunk, parts, known = chunks[a], {RUN: [], TOKEN: []}, {}
                if not is_text[a]:
                    for kind, data in zip(part.column("kind").to_pylist(), part.column("data").to_pylist(), strict=True):
                        parts[kind].append(unpack_pairs(data, np.float32 if kind == RUN else np.int64))
                    continue
                if not known:
                    known, parts = {k: sorted_pairs(v) for k, v in parts.items()}, {}
                for block in blocks(part.column("text")):
                    symbols, start, at = symbol_runs(block, order)
                    keys, place = np.unique(packed(symbols, at, order).view(np.uint64), return_inverse=True)
                    cost = np.zeros(len(symbols))
                    cost[at] = known[RUN][1][np.searchsorted(known[RUN][0], keys)].astype(float)[place]
                    h, row = token_hashes(block)
                    c = known[TOKEN][1][np.searchsorted(known[TOKEN][0], h)]
                    per_row = lambda x: np.bincount(row, x, block.rows)  # noqa: B023, E731
                    own = [part.column(n).slice(block.first, block.rows) for n in ("__id", "__hash")]
                    numbers = [pa.array(per_row(x).astype(np.int64)) for x in (None, (c > 0).astype(float))]
                    scores = pa.array(per_row(np.log10(c + 1.0))), pa.array(np.add.reduceat(cost, start[:-1]))
                    yield pa.RecordBatch.from_arrays([*own, *numbers, *scores], names=["__id", "__hash", "n_tokens", "n_known", "logs", "score"])

    return rows


def model_scores(keyed: DataFrame, order: int = ORDER, min_share: float = MIN_SHARE) -> DataFrame:
    """(__id, __hash, __held, text) to one row per (__id, __hash): the tokens, their base score, and log10 of the text's probability."""
    if order < 1:
        raise ValueError("order must be 1 at least")
    bounded_batches(keyed.sparkSession)
    kind = keyed.schema["__id"].dataType.simpleString()
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    chunks = materialise(keyed.mapInArrow(_chunks(order, parts), f"chunk long, __id {kind}, __hash long, text string, kind string, part int, data binary"), "chunks")

    placing = min(PLACING, order)
    counted = chunks.where(F.col("kind") == RUN).select("data").mapInArrow(_short_counter(placing), "gram long, n long")
    counts = np.zeros(1 << (BITS * placing), np.int64)
    for row in counted.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[row.gram] = row.n
    least = int(counts.sum()) * min_share

    def answered(of: str, make) -> DataFrame:
        own = chunks.where(F.col("kind") == of).select("chunk", "data", "part").repartitionById(parts, F.col("part"))
        return own.select("chunk", "data").mapInArrow(make, ANSWERS)

    costs = answered(RUN, _cost_maker(order, short_sums(counts, placing, least), least))
    answers = materialise(costs.unionByName(answered(TOKEN, _token_maker)), "answers")
    total, distinct = answers.where(F.col("kind") == TOTAL).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    texts = chunks.where(F.col("kind").isNull()).select("chunk", "__id", "__hash", "text")
    own = answers.where(F.col("chunk") >= 0).select("chunk", "kind", "data")
    rows = texts.unionByName(own, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.asc_nulls_last("kind"))
    scores = rows.mapInArrow(_scored(order), f"__id {kind}, __hash long, {SCORES}")
    one = scores.groupBy("__id", "__hash").agg(*(F.first(c).alias(c) for c in ("n_tokens", "n_known", "logs", "score")))
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return one.select("__id", "__hash", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")


def score_texts(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = ORDER, min_share: float = MIN_SHARE
) -> DataFrame:
    """Add ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``."""
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    own = F.col(text).cast("string")
    keyed = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__hash"), held.alias("__held"), own.alias("text"))
    added = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    rows = docs.withColumns({"__id": F.col(doc_id), "__hash": F.xxhash64(text), "__held": held})
    scores = model_scores(keyed, order, min_share).withColumnsRenamed({"__id": "__of", "__hash": "__of_hash", "score": "__score"})
    same = F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__hash") == F.col("__of_hash"))
    return rows.drop(*added).join(scores, same).select(
        *(F.col(c) for c in docs.columns if c not in added),
        F.col("__held").alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        F.col("__score").alias("score"),
    )
