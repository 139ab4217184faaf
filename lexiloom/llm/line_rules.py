"""Quality rules: per-text counts, and lines that too many documents of one host share.

Per text: words, their characters, symbols, lines equal to an earlier line, and
words inside 5-word windows that occur twice or more. Across documents: every line is
normalised (lower case, single spaces) and hashed; a line's count is the number of
distinct documents (ids) of its host that have it. Lines in at least ``min_docs``
documents that are in more than ``max_share`` of the documents of their host, or in more
than ``max_docs`` documents, are removed; a document that loses more than ``max_lost`` of
its words, or keeps fewer than ``min_words``, is rejected.

How: lines leave a task once per document and are written once, placed by (host, line,
document), so a line that a third of all rows hold is spread over all tasks. Counts of a
line are summed per task before they meet. Decisions come back by (host, document, text
hash), joined without any broadcast that the planner did not measure.

Defined results: null, empty and blank texts have no words and lines, fail the base
rule, and are not kept; null hosts are one host; null ids are one document of each host;
rows with the same id are one document, each judged by its own text; repeated rows get the
same row; a very long text is a block of its own; columns of ``docs`` named like results
give way to them.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.blocks import BASE, LOWER, NOT_SPACE, Block, Words, blocks, bounded_batches, byte_set, lists, mix, per_row, runs_hash, words
from lexiloom.session import materialise

SYMBOLS = byte_set(*((ord(c), ord(c)) for c in "#*$%&|<>"))
REPEAT_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SHARE, MIN_DOCS, MAX_DOCS, MAX_LOST = 0.02, 10, 500, 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS_SQL = f"struct<{','.join(f'{c}:bigint' for c in COUNTS)}>"


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of keys that occur twice or more, and of those that are not the first."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    ordered = keys[order]
    same[1:] = ordered[1:] == ordered[:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same
    same[:-1] |= same[1:]
    any_[order] = same
    return any_, later


def spread(rows: np.ndarray) -> np.ndarray:
    return mix((rows.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))


def lines_of(block: Block) -> Words:
    """The parts of each text between line feeds, empty ones as well."""
    feeds = np.flatnonzero(block.data == 10)
    start = np.sort(np.concatenate((block.offsets[:-1], feeds + 1)), kind="stable")
    end = np.sort(np.concatenate((block.offsets[1:], feeds)), kind="stable")
    before = np.searchsorted(feeds, block.offsets)
    return Words(start, end, before + np.arange(len(block.offsets)))


def block_counts(block: Block) -> list[np.ndarray]:
    w = words(block, NOT_SPACE)
    row = w.rows()
    # repeated windows
    h = runs_hash(block.data, w.start, w.end)
    at = np.arange(max(len(h) - REPEAT_WINDOW + 1, 0))
    at = at[row[at] == row[at + REPEAT_WINDOW - 1]] if len(at) else at
    key = spread(row[at])
    for k in range(REPEAT_WINDOW):
        key = mix(key * np.uint64(BASE) + h[at + k])
    twice = at[repeated(key)[0]]
    change = np.zeros(len(h) + 1, np.int64)
    change[twice] += 1
    change[twice + REPEAT_WINDOW] -= 1
    covered = np.cumsum(change[:-1]) > 0
    # repeated lines
    lines = lines_of(block)
    line_row = lines.rows()
    inside = NOT_SPACE[block.data]
    held = np.concatenate(([0], np.cumsum(inside)))
    full = np.flatnonzero(held[lines.end] > held[lines.start])
    line_hash = mix(spread(line_row[full]) ^ runs_hash(block.data, lines.start[full], lines.end[full]))
    again = np.bincount(line_row[full], weights=repeated(line_hash)[1], minlength=block.rows).astype(np.int64)
    chars = per_row(inside & ((block.data & 0xC0) != 0x80), block.offsets)
    return [np.diff(w.bounds), chars, per_row(SYMBOLS[block.data], block.offsets), again, per_row(covered, w.bounds)]


def _counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        done = [block_counts(b) for b in blocks(texts, lower=False)]
        columns = [np.concatenate(c) if done else np.zeros(0, np.int64) for c in zip(*done, strict=True)] or [np.zeros(0, np.int64)] * len(COUNTS)
        yield pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=list(COUNTS))


def text_counts(text: str | Column) -> Column:
    return F.arrow_udf(_counts, COUNTS_SQL)(text)


def normal_lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Row, hash and number of words of every line with a word, and all lines."""
    lines = lines_of(block)
    w = words(block, NOT_SPACE)
    first = np.searchsorted(w.start, lines.start)
    last = np.searchsorted(w.start, lines.end)
    return lines.rows(), runs_hash(runs_hash(block.data, w.start, w.end), first, last), last - first, lines


def _lines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each distinct line of a text once, with the words of all its repeats."""
    for texts in batches:
        hashes, held, counts = [], [], []
        for block in blocks(texts):
            row, h, n, _ = normal_lines(block)
            full = n > 0
            row, h, n = row[full], h[full], n[full]
            order = np.lexsort((h, row))
            row, h, n = row[order], h[order], n[order]
            head = np.ones(len(h), bool)
            head[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            head = np.flatnonzero(head)
            hashes.append(h[head])
            held.append(np.add.reduceat(n, head) if len(head) else n)
            counts.append(np.bincount(row[head], minlength=block.rows))
        join = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, held, counts)]
        values = pa.StructArray.from_arrays([pa.array(join[0].view(np.int64)), pa.array(join[1].astype(np.int64))], names=["line", "words"])
        yield lists(values, join[2])


def text_lines(text: str | Column) -> Column:
    return F.arrow_udf(_lines, "array<struct<line:bigint,words:bigint>>")(text)


def _without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, removed in batches:
        out = []
        for block in blocks(texts, lower=False):
            row, h, _, lines = normal_lines(block._replace(data=LOWER[block.data]))
            gone = [set(x or ()) for x in removed.slice(block.first, block.rows).to_pylist()]
            keep = [v not in gone[r] for r, v in zip(row.tolist(), h.view(np.int64).tolist(), strict=True)]
            raw = block.data.tobytes()
            for r in range(block.rows):
                own = range(int(lines.bounds[r]), int(lines.bounds[r + 1]))
                out.append(b"\n".join(raw[lines.start[i] : lines.end[i]] for i in own if keep[i]))
        yield pa.array(out, pa.binary()).cast(pa.string())


def without_lines(text: str | Column, removed: str | Column) -> Column:
    """The text without lines whose hashes are in ``removed`` (null: none)."""
    return F.arrow_udf(_without, "string")(text, removed)


def frequent_lines(docs: DataFrame, key: str, text: str, host: str, max_share: float, min_docs: int, max_docs: int) -> DataFrame:
    """Lines of documents that are too frequent at their host: (__host, __doc, __text, line, words)."""
    bounded_batches(docs.sparkSession)
    keyed = docs.select(
        F.xxhash64(host).alias("__host"), F.xxhash64(key).alias("__doc"), F.xxhash64(text).alias("__text"), F.col(text).cast("string").alias("__own")
    )
    lines = keyed.select("__host", "__doc", "__text", F.inline(text_lines("__own"))).repartition("__host", "line", "__doc")
    lines = materialise(lines.groupBy("__host", "line", "__doc", "__text").agg(F.first("words").alias("words")), "lines")
    documents = keyed.select("__host", "__doc").distinct().groupBy("__host").agg(F.count("*").alias("documents"))
    holders = lines.select("__host", "line", "__doc").distinct().groupBy("__host", "line").agg(F.count("*").alias("holders"))
    counted = holders.where(F.col("holders") >= min_docs).join(documents, "__host")
    above = (F.col("holders") > F.col("documents") * max_share) | (F.col("holders") > max_docs)
    return lines.join(counted.where(above).select("__host", "line"), ["__host", "line"])


def line_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "host",
    key: str = "doc_id",
    max_share: float = MAX_SHARE,
    min_docs: int = MIN_DOCS,
    max_docs: int = MAX_DOCS,
    max_lost: float = MAX_LOST,
) -> DataFrame:
    """Add the counts, ``base_failed``, ``lost_words``, ``kept`` and ``clean_text`` (lines above the limit removed)."""
    added = (*COUNTS, "base_failed", "lost_words", "kept", "clean_text")
    found = frequent_lines(docs, key, text, host, max_share, min_docs, max_docs)
    place = ["__host", "__doc", "__text"]
    lost = found.groupBy(*place).agg(F.sum("words").alias("__lost"), F.collect_list("line").alias("__lines"))
    own = F.col(text).cast("string")
    rows = docs.withColumns(
        {"__host": F.xxhash64(host), "__doc": F.xxhash64(key), "__text": F.xxhash64(text), "__own": own, "__counts": text_counts(own)}
    )
    n = F.col("__counts.n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("__counts.n_repeat_words") > MAX_REPEAT_PERCENT * n)
    gone = F.coalesce("__lost", F.lit(0).cast("bigint"))
    return rows.join(lost, place, "left").select(
        *(F.col(c) for c in docs.columns if c not in added),
        *(F.col(f"__counts.{c}").alias(c) for c in COUNTS),
        failed.alias("base_failed"),
        gone.alias("lost_words"),
        (~failed & (gone <= n * max_lost) & (n - gone >= MIN_WORDS)).alias("kept"),
        without_lines("__own", "__lines").alias("clean_text"),
    )
