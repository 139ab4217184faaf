"""Quality classifier from weak labels: heuristic labellers, EM, a hashed linear scorer.

Overlapping labellers vote bad, good or nothing on a text. Their accuracies are not
known; expectation-maximisation estimates, for each labeller, how often it casts
each vote on good and on bad texts, together with the share of bad texts. Votes are
counted by pattern in Spark, and there are at most ``3 ** labellers`` patterns at any
corpus size, so EM runs over all texts in a few numbers. The posteriors of a bounded
sample of distinct texts (``SAMPLE``, by hash) are the soft targets of a logistic scorer over hashed
word shapes and pairs of shapes, which then judges every text. No label is read.

Defined results: null, empty and wordless texts are bad by rule (score 0); repeated
rows all count and get the same score; without any text the scorer says 0.5.
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.blocks import NOT_SPACE, Block, Words, blocks, bounded_batches, byte_set, mix, per_row, runs_hash, words
from lexiloom.session import materialise

SAMPLE = 16_384
BUCKETS = 512
THRESHOLD = 0.5
EM_ROUNDS = 200
BAD, NOTHING, GOOD = 0, 1, 2

SYMBOL = byte_set(*((ord(c), ord(c)) for c in "#$%&*<>{}\\^~=_@"))
UPPER, LOWER_CASE, DIGITS = byte_set((65, 90)), byte_set((97, 122), (0xC3, 0xFF)), byte_set((48, 57))
MARK = byte_set((33, 47), (58, 64), (91, 96), (123, 126))
#: what a byte becomes in the shape of a word: capital, letter, digit, or itself
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[0x80:], SHAPE[48:58] = ord("X"), ord("x"), ord("x"), ord("9")

#: name, lowest share that is bad, highest share that is good; shares between say nothing
SHARES = (
    ("symbols", 0.2, 0.03),  # words with a symbol
    ("shouting", 0.3, 0.05),  # words of capitals
    ("exclaimed", 0.2, 0.03),  # words that end in two exclamation marks
    ("bars", 0.1, 0.01),  # words that are one mark
    ("stutter", 0.3, 0.08),  # words equal to the one before
    ("chant", 0.2, 0.04),  # words equal to the two before
    ("doubled", 0.2, 0.03),  # words with a mark twice in a row
    ("odd", 0.3, 0.1),  # words without a letter, or with several marks
)
#: name, highest value that is bad, lowest that is good
LEVELS = (("length", 3, 12), ("variety", 0.15, 0.3), ("sentences", 0.0, 0.03))
LABELLERS = tuple(n for n, *_ in SHARES + LEVELS)


def per_run(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each ``start[i]:end[i]``."""
    held = np.concatenate(([0], np.cumsum(flags)))
    return held[end] - held[start]


def word_flags(block: Block, w: Words, table: np.ndarray) -> np.ndarray:
    """Words that hold a byte of ``table``."""
    return per_run(table[block.data], w.start, w.end) > 0


def block_votes(block: Block) -> np.ndarray:
    """Votes of each text as one string of digits: an array of bytes, a row for each text."""
    w = words(block, NOT_SPACE)
    row = w.rows()
    n = np.diff(w.bounds)
    safe = np.maximum(n, 1)
    h = runs_hash(block.data, w.start, w.end)
    size = w.end - w.start
    last = block.data[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    before = block.data[np.maximum(w.end - 2, 0)] if len(h) else last
    letter = word_flags(block, w, LOWER_CASE)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    first = np.ones(len(h), bool)
    first[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    marks = MARK[block.data]
    pair = np.zeros(len(marks), bool)
    pair[1:] = marks[1:] & (block.data[1:] == block.data[:-1])
    mark = (size == 1) & ((last == ord("|")) | SYMBOL[last])
    flags = {
        "symbols": word_flags(block, w, SYMBOL),
        "shouting": word_flags(block, w, UPPER) & ~letter & (size > 1),
        "exclaimed": (size > 2) & (last == 33) & (before == 33),
        "bars": mark,
        "stutter": same,
        "chant": same & np.concatenate(([False], same[:-1])),
        "doubled": per_run(pair, w.start + 1, w.end) > 0,
        "odd": ~(letter | word_flags(block, w, UPPER | DIGITS)) | (per_run(marks, w.start, w.end) > 1),
    }
    votes = np.full((block.rows, len(LABELLERS)), NOTHING, np.uint8)
    for k, (name, bad, good) in enumerate(SHARES):
        share = per_row(flags[name], w.bounds) / safe
        votes[share >= bad, k] = BAD
        votes[share <= good, k] = GOOD
    stops = per_row(np.isin(last, [ord(c) for c in ".?!,;:"]), w.bounds)
    # variety falls with length in any language: distinct words against the square root of a long text
    expected = np.minimum(safe, 30 * np.sqrt(safe))
    values = {"length": n, "variety": per_row(first, w.bounds) / expected, "sentences": stops / safe}
    for k, (name, bad, good) in enumerate(LEVELS, len(SHARES)):
        votes[values[name] <= bad, k] = BAD
        votes[values[name] >= good, k] = GOOD
    votes[n == 0] = BAD
    return votes + ord("0")


def _votes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    width = len(LABELLERS)
    for texts in batches:
        data = b"".join(block_votes(b).tobytes() for b in blocks(texts, lower=False))
        offsets = pa.py_buffer(np.arange(0, len(data) + 1, width, dtype=np.int32))
        yield pa.Array.from_buffers(pa.string(), len(data) // width, [None, offsets, pa.py_buffer(data)])


def votes(text: str | Column) -> Column:
    """One digit for each labeller: 0 bad, 1 nothing, 2 good."""
    return F.arrow_udf(_votes, "string")(text)


class Accuracies(NamedTuple):
    """``cast[c, j, v]``: how often labeller j casts vote v on class c (0 bad, 1 good)."""

    share: np.ndarray
    cast: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        log = np.log(self.share) + sum(np.log(self.cast[:, j, patterns[:, j]]).T for j in range(patterns.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> Accuracies:
    """EM over vote patterns; it starts from texts that nobody calls bad as mostly good."""
    good = np.where((patterns == BAD).any(axis=1), 0.2, 0.95)
    for _ in range(rounds):
        weight = np.stack((1 - good, good)) * counts
        cast = np.stack([[np.bincount(patterns[:, j], weights=w, minlength=3) for j in range(patterns.shape[1])] for w in weight]) + 0.5
        # a labeller is right more often than not: where its bad votes look otherwise, they say as little as no vote
        wrong = cast[0, :, BAD] < cast[1, :, BAD]
        cast[0, wrong, BAD] = cast[1, wrong, BAD]
        now = Accuracies((weight.sum(axis=1) + 1) / (counts.sum() + 2), cast / cast.sum(axis=2, keepdims=True))
        new = now.posterior(patterns)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return now


def fit_accuracies(voted: DataFrame, column: str = "votes") -> tuple[Accuracies, dict[str, float]]:
    """Accuracies and the posterior of every pattern, from all rows."""
    rows = sorted(tuple(r) for r in voted.groupBy(column).count().collect())  # at most 3 ** labellers
    if not rows:
        rows = [("1" * len(LABELLERS), 0)]
    patterns = np.array([[int(c) for c in r[0]] for r in rows])
    found = estimate(patterns, np.array([r[1] for r in rows], float))
    return found, dict(zip((r[0] for r in rows), found.posterior(patterns).tolist(), strict=True))


def block_features(block: Block) -> np.ndarray:
    """Share of each bucket among the word shapes and pairs of shapes of a text, and its length by powers of two."""
    w = words(block, NOT_SPACE)
    row = w.rows()
    h = runs_hash(block.data, w.start, w.end)
    # a shape has no two equal bytes in a row
    shape = SHAPE[block.data]
    inside = NOT_SPACE[block.data]
    keep = inside.copy()
    keep[1:] &= ~((shape[1:] == shape[:-1]) & inside[:-1])
    begins = np.zeros(len(inside) + 1, bool)
    begins[w.start] = True
    keep |= begins[:-1]
    at = np.concatenate(([0], np.cumsum(keep)))
    s = runs_hash(shape[keep], at[w.start], at[w.end])
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    s[same] = 7
    pair = np.flatnonzero(row[1:] == row[:-1])
    n = np.diff(w.bounds)
    length = mix(np.floor(np.log2(np.maximum(n, 1))).astype(np.uint64) + np.uint64(1000))
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    rows = np.concatenate((row, row[pair], np.arange(block.rows)))
    found = np.concatenate((mix(s), mix(mix(s[pair]) + s[pair + 1]), length)) >> shift
    weight = np.concatenate((1 / np.maximum(n, 1)[row], 1 / np.maximum(n, 1)[row[pair]], np.full(block.rows, 0.5)))
    return np.bincount(rows * BUCKETS + found.astype(np.int64), weights=weight, minlength=block.rows * BUCKETS).reshape(-1, BUCKETS)


def _examples(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Votes and features together: one Python worker for each task."""
    for texts in batches:
        (votes,) = _votes(iter([texts]))
        parts = [block_features(b).ravel() for b in blocks(texts, lower=False)]
        flat = np.concatenate(parts) if parts else np.zeros(0)
        found = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BUCKETS), pa.int32()), pa.array(flat))
        yield pa.StructArray.from_arrays([votes, found], names=["votes", "f"])


class Model(NamedTuple):
    weight: np.ndarray
    bias: float
    accuracies: Accuracies


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """All texts count for the accuracies; about ``sample`` of them, chosen by hash, train the scorer."""
    bounded_batches(docs.sparkSession)
    own = F.col(text).cast("string")
    voted = materialise(docs.select(votes(own).alias("votes")), "votes")
    accuracies, posterior = fit_accuracies(voted)
    n = voted.count()
    chosen = docs.select(own.alias("text"), F.xxhash64(text, F.lit("sample")).alias("__order")).where(
        F.pmod("__order", F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample / max(n, 1)))
    ).dropDuplicates(["__order"])  # copies of one text would widen the sample
    good = F.create_map(*(F.lit(x) for pair in posterior.items() for x in pair))[F.col("votes")]
    examples = F.arrow_udf(_examples, "struct<votes:string,f:array<double>>")("text")
    rows = chosen.select(examples.alias("e")).select("e.*").select("f", F.coalesce(good, F.lit(0.5)).alias("p"))
    # a soft target is two rows, one of each class
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w"))))
    train = rows.select(array_to_vector("f").alias("features"), sides.alias("s")).select("features", "s.label", "s.w").where("w > 0.001")
    train = materialise(train, "quality-training")
    if train.select("label").distinct().count() < 2:
        share = train.agg(F.avg("label")).first()[0]
        return Model(np.zeros(BUCKETS), 0.0 if share is None else (10.0 if share else -10.0), accuracies)
    model = LogisticRegression(weightCol="w", regParam=1e-6, maxIter=100).fit(train)
    return Model(model.coefficients.toArray(), float(model.intercept), accuracies)


def block_scores(block: Block, model: Model) -> np.ndarray:
    found = 1 / (1 + np.exp(-np.clip(block_features(block) @ model.weight + model.bias, -60, 60)))
    found[per_row(NOT_SPACE[block.data], block.offsets) == 0] = 0.0
    return found


def judge(docs: DataFrame, model: Model) -> Callable[[str | Column], Column]:
    """Column function: text to its votes and the probability that it is good."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            (votes,) = _votes(iter([texts]))
            parts = [block_scores(b, shared.value) for b in blocks(texts, lower=False)]
            yield pa.StructArray.from_arrays([votes, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["votes", "score"])

    return F.arrow_udf(score, "struct<votes:string,score:double>")


def scorer(docs: DataFrame, model: Model) -> Callable[[str | Column], Column]:
    """Column function: text to the probability that it is good."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [block_scores(b, shared.value) for b in blocks(texts, lower=False)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return F.arrow_udf(score, "double")


def score_quality(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Add ``votes``, ``quality_score`` and ``good``."""
    judged = judge(docs, fit(docs, text, sample))
    added = ("votes", "quality_score", "good")
    out = docs.withColumn("__judged", judged(F.col(text).cast("string")))
    return out.select(
        *(F.col(c) for c in docs.columns if c not in added),
        F.col("__judged.votes").alias("votes"),
        F.col("__judged.score").alias("quality_score"),
        (F.col("__judged.score") >= THRESHOLD).alias("good"),
    )


def reject_poor(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Rows whose text is good, with the columns they had."""
    score = scorer(docs, fit(docs, text, sample))
    return docs.where(score(F.col(text).cast("string")) >= THRESHOLD)
