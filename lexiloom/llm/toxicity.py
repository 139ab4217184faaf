"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its hashed words, word pairs, and pairs with one word between.
Training keeps two numbers for each coordinate (z and n), so each has a rate of its
own, and an L1 term leaves most weights exactly zero. The term grows with the
square root of the number of examples, as chance does.

The fit reads at most about ``SAMPLE`` labelled rows, chosen by a hash of the id,
and only coordinates that ``MIN_TEXTS`` of them share; that bounded sample is one
task, because an online method has one order. What goes to the scoring tasks is
the list of weights that are not zero, at most ``2 ** BITS`` of them. Scoring is
row-local over whole texts.

Defined results: a null, empty or wordless text scores the bias alone; an id with
several labels counts as 1 if any is 1; null labels, and labels of ids without a
row, are not examples; an id with several rows is one example, the text of least
hash. Without any example the score is the prior 0.01 everywhere.
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.blocks import ALPHANUMERIC, Block, blocks, bounded_batches, lists, mix, runs_hash, words
from lexiloom.session import materialise

BITS = 20
SAMPLE = 16_384
MIN_TEXTS = 5
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1.5, 0.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
BIAS = -1


def is_held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def coordinates(block: Block, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every word, pair and skip-pair; repeats included."""
    w = words(block, ALPHANUMERIC)
    row = w.rows().astype(np.int32)
    h = runs_hash(block.data, w.start, w.end)
    rows, found = [row], [h]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = np.flatnonzero(row[gap:] == row[:-gap])
        rows.append(row[same])
        found.append(mix(h[same] * np.uint64(salt) + h[same + gap]))
    shift = np.uint64(64 - bits)
    return np.concatenate(rows), np.concatenate([(f >> shift).astype(np.int32) for f in found])


def _coordinate_sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        values, counts = [], []
        for block in blocks(texts):
            row, at = coordinates(block)
            key = np.unique((row.astype(np.int64) << BITS) | at)
            values.append((key & ((1 << BITS) - 1)).astype(np.int32))
            counts.append(np.bincount(key >> BITS, minlength=block.rows))
        flat = np.concatenate(values) if values else np.zeros(0, np.int32)
        yield lists(pa.array(flat, pa.int32()), np.concatenate(counts) if counts else np.zeros(0, np.int64))


class Model(NamedTuple):
    at: np.ndarray
    weight: np.ndarray
    bias: float


def ftrl(rows: list[np.ndarray], labels: np.ndarray, at: np.ndarray, offset: float, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    """Weights of the coordinates ``at`` (ascending), and last the bias, which bears no L1 penalty."""
    bias = len(at)
    z, n, penalty = np.zeros(bias + 1), np.zeros(bias + 1), np.append(np.full(bias, l1), 0.0)

    def weights(i) -> np.ndarray:
        return -np.sign(z[i]) * np.maximum(np.abs(z[i]) - penalty[i], 0) / ((beta + np.sqrt(n[i])) / alpha + l2)

    places = [np.append(np.searchsorted(at, r), bias) for r in rows]
    for _ in range(epochs):
        for i, label in zip(places, labels, strict=True):
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + offset, -35, 35))) - label
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange(bias + 1))


def training_rows(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, sample: int) -> DataFrame:
    """(order, label, coordinates) of about ``sample`` labelled texts that are not held out."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~is_held_out(doc_id, FOLDS, HELD_OUT))
        .groupBy(F.col(doc_id).alias("__id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    n = known.count()
    if n > sample:
        # a hash is below the bound for sample / n of the ids: what is broadcast does not grow with the table
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 40)) < int((1 << 40) * sample / n))
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text"))
    # one text for each id: an id that a third of the rows share does not widen the sample
    rows = texts.join(F.broadcast(known), "__id").groupBy("__id").agg(
        F.min_by("__text", F.xxhash64("__text")).alias("__text"), F.first("label").alias("label")
    )
    found = F.arrow_udf(_coordinate_sets, "array<int>")("__text")
    return rows.select(F.xxhash64("__id", "__text").alias("order"), "label", found.alias("coordinates"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    sample: int = SAMPLE,
    epochs: int = EPOCHS,
    alpha: float = ALPHA,
    beta: float = BETA,
    l1: float = L1,
    l2: float = L2,
) -> Model:
    bounded_batches(docs.sparkSession)
    rows = materialise(training_rows(docs, labels, text, doc_id, label, sample), "toxic-training")
    total, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = (positive + 0.01) / (total + 1)
    offset = float(np.log(prior / (1 - prior)))
    l1 *= max(1.0, np.sqrt(total * prior * (1 - prior)))  # chance alone moves a common coordinate's z about that far

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, targets, sizes, flat = [], [], [], []
        held = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            orders.append(batch.column("order").to_numpy())
            targets.append(batch.column("label").to_numpy())
            own = batch.column("coordinates")
            sizes.append(np.diff(own.offsets.to_numpy()))
            flat.append(own.flatten().to_numpy().astype(np.int32))
            held += np.bincount(flat[-1], minlength=1 << BITS).astype(np.int32)
        # a coordinate's z moves by less than 1 for each of its examples and epochs: the rest cannot pass the L1 term
        keep = (held >= MIN_TEXTS) & (held * epochs > l1)
        at = np.flatnonzero(keep).astype(np.int32)
        rows: list[np.ndarray] = []
        for n, own in zip(sizes, flat, strict=True):
            rows += [r[keep[r]] for r in np.split(own, np.cumsum(n)[:-1])]
        flat.clear()
        turn = np.argsort(np.concatenate(orders), kind="stable") if orders else []
        label = np.concatenate(targets)[turn] if orders else np.zeros(0)
        weight = ftrl([rows[i] for i in turn], label, at, offset, epochs, alpha, beta, l1, l2)
        used = np.append(np.flatnonzero(weight[:-1]), len(at))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, BIAS)[used], pa.int32()), pa.array(weight[used])], names=["at", "weight"])

    # an online method has an order of examples: one task reads the bounded sample
    found = rows.coalesce(1).mapInArrow(train, "at int, weight double").collect()
    bias = sum(r.weight for r in found if r.at == BIAS)
    found = sorted((r.at, r.weight) for r in found if r.at != BIAS)
    return Model(np.array([r[0] for r in found], np.int32), np.array([r[1] for r in found], np.float32), offset + bias)


def block_scores(block: Block, dense: np.ndarray, bias: float) -> np.ndarray:
    row, at = coordinates(block)
    used = np.flatnonzero(dense[at])
    key = np.unique((row[used].astype(np.int64) << BITS) | at[used])
    total = np.bincount(key >> BITS, weights=dense[key & ((1 << BITS) - 1)], minlength=block.rows)
    return 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))


def scorer(docs: DataFrame, model: Model) -> Callable[[str | Column], Column]:
    """Column function: text to the probability of label 1."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[own.at] = own.weight
        for texts in batches:
            parts = [block_scores(b, dense, own.bias) for b in blocks(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return F.arrow_udf(score, "double")


def score_texts(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """Add ``held_out``, ``score`` and ``predicted``; the labels of held-out ids are never read."""
    score = scorer(docs, fit(docs, labels, text, doc_id, **options))
    out = docs.withColumns({"__held": is_held_out(doc_id, FOLDS, HELD_OUT), "__score": score(F.col(text).cast("string"))})
    return out.select(
        *(F.col(c) for c in docs.columns if c not in ("held_out", "score", "predicted")),
        F.col("__held").alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """Rows that are not predicted toxic, with the columns they had."""
    score = scorer(docs, fit(docs, labels, text, doc_id, **options))
    return docs.where(score(F.col(text).cast("string")) < THRESHOLD)
