"""FTRL against a scalar version, held-out quality, and edge rows."""

import math
import zlib

import numpy as np
import pyarrow as pa

from lexiloom.llm import toxicity
from lexiloom.llm.blocks import blocks

FOLDER = "/root/testdata/sf0.01"


def plain_ftrl(rows, labels, size, offset, epochs, alpha, beta, l1, l2):
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        lam = 0 if i == size else l1
        return 0.0 if abs(z[i]) <= lam else -(z[i] - math.copysign(lam, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for row, label in zip(rows, labels, strict=True):
            at = [*row, size]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-(sum(w) + offset))) - label
            for i, wi in zip(at, w, strict=True):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * wi
                n[i] += g * g
    return [weight(i) for i in range(size + 1)]


def test_ftrl_against_scalars():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(20, rng.integers(0, 8), replace=False)) for _ in range(60)]
    labels = rng.integers(0, 2, 60)
    args = (-1.0, 3, 0.7, 1.0, 0.8, 0.1)
    got = toxicity.ftrl(rows, labels, np.arange(20), *args)
    assert np.allclose(got, plain_ftrl(rows, labels, 20, *args))


def test_coordinates_stay_inside_a_text():
    texts = ["A b, c!", None, "", "b c", "x" * 9]
    whole = [set(), set(), set(), set(), set()]
    for block in blocks(pa.array(texts)):
        for r, c in zip(*(x.tolist() for x in toxicity.coordinates(block)), strict=True):
            whole[block.first + r].add(c)
    assert [len(s) for s in whole] == [6, 0, 0, 3, 1]
    assert whole[3] < whole[0]


def test_held_out_rows_are_scored_well_and_their_labels_not_read(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = toxicity.score_texts(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    held = got[got.held_out]
    rank = held.score.rank()
    positive = held.toxic.sum()
    auc = (rank[held.toxic == 1].sum() - positive * (positive + 1) / 2) / (positive * (len(held) - positive))
    assert auc > 0.85
    assert (held.predicted == held.toxic).mean() > 0.9
    flipped = labels.withColumn("toxic", toxicity.F.expr("CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - toxic ELSE toxic END"))
    again = toxicity.score_texts(docs, flipped).select("doc_id", "score").toPandas().set_index("doc_id").score
    first = got.set_index("doc_id").score
    assert np.allclose(first, again[first.index])


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "a b", 3.0), (1, "you idiot", 4.0), (1, "you idiot", 4.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    out = toxicity.score_texts(docs, labels)
    assert out.columns == ["doc_id", "text", "held_out", "score", "predicted"]
    assert out.count() == 5 and out.where("score BETWEEN 0 AND 1").count() == 5
    nothing = toxicity.score_texts(docs, labels.where("false")).toPandas()
    assert np.allclose(nothing.score, 0.01, atol=1e-3) and (nothing.predicted == 0).all()
    assert toxicity.score_texts(docs.where("false"), labels).count() == 0
    assert toxicity.reject_toxic(docs, labels.where("false")).columns == docs.columns
