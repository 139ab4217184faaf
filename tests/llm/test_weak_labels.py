"""EM on votes with known accuracies, the classifier against labels it never saw, and edge rows."""

import numpy as np

from lexiloom.llm import weak_labels

FOLDER = "/root/testdata/sf0.01"


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(40_000) < 0.8  # good
    cast = np.array([[[0.6, 0.2, 0.2], [0.02, 0.08, 0.9]], [[0.5, 0.3, 0.2], [0.03, 0.3, 0.67]], [[0.7, 0.1, 0.2], [0.01, 0.1, 0.89]], [[0.3, 0.6, 0.1], [0.01, 0.59, 0.4]]])
    drawn = np.stack([[rng.choice(3, p=c[int(t)]) for t in truth] for c in cast], axis=1)
    patterns, counts = np.unique(drawn, axis=0, return_counts=True)
    found = weak_labels.estimate(patterns, counts.astype(float))
    assert abs(found.share[1] - 0.8) < 0.02
    assert np.abs(found.cast - cast.transpose(1, 0, 2)).max() < 0.03
    assert ((found.posterior(drawn) > 0.5) == truth).mean() > 0.95


def test_labels_that_were_never_read(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumnRenamed("source", "good")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = weak_labels.score_quality(docs).join(labels, "doc_id").toPandas()
    assert (got.good == (got.quality_score >= 0.5)).all()
    assert got.good[got.quality == 1].mean() > 0.98
    assert got.good[got.quality == 0].mean() < 0.1


def test_blocks_do_not_matter():
    import pyarrow as pa

    from lexiloom.llm.blocks import blocks

    texts = ["Ha Ha Ha | ## x", None, "", "A!! B!! C!!", "plain words, and so on. " * 4, "é ÉÉ 9a"]
    votes, found = [], []
    for most in (1, 9, 1000):
        votes.append(np.concatenate([weak_labels.block_votes(b) for b in blocks(pa.array(texts), lower=False, most=most)]))
        found.append(np.concatenate([weak_labels.block_features(b) for b in blocks(pa.array(texts), lower=False, most=most)]))
    assert all(np.array_equal(votes[0], v) for v in votes) and all(np.allclose(found[0], f) for f in found)
    assert (votes[0][1:3] == ord("0")).all()


def test_edge_rows(spark):
    good = "This is a plain text, with words and marks. It goes on for a while, and then it ends here."
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, good), (4, good)], "doc_id long, text string")
    got = {(r.doc_id, r.text): r for r in weak_labels.score_quality(df).collect()}
    assert all(not got[k].good and got[k].quality_score == 0 for k in ((1, None), (2, ""), (3, " \n")))
    assert weak_labels.reject_poor(df).columns == df.columns
    assert weak_labels.score_quality(df.where("false")).count() == 0
