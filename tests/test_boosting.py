"""Boosted trees against a plain numpy version that sorts every node anew."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lexiloom.plans import boosting, classifiers
from lexiloom.plans.features import Inputs
from lexiloom.session import scratch_path
from lexiloom.sources.results import load_model, save_model


def plain_margins(keys, x, y, rules, later):
    """Margins of the rows ``later`` after every round: exact greedy trees over all distinct values."""
    share = y.mean()
    base = np.log(share / (1 - share))
    own, other = np.full(len(x), base), np.full(len(later), base)
    out = [other.copy()]

    def grow(rows, other_rows, features, g, h, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if depth < rules.depth:
            for f in features:
                for cut in np.unique(x[:, f])[:-1]:
                    left = rows[x[rows, f] <= cut]
                    lg, lh = g[left].sum(), h[left].sum()
                    if lh < rules.min_child or total_h - lh < rules.min_child:
                        continue
                    gain = lg**2 / (lh + rules.penalty) + (total_g - lg) ** 2 / (total_h - lh + rules.penalty) - total_g**2 / (total_h + rules.penalty)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, cut))
        if best[1] is None:
            return [(rows, other_rows, -rules.step * total_g / (total_h + rules.penalty))]
        f, cut = best[1]
        return grow(rows[x[rows, f] <= cut], other_rows[later[other_rows, f] <= cut], features, g, h, depth + 1) + grow(
            rows[~(x[rows, f] <= cut)], other_rows[~(later[other_rows, f] <= cut)], features, g, h, depth + 1
        )

    for turn in range(rules.rounds):
        p = 1 / (1 + np.exp(-own))
        drawn = np.flatnonzero(boosting.drawn_rows(keys, rules.seed, turn, rules.rows))
        features = boosting.drawn_columns(x.shape[1], rules.seed, turn, rules.columns)
        # every row, drawn or not, moves by the leaf it falls into
        everything = np.vstack((later, x))
        later_all, later = later, everything
        leaves = grow(drawn, np.arange(len(everything)), features, p - y, p * (1 - p), 0)
        later = later_all
        moved = np.zeros(len(everything))
        for _, rows, value in leaves:
            moved[rows] = value
        other, own = other + moved[: len(later)], own + moved[len(later) :]
        out.append(other.copy())
    return np.array(out)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(230, 4)).round(2)
    x[:, 3] = rng.integers(0, 3, 230)
    y = (x[:, 0] * x[:, 1] + (x[:, 3] == 1) + rng.normal(size=230) * 0.4 > 0.3).astype(int)
    rows = [(i, int(t), [float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>").withColumn("features", array_to_vector("v"))
    return df.repartition(5).cache(), x, y


def hashes(df):
    keys = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    return np.array([keys[i] for i in range(len(keys))], np.int64).view(np.uint64)


@pytest.mark.parametrize(("share", "depth", "penalty", "min_child"), [(1.0, 2, 1.0, 1.0), (0.7, 3, 0.5, 2.0)])
def test_against_plain(table, monkeypatch, share, depth, penalty, min_child):
    monkeypatch.setattr(boosting, "KEPT", 3)
    df, x, y = table
    rules = boosting.Rules(8, depth, 0.3, share, 0.75, penalty, min_child, 7)
    trees = boosting.fit_trees(df.select(F.xxhash64("id"), "label", "v"), 4, rules)
    expected = plain_margins(hashes(df), x, y, rules, x)
    np.testing.assert_allclose(trees.margins(x, range(9)).T, expected, atol=2e-6)


def test_partitions_and_more_rounds_change_nothing(table):
    df, x, _ = table
    rows = df.select(F.xxhash64("id"), "label", "v")
    short = boosting.Rules(4, 3, 0.3, 0.8, 0.8, 1.0, 1.0, 1)
    a = boosting.fit_trees(rows, 4, short)
    b = boosting.fit_trees(rows.coalesce(1), 4, short)
    c = boosting.fit_trees(rows, 4, short._replace(rounds=6))
    np.testing.assert_array_equal(a.margins(x), b.margins(x))
    np.testing.assert_array_equal(a.margins(x)[:, 0], c.margins(x, (4, 6))[:, 0])


def test_shares_are_drawn():
    keys = boosting.mixed(np.arange(20000, dtype=np.uint64))
    drawn = [boosting.drawn_rows(keys, 42, turn, 0.8) for turn in range(5)]
    assert all(abs(d.mean() - 0.8) < 0.015 for d in drawn)
    assert abs((drawn[0] & drawn[1]).mean() - 0.64) < 0.02
    assert boosting.drawn_rows(keys, 1, 1, 1.0).mean() > 0.9999
    assert len(boosting.drawn_columns(10, 42, 0, 0.8)) == 8 and len(boosting.drawn_columns(1, 42, 0, 0.5)) == 1


def test_sketches_keep_the_quantiles(spark):
    df = spark.range(0, 60_000, 1, 7).select(F.array(F.col("id").cast("double"), (F.col("id") % 3).cast("double"), F.lit(1.0)).alias("v"))
    cuts = boosting.feature_cuts(df, 3, 16)
    assert len(cuts[0]) == 15 and np.abs(cuts[0] - np.arange(1, 16) * 3750).max() < 120
    assert cuts[1].tolist() == [0, 1] and cuts[2].tolist() == []


def test_odd_tables(spark):
    """NaN goes right, one class gives its share, a wide column is cut at 256 values, one row is a leaf."""
    nan = float("nan")
    rows = [(i, int(i % 4 == 0), [nan if i % 4 == 0 else float(i), float(i * 7 % 1000)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>").withColumn("features", array_to_vector("v"))
    stages = classifiers.boosted_trees(df, Inputs("id"), rounds=20, depth=2, step=0.3)
    scored = PipelineModel(stages).transform(df).select("label", "prediction", vector_to_array("probability")[1].alias("p")).collect()
    assert all(r.label == r.prediction and (r.p > 0.5) == (r.label == 1) for r in scored)
    same = df.withColumn("label", F.lit(1))
    p = PipelineModel(classifiers.boosted_trees(same, Inputs("id"), rounds=2, depth=2)).transform(same).select(vector_to_array("probability")[1]).first()[0]
    assert p > 0.99
    one = df.limit(1)
    assert PipelineModel(classifiers.boosted_trees(one, Inputs("id"), rounds=2, depth=2)).transform(one).count() == 1


def test_saved_trees(spark, table):
    df, _, _ = table
    model = PipelineModel(classifiers.boosted_trees(df, Inputs("id"), rounds=3, depth=2, step=0.3))
    path = scratch_path(spark, "trees")
    save_model(model, path)
    want, got = ({r.id: r.p for r in m.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()} for m in (model, load_model(path)))
    assert want == got and len(set(want.values())) > 3


def test_what_a_level_sends_does_not_grow_with_the_parts(spark):
    """Each task sends the sums of all its rows once, so there are no more tasks than cores."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, int(a > 0), [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))], "key long, label int, x array<double>")
    cuts = boosting.feature_cuts(rows.select("x"), 2, 16)
    blocks = boosting.blocks_of(rows.repartition(30), cuts, 0.0)
    spread = blocks.repartition(30)
    held = boosting.held_blocks(spread, 2)
    assert held.getNumPartitions() <= spark.sparkContext.defaultParallelism < spread.rdd.getNumPartitions()
    assert sum(len(block[0]) for block in held.collect()) == 400
    sums = rng.integers(-(2**45), 2**45, (2, 3, 16))
    assert (boosting.from_planes(boosting.planes(sums)).reshape(sums.shape) == sums).all()
