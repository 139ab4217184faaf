import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import metrics, ordering, selection
from lexiloom.plans import training


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, score double")


def auc(y, s):
    wins = [(a > b) + 0.5 * (a == b) for a, la in zip(s, y) if la for b, lb in zip(s, y) if not lb]
    return sum(wins) / len(wins)


@pytest.mark.parametrize("many", [False, True])
def test_auc_with_ties(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(ordering.order_cuts, "__defaults__", (None, 10, 8, 16))
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 300).tolist()
    s = np.where(rng.random(300) < 0.33, 0.5, rng.random(300).round(2)).tolist()
    df = scored(spark, [(a, int(b > 0.5), b) for a, b in zip(y, s)])
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc(y, s), abs=1e-12)
    row = metrics.metric_row(df).first()
    assert row.auc == pytest.approx(auc(y, s), abs=1e-12)
    assert row.accuracy == pytest.approx(np.mean([a == (b > 0.5) for a, b in zip(y, s)]))


def test_degenerate_metrics(spark):
    tied = scored(spark, [(1, 0, 0.5), (0, 0, 0.5)])
    row = metrics.metric_row(tied).first()
    assert (row.auc, row.precision, row.recall, row.f1, row.accuracy) == (0.5, 0, 0, 0, 0.5)
    single = scored(spark, [(1, 1, 0.5), (1, 1, 0.7)])
    assert metrics.roc_auc(single).first()[0] is None
    assert metrics.precision_recall_f1(single).first().f1 == 1.0


def test_log_loss_is_clipped(spark):
    df = scored(spark, [(1, 1, 0.0), (0, 0, 0.5)])
    got = df.agg(metrics.log_loss(probability="score")).first()[0]
    assert got == pytest.approx((-math.log(1e-15) - math.log(0.5)) / 2)


def test_fold_report(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (1, 1, 1), (None, 1, 1)], "fold int, label int, prediction int")
    rows = sorted(map(tuple, metrics.fold_report(df).collect()))
    assert rows == [(0, 0.5, 0.75, 0.25), (1, 1.0, 0.75, 0.25)]


def test_anova_and_selection(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 400)
    x = np.column_stack([rng.normal(size=400), rng.normal(size=400) + y, np.full(400, 2.0)])
    df = spark.createDataFrame([(int(a), *map(float, r)) for a, r in zip(y, x)], "y int, noise double, signal double, flat double")
    got = {r.feature: r.f for r in selection.anova_f(df, ["noise", "signal", "flat"], "y").collect()}
    for i, name in enumerate(["noise", "signal"]):
        g = [x[y == c, i] for c in range(3)]
        between = sum(len(v) * (v.mean() - x[:, i].mean()) ** 2 for v in g) / 2
        within = sum(((v - v.mean()) ** 2).sum() for v in g) / (400 - 3)
        assert got[name] == pytest.approx(between / within)
    assert got["flat"] is None
    best = selection.select_k_best(df, ["noise", "signal", "flat"], "y", 2)
    assert [r.feature for r in best.collect()] == ["signal", "noise"]


def test_mutual_information(spark):
    df = spark.range(1000).select(
        (F.col("id") % 2).cast("int").alias("y"),
        (F.col("id") % 2).cast("double").alias("same"),
        F.lit(1.0).alias("flat"),
        F.floor(F.col("id") / 2).cast("double").alias("free"),
    )
    got = {r.feature: r.mi for r in selection.mutual_information(df, ["same", "flat", "free"], "y").collect()}
    assert got["same"] == pytest.approx(math.log(2))
    assert got["flat"] == pytest.approx(0) and got["free"] == pytest.approx(0, abs=1e-9)


def test_best_epoch_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("b", 1, 0.1)], "run string, epoch int, acc double")
    got = {r.run: (r.epoch, r.acc) for r in training.best_epoch(df, "run", "epoch", "acc").collect()}
    assert got == {"a": (2, 0.7), "b": (1, 0.1)}


def test_metrics_do_not_depend_on_the_number_of_rows(spark):
    found = []
    for n in (150_000, 250_000):
        r = F.col("id") % 10
        score = F.when(r < 3, F.lit(float("nan"))).when(r == 3, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000)
        df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1000)) + r * 20 > 500).cast("int").alias("label"), (r < 7).cast("int").alias("prediction"), score.alias("score"))
        row = metrics.metric_row(df).first()
        assert row.accuracy == pytest.approx(df.select(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0])
        known = df.where("score is not null and not isnan(score)")
        assert row.auc == pytest.approx(metrics.roc_auc(known).first()[0]) and 0 <= row.auc <= 1
        found.append(row.auc)
    assert abs(found[0] - found[1]) < 0.01


def test_anova_leaves_missing_values_out(spark):
    rng = np.random.default_rng(3)
    y, x = rng.integers(0, 3, 900), rng.normal(size=900)
    x = x + y * 0.3
    missing = rng.random(900)
    rows = [(int(a), None if m < 0.1 else float("nan") if m < 0.2 else float(b)) for a, b, m in zip(y, x, missing)]
    got = selection.anova_f(spark.createDataFrame(rows, "label int, x double"), ["x"], "label").first().f
    keep = missing >= 0.2
    parts = [x[keep & (y == c)] for c in range(3)]
    n, mean = sum(map(len, parts)), x[keep].mean()
    between = sum(len(p) * (p.mean() - mean) ** 2 for p in parts) / 2
    within = sum(((p - p.mean()) ** 2).sum() for p in parts) / (n - 3)
    assert got == pytest.approx(between / within)
