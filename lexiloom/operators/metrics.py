"""Classification metrics (E1-E6), each from one aggregation over the scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.ordering import order_cuts, running_totals
from lexiloom.session import materialise

# Fixed value: lowest probability the logarithm is taken of.
MIN_PROBABILITY = 1e-15


def accuracy(label: str = "label", prediction: str = "prediction") -> Column:
    return F.avg((F.col(label) == F.col(prediction)).cast("double"))


def log_loss(label: str = "label", probability: str = "probability") -> Column:
    """Mean negative log of the probability given to the true class; ``probability`` is that of class 1."""
    p = F.col(probability)
    of_label = F.when(F.col(label) == 1, p).otherwise(1 - p)
    return F.avg(-F.ln(F.greatest(of_label, F.lit(MIN_PROBABILITY))))


def confusion(label: str = "label", prediction: str = "prediction") -> dict[str, Column]:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return {
        "tp": F.count_if(y & p),
        "fp": F.count_if(~y & p),
        "fn": F.count_if(y & ~p),
        "tn": F.count_if(~y & ~p),
    }


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1 of class 1; a zero denominator gives 0."""
    return {
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def precision_recall_f1(
    df: DataFrame, label: str = "label", prediction: str = "prediction", groups: Sequence[str] = ()
) -> DataFrame:
    counts = df.groupBy(*groups).agg(*[c.alias(n) for n, c in confusion(label, prediction).items()])
    named = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(*groups, *[c.alias(n) for n, c in named.items()])


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve by rank sums; tied scores count half."""
    return _by_score(df, label, score, {}).agg(_auc())


def metric_row(
    df: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "score"
) -> DataFrame:
    """Accuracy, F1, precision, recall and AUC in one row.

    The confusion counts ride along with the counts per score, so the rows are
    shuffled once and already reduced to distinct scores. A missing score (null or
    NaN) only leaves the row out of the AUC, a missing prediction only out of the rest.
    """
    per_score = _by_score(df, label, score, confusion(label, prediction))
    tp, fp, fn, tn = (F.sum(c) for c in ("tp", "fp", "fn", "tn"))
    totals = per_score.agg(_auc(), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    named = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    right = F.col("tp") + F.col("tn")
    return totals.select(
        (right / (right + F.col("fp") + F.col("fn"))).alias("accuracy"),
        named["f1"].alias("f1"),
        named["precision"].alias("precision"),
        named["recall"].alias("recall"),
        "auc",
    )


def fold_report(df: DataFrame, fold: str = "fold", label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy per fold, with the mean and population deviation over folds on every row."""
    per_fold = df.filter(F.col(fold).isNotNull()).groupBy(fold).agg(accuracy(label, prediction).alias("accuracy"))
    folds = Window.partitionBy()  # one row per fold is left
    return per_fold.select(
        fold,
        "accuracy",
        F.avg("accuracy").over(folds).alias("mean"),
        F.stddev_pop("accuracy").over(folds).alias("std"),
    )


def _by_score(df: DataFrame, label: str, score: str, extra: dict[str, Column]) -> DataFrame:
    """Per distinct score: positives, negatives, and the negatives with a lower score."""
    s, y = F.col(score), F.col(label) == 1
    known = F.when(~F.isnan(s.cast("double")), s)
    per_score = (
        df.filter(F.col(label).isNotNull())
        .groupBy(known.alias(score))
        .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"), *[c.alias(n) for n, c in extra.items()])
    )
    # written once: the sketch and both sides of the running totals read the reduced table
    per_score = materialise(per_score, "per-score")
    found = {n: F.when(F.col(score).isNotNull(), F.col(n)).otherwise(F.lit(0)) for n in ("pos", "neg")}
    per_score = per_score.withColumns(found)
    (cuts,) = order_cuts(per_score, [score])
    return running_totals(per_score, [], score, {"neg_below": F.col("neg")}, cuts)


def _auc() -> Column:
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return F.when(pairs > 0, wins / pairs).alias("auc")
