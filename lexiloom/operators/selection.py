"""Univariate feature scores and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.groups import top_k
from lexiloom.operators.ordering import exact_quantiles


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``feature, f``: between-class over within-class variance.

    All features share one aggregation by class; only its few result rows are
    turned into one row per feature. Missing values (null or NaN) of a feature are
    left out of that feature alone, and so is a class without any value of it.
    """
    known = [F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`")) for c in features]
    per_class = (
        df.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(
            *[F.count(x).alias(f"n{i}") for i, x in enumerate(known)],
            *[F.avg(x).alias(f"m{i}") for i, x in enumerate(known)],
            *[F.var_pop(x).alias(f"v{i}") for i, x in enumerate(known)],
        )
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"))
            for i, c in enumerate(features)
        ]
    )
    long = per_class.select(F.inline(entries)).filter("n > 0")
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    sums = long.groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        mean.alias("mean"),
        F.collect_list(F.struct("n", "m")).alias("classes"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    )
    between = F.aggregate(
        "classes",
        F.lit(0.0),
        lambda acc, c: acc + c["n"] * (c["m"] - F.col("mean")) * (c["m"] - F.col("mean")),
    )
    f = (between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return sums.select("feature", F.when((F.col("within") > 0) & (F.col("k") > 1), f).alias("f"))


def select_k_best(df: DataFrame, features: Sequence[str], label: str, k: int = 10) -> DataFrame:
    """The k features with the highest F; features without a score come last."""
    return top_k(anova_f(df, features, label), "f", "feature", k)


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """``feature, mi`` in nats between the label and equal-frequency bins of each feature.

    Quantile edges first, then counts per (feature, bin, class), which are
    combined before the shuffle. Equal values always share a bin.
    """
    rows = df.filter(F.col(label).isNotNull())
    edges_of = exact_quantiles(rows, features, [i / bins for i in range(1, bins)])

    def bin_of(name: str):
        above = [(F.col(f"`{name}`") > e).cast("int") for e in sorted(set(edges_of[name]))]
        return sum(above, F.lit(0))

    entries = F.array(
        *[F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bin")) for c in features]
    )
    cells = rows.select(F.col(label).alias("cls"), F.inline(entries)).groupBy("feature", "bin", "cls").agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    # features x bins x classes rows are left

    def total(*keys: str):
        return F.sum("n").over(Window.partitionBy("feature", *keys))

    joined = cells.select(
        "feature", "n", total("bin").alias("nb"), total("cls").alias("nc"), total().alias("nt")
    )
    term = F.col("n") / F.col("nt") * F.ln(F.col("n") * F.col("nt") / (F.col("nb") * F.col("nc")))
    return joined.groupBy("feature").agg(F.sum(term).alias("mi"))
