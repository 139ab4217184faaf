"""Groups, per-user texts, class statistics and top-k.

A group may hold a third of all rows. Results that carry a whole group (its row
ids, its joined text) are therefore cut into numbered parts of bounded size.
Groups below the bound, normally all of them, have the single part 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import safe_text
from lexiloom.operators.ordering import order_cuts, running_totals
from lexiloom.session import materialise

# an aggregation task may hold some hundred unfinished groups at once
PART_ROWS = 250_000
PART_CHARS = 8_000_000


def group_ids(df: DataFrame, group: str, key: str, part_rows: int = PART_ROWS) -> DataFrame:
    """``group, part, ids``: row keys of each group in ascending order; null groups are dropped."""
    rows = df.filter(F.col(group).isNotNull()).select(group, key)
    ids = F.sort_array(F.collect_list(key)).alias("ids")
    cold, hot = _split_hot(rows, group, key, F.lit(1), part_rows)
    out = cold.groupBy(group).agg(ids).select(group, F.lit(0).cast("long").alias("part"), "ids")
    if hot is not None:
        out = out.unionByName(hot.groupBy(group, "part").agg(ids))
    return out


def ungroup(groups: DataFrame, group: str, ids: str = "ids", key: str = "id") -> DataFrame:
    """One row per member of each list."""
    return groups.select(group, F.explode(ids).alias(key))


def user_texts(
    df: DataFrame,
    group: str,
    key: str,
    text: str,
    label: str | None = None,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """All texts of a user joined by a space in row order, after the user's description.

    ``group`` is the description itself. With ``label``, the label of the user's
    first row is attached. A part starts with the first text that begins at or
    after a multiple of ``part_chars``; the parts of a user joined by a space are
    the whole text.
    """
    rows = df.filter(F.col(group).isNotNull()).select(
        group, key, safe_text(text).alias("_text"), *([label] if label else [])
    )
    ordered = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col("_text").alias("t"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("full_text_agg")
    first_label = [F.min_by(label, key).alias("label")] if label else []

    cold, hot = _split_hot(rows, group, key, F.length("_text") + 1, part_chars)
    out = cold.groupBy(group).agg(joined, *first_label).withColumn("part", F.lit(0).cast("long"))
    if hot is not None:
        parts = hot.groupBy(group, "part").agg(joined)
        if label:
            parts = parts.join(hot.groupBy(group).agg(*first_label), group, "left")
        out = out.unionByName(parts)
    described = F.when(F.col("part") == 0, F.concat(F.col(group).cast("string"), F.lit(" "))).otherwise("")
    return out.select(
        group,
        "part",
        "full_text_agg",
        F.concat(described, "full_text_agg").alias("combined_text"),
        *(["label"] if label else []),
    )


def first_label(df: DataFrame, group: str, key: str, label: str) -> DataFrame:
    """One row per group: the label of its first row."""
    return df.groupBy(group).agg(F.min_by(label, key).alias(label))


def attach_labels(groups: DataFrame, labels: DataFrame, group: str) -> DataFrame:
    return groups.join(labels, group, "left")


def fold_summary(df: DataFrame, score: str) -> DataFrame:
    """Mean and population deviation of fold scores."""
    return df.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weight_table(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """One row per class: ``label`` and its balanced weight ``n / (k * n_c)``."""
    counts = class_counts(df, label)
    every = Window.partitionBy()  # one row per class is left
    share = F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    return counts.select(label, share.alias(name))


def class_weights(df: DataFrame, label: str) -> dict[object, float]:
    """The same as a dictionary, for callers that know the classes are few."""
    return {r[0]: r[1] for r in class_weight_table(df, label).collect()}


def with_class_weight(df: DataFrame, label: str, weights: DataFrame, name: str = "weight") -> DataFrame:
    """Add the weight of the row's class, null for an unknown or missing one; ``weights`` is the table above.

    The planner decides the join by the measured number of classes.
    """
    found = weights.toDF("_class", name)
    return df.join(found, F.col(label) == F.col("_class"), "left").drop("_class")


def group_ratio(df: DataFrame, group: str) -> DataFrame:
    """Rows, groups and rows per group in one row."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("groups"))
    return counted.withColumn("rows_per_group", F.col("rows") / F.col("groups"))


def top_k(df: DataFrame, score: str, name: str, k: int) -> DataFrame:
    """The k best rows; ties go to the smaller name, missing scores come last."""
    s = F.col(score)
    if dict(df.dtypes)[score] in ("double", "float"):
        s = F.when(~F.isnan(s), s)
    return df.orderBy(s.desc_nulls_last(), F.col(name)).limit(k)


def majority_class(df: DataFrame, label: str) -> object:
    """Most frequent class, the smallest one on ties."""
    return class_counts(df, label).orderBy(F.desc("n"), label).first()[label]


def _split_hot(
    rows: DataFrame, group: str, key: str, size: Column, limit: int
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups within the limit, and rows of larger groups with their part number."""
    sizes = rows.groupBy(group).agg(F.sum(size).alias("_size"))
    hot_groups = materialise(sizes.filter(F.col("_size") > limit).select(group), "hot-groups")
    if hot_groups.isEmpty():
        return rows, None
    cold = rows.join(hot_groups, group, "left_anti")
    hot = rows.join(hot_groups, group, "left_semi")
    (cuts,) = order_cuts(hot, [key], size, bucket_size=max(1, limit))
    before = running_totals(hot, [group], key, {"_before": size}, cuts)
    part = F.floor(F.col("_before") / F.lit(limit)).cast("long")
    return cold, before.withColumn("part", part).drop("_before")
