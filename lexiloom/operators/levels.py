"""One-hot encoding with levels learnt on one table (V2), in sparse form: any number of levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import materialise


def fit_levels(df: DataFrame, column: str) -> DataFrame:
    """``column, position`` of every level: in order of the values, a null level last.

    Levels are sorted over ranges; a position is the number of levels in the ranges before, plus the
    place in its own, so no task holds all levels.
    """
    level = F.col(f"`{column}`")
    found = df.select(level.alias("level")).distinct().orderBy(F.asc_nulls_last("level"))
    # the upper bits of this id are the range, the lower 33 the place in it
    placed = materialise(found.withColumn("at", F.monotonically_increasing_id()), "levels")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    rows = placed.withColumn("part", part).join(starts, "part")
    return rows.select(F.col("level").alias(column), (F.col("start") + F.col("at").bitwiseAND(2**33 - 1)).alias("position"))


def level_positions(df: DataFrame, levels: DataFrame, column: str) -> DataFrame:
    """``position`` of the level, null when unknown.

    ``levels`` has ``column`` and ``position``; its size decides the join, not a hint.
    """
    return df.join(levels, df[column].eqNullSafe(levels[column]), "left").drop(levels[column])


def slots(position: str | Column, size: int) -> Column:
    """The indicators as a dense array, for a width the caller knows to be small; an unknown level is all zeros."""
    at = F.col(position) if isinstance(position, str) else position
    each = F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))
    dense = F.transform(each, lambda i: F.coalesce((at == i).cast("double"), F.lit(0.0)))
    return dense if size > 0 else F.array().cast("array<double>")
