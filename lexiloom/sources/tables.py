"""Parquet tables, with a number of splits that suits the work."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 20_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all cores when a scan has fewer splits than cores.

    A large scan already has many splits, so nothing is shuffled there. Only for
    scans: asking a plan with a shuffle for its partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def packed(df: DataFrame, rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Merge tiny splits for a fit that passes over the rows hundreds of times.

    With few rows the cost of a pass is the number of tasks. Large tables stay
    as they are.
    """
    tasks = max(1, math.ceil(rows / rows_per_task))
    return df.coalesce(tasks) if tasks < df.rdd.getNumPartitions() else df
