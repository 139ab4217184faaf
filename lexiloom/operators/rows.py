"""Row selection by key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def take_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed in the other table. The planner picks broadcast or sort-merge by size."""
    return df.join(keys.select(key), key, "left_semi")


def except_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")
