"""Metadata repair (F7-F10): numbers, booleans and lists become plain numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_number(c: Column, floating: bool = True) -> Column:
    """Missing and infinite values become 0."""
    if not floating:
        return F.coalesce(c, F.lit(0))
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def bool_to_int(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def list_length(c: Column) -> Column:
    """Number of elements; a missing list has none."""
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(c))


def is_present(field: T.StructField) -> Column:
    """True where the column holds a value; NaN counts as missing."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()
