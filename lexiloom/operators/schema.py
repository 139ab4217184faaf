"""Schema-driven projections (P4-P11) and the metadata cleaner."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.clean import bool_to_int, clean_number, is_present, list_length

log = logging.getLogger(__name__)

# Columns that never become features (flattened names).
EXCLUDED = (
    "lang",
    "text",
    "extended_tweet_full_text",
    "user_description",
    "retweet_count",
    "favorite_count",
    "quote_count",
    "reply_count",
    "retweeted",
    "favorited",
    "user_default_profile_image",
    "user_protected",
    "user_contributors_enabled",
)

# Columns that identify a row or hold the target, so never features either.
KEYS = ("challenge_id", "label")


@dataclass(frozen=True)
class ColumnKinds:
    """Feature columns by kind, found in the schema alone."""

    numbers: list[str] = field(default_factory=list)
    booleans: list[str] = field(default_factory=list)
    lists: list[str] = field(default_factory=list)

    @property
    def all(self) -> list[str]:
        return self.numbers + self.booleans + self.lists

    def without(self, excluded: Iterable[str]) -> ColumnKinds:
        gone = set(excluded)
        return ColumnKinds(*[[c for c in kind if c not in gone] for kind in (self.numbers, self.booleans, self.lists)])


def column_kinds(df: DataFrame, excluded: Iterable[str] = (*EXCLUDED, *KEYS)) -> ColumnKinds:
    """Numeric, boolean and list columns; no row is read."""
    kinds = ColumnKinds()
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            kinds.numbers.append(f.name)
        elif isinstance(f.dataType, T.BooleanType):
            kinds.booleans.append(f.name)
        elif isinstance(f.dataType, T.ArrayType):
            kinds.lists.append(f.name)
    return kinds.without(excluded)


def drop_columns(df: DataFrame, names: Iterable[str], strict: bool = False) -> DataFrame:
    """Drop by name; ``strict`` refuses names the table lacks, otherwise they are logged."""
    names = list(names)
    absent = [n for n in names if n not in df.columns]
    if absent and strict:
        raise ValueError(f"cannot drop missing columns {absent}")
    if absent:
        log.info("columns to drop are missing: %s", absent)
    return df.drop(*names)


def non_null_counts(df: DataFrame) -> DataFrame:
    """One row: for each column the number of rows that hold a value."""
    return df.agg(*[F.count_if(is_present(f)).alias(f.name) for f in df.schema.fields])


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop columns without a single value: one pass of map-side flags."""
    flags = df.agg(*[F.bool_or(is_present(f)).alias(f.name) for f in df.schema.fields]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if flags[c]])


def align(df: DataFrame, other: DataFrame) -> DataFrame:
    """Only the columns that ``other`` has too, in this table's order."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in set(other.columns)])


def common_numbers(df: DataFrame, other: DataFrame, excluded: Iterable[str] = (*EXCLUDED, *KEYS)) -> list[str]:
    shared = set(column_kinds(other, excluded).numbers)
    return [c for c in column_kinds(df, excluded).numbers if c in shared]


def to_float32(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[F.col(f"`{c}`").cast("float").alias(c) for c in columns])


def select_at(df: DataFrame, ordinals: Sequence[int]) -> DataFrame:
    """Projection by column position."""
    return df.select(*[F.col(f"`{df.columns[i]}`") for i in ordinals])


def profile(df: DataFrame) -> DataFrame:
    """Per column its position, type and non-null count, and the row count of the table."""
    fields = df.schema.fields
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(is_present(f)).alias(f"c{i}") for i, f in enumerate(fields)])
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col(f"c{i}").alias("non_null"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return counts.select(F.inline(entries), "rows")


def clean_metadata(df: DataFrame, kinds: ColumnKinds, dropped: Iterable[str] = EXCLUDED, strict: bool = False) -> DataFrame:
    """Repair numbers, turn booleans into 0/1 and lists into lengths, drop the rest by name."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def repaired(name: str):
        c = F.col(f"`{name}`")
        if name in kinds.numbers:
            return clean_number(c, isinstance(types[name], (T.DoubleType, T.FloatType))).alias(name)
        if name in kinds.booleans:
            return bool_to_int(c).alias(name)
        if name in kinds.lists:
            return list_length(c).alias(name)
        return c

    return drop_columns(df.select(*[repaired(c) for c in df.columns]), dropped, strict)
