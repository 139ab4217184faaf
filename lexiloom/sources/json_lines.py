"""JSON lines: read, coerce, flatten, and the two loaders."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.text import full_text, full_text_nonempty


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object per line; blank lines are skipped and a malformed one fails the job.

    Pass a schema for large inputs: without one Spark scans the files twice.
    """
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def coerce_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the named columns; a value that does not fit becomes null."""
    return df.select(
        *[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns]
    )


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """One column per leaf of every nested object; lists stay lists."""
    leaves = list(_leaves(df.schema, (), sep))
    names = [name for name, _ in leaves]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"flattened names collide: {clashes}; use another separator")
    return df.select(*[c.alias(name) for name, c in leaves])


def load_labelled(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    nonempty: bool = False,
) -> DataFrame:
    """Flat labelled table with ``full_text``; features and ``label`` stay together."""
    return _with_full_text(flatten(read_jsonl(spark, path, schema)), nonempty)


def load_scoring(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    key: str = "challenge_id",
    nonempty: bool = False,
) -> DataFrame:
    """Flat unlabelled table with ``full_text`` and a non-negotiable key column."""
    df = _with_full_text(flatten(read_jsonl(spark, path, schema)), nonempty)
    if key not in df.columns:
        raise ValueError(f"scoring table has no key column {key!r}")
    return df.withColumn(key, F.col(key).cast("long"))


def _with_full_text(df: DataFrame, nonempty: bool) -> DataFrame:
    extended = F.col("extended_tweet_full_text") if "extended_tweet_full_text" in df.columns else F.lit(None)
    rule = full_text_nonempty if nonempty else full_text
    return df.withColumn("full_text", rule(F.col("text"), extended.cast("string")))


def _leaves(schema: T.StructType, path: tuple[str, ...], sep: str) -> Iterator[tuple[str, Column]]:
    for field in schema.fields:
        here = (*path, field.name)
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType, here, sep)
        else:
            yield sep.join(here), F.col(".".join(f"`{p}`" for p in here))
