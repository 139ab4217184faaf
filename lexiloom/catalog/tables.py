"""The given tables in the roles of tweets, labels and scores, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources.tables import read_table, spread


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def tweets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as nested tweets: long texts are cut, the whole one is nested."""
    return documents(spark, sf).select(
        "doc_id",
        F.substring("text", 1, 140).alias("text"),
        F.struct("lang", "source").alias("user"),
        F.when(F.col("n_chars") > 140, F.struct(F.col("text").alias("full_text"))).alias("extended_tweet"),
    )


TWEETS_SQL = """tweets AS (
  SELECT doc_id, substr(text, 1, 140) AS text, lang AS user_lang, source AS user_source,
         CASE WHEN n_chars > 140 THEN text END AS extended FROM documents)"""


def spread_documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Documents over all cores, for work that is heavy per row."""
    return spread(documents(spark, sf).select(*columns), "doc_id")


def labelled(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return documents(spark, sf).select("doc_id", *columns).join(labels, "doc_id")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed scorer instead of a trained model, so that SQL can check the metrics."""
    return labelled(spark, sf, "n_chars").select(
        "doc_id",
        "label",
        (F.col("n_chars") / (F.col("n_chars") + 1000)).alias("score"),
        (F.col("n_chars") > 1500).cast("int").alias("prediction"),
    )


SCORED_SQL = """scored AS (
  SELECT doc_id, quality AS label, n_chars / (n_chars + 1000.0::DOUBLE) AS score,
         (n_chars > 1500)::INT AS prediction
  FROM documents JOIN labels USING (doc_id))"""


def fold_sql(source: str, key: str, label: str, k: int = 5) -> str:
    """Rank by hash inside each class, cut into k blocks whose sizes differ by one at most."""
    return f"""
  SELECT {key}, {label} AS label,
         CASE WHEN r < (n % {k}) * (n // {k} + 1) THEN r // (n // {k} + 1)
              ELSE n % {k} + (r - (n % {k}) * (n // {k} + 1)) // (n // {k}) END::BIGINT AS fold
  FROM (SELECT {key}, {label}, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY {label}) AS n
        FROM {source} WINDOW w AS (PARTITION BY {label} ORDER BY md5('42:' || {key})))"""
