"""Prediction files, computed vectors and fitted models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 32


def submission(df: DataFrame, key: str, prediction: str = "prediction") -> DataFrame:
    return df.select(F.col(key).cast("long").alias("ID"), F.col(prediction).cast("int").alias("Prediction"))


def write_submission(
    df: DataFrame, folder: str, model_name: str, key: str, prediction: str = "prediction", day: date | None = None
) -> str:
    """Write ``ID,Prediction`` with a header below a dated name; return the path."""
    path = f"{folder}/{model_name}_{(day or date.today()):%Y%m%d}.csv"
    submission(df, key, prediction).write.mode("overwrite").option("header", True).csv(path)
    return path


def content_key(text: str | Column) -> Column:
    """Key of a vector: a digest of what was encoded, so that no two texts share one. A null text has its own."""
    c = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(F.concat(F.lit("="), c), F.lit("")), 256)


def missing_rows(df: DataFrame, store: DataFrame, key: str, encoder_id: str) -> DataFrame:
    """Rows whose vector the store does not hold for this encoder."""
    known = store.filter(F.col("encoder_id") == encoder_id).select(key)
    return df.join(known, key, "left_anti")


def cached_vectors(
    spark: SparkSession,
    df: DataFrame,
    path: str,
    text: str,
    encoder_id: str,
    encode: Callable[[DataFrame], DataFrame],
    buckets: int = BUCKETS,
) -> DataFrame:
    """``df`` with the ``vector`` of its text from a Parquet store; each missing text is encoded once.

    The store is keyed by the content of the text and split by ``encoder_id``, which
    must name everything that shapes a vector. ``encode`` turns ``digest, <text>``
    into ``digest, vector``. A row without a vector afterwards is an error.

    Its files are bucketed by digest, so looking up what it holds shuffles the texts'
    digests alone, never the stored vectors. A store of another number of ``buckets`` is
    another store.
    """
    rows = df.withColumn("digest", content_key(text))
    texts = rows.select("digest", text)
    kind = _stored_kind(spark, _store_path(path, encoder_id, buckets))
    if kind is not None:
        known = spark.table(open_store(spark, path, encoder_id, kind, buckets))
        texts = texts.join(known.select("digest"), "digest", "left_anti")
    fresh = encode(texts.dropDuplicates(["digest"])).select("digest", "vector")
    kind = fresh.schema["vector"].dataType
    store = open_store(spark, path, encoder_id, kind, buckets)
    fresh.repartition(buckets, "digest").write.insertInto(store)
    found = rows.join(_once(spark.table(store)), "digest", "left").drop("digest")
    lost = F.raise_error(F.lit("the store does not hold the vector of a text"))
    return found.withColumn("vector", F.when(F.col("vector").isNotNull(), F.col("vector")).otherwise(lost.cast(kind)))


def open_store(spark: SparkSession, path: str, encoder_id: str, kind: T.DataType, buckets: int = BUCKETS) -> str:
    """Name of the table over the files of one encoder's vectors; it need not exist yet."""
    own = _store_path(path, encoder_id, buckets)
    name = f"vectors_{hashlib.sha1(own.encode()).hexdigest()}"
    place = own.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, vector {kind.simpleString()}) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    spark.catalog.refreshTable(name)
    return name


def _store_path(path: str, encoder_id: str, buckets: int) -> str:
    return f"{path}/encoder_id={encoder_id}/buckets={buckets}"


def _stored_kind(spark: SparkSession, path: str) -> T.DataType | None:
    try:
        return spark.read.parquet(path).schema["vector"].dataType
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _once(store: DataFrame) -> DataFrame:
    """Two runs may have appended the same text; in a bucketed table that needs no shuffle."""
    return store.groupBy("digest").agg(F.first("vector").alias("vector"))


def compact_store(spark: SparkSession, path: str, to: str, encoder_id: str, kind: T.DataType, buckets: int = BUCKETS) -> None:
    """Copy a store that many runs appended to: one file a bucket, each text once. ``to`` must be new."""
    found = _once(spark.table(open_store(spark, path, encoder_id, kind, buckets)))
    found.repartition(buckets, "digest").write.insertInto(open_store(spark, to, encoder_id, kind, buckets))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
