"""Documents to tokens: poor and toxic texts, near copies and benchmark texts go, the rest is encoded.

Every stage takes (spark, docs, folder of the tables), calls one operator, and works on
all rows that the stage before it kept. All but the last return the columns they got.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import bpe, decontaminate, simhash, toxicity, weak_labels
from lexiloom.session import materialise

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null, empty and blank texts go; repeated rows stay or go together; a very long text is one row like
    any other; an empty table stays empty; all columns stay as they are.
    """
    return weak_labels.reject_poor(docs)


def toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents below the toxicity limit, by a model of the labels that ``docs`` still has texts for.

    Null and empty texts are scored as texts without words; rows of one text stay or go together; an empty
    table stays empty; all columns stay as they are.
    """
    return toxicity.reject_toxic(docs, _table(spark, folder, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, null last.

    Texts without words are near copies of each other; of repeated rows one stays; all columns stay as they are.
    """
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that share no window with an item of the benchmark.

    Texts without words stay; repeated rows stay or go together; an empty benchmark takes nothing away; all
    columns stay as they are.
    """
    return decontaminate.decontaminate(docs, _table(spark, folder, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Ids of every text; texts whose ids do not decode to their bytes would show in ``round_trip``."""
    codec = bpe.Codec(spark, bpe.load_ranks(public_tokenizers.path(VOCABULARY)))
    encoded = docs.withColumn("__r", codec.round_trip("text"))
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        F.size("__r.ids").cast("bigint").alias("n_tokens"),
        F.col("__r.ids").alias("token_ids"),
        (F.col("__r.decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("round_trip"),
    )


STAGES = [("quality", quality), ("toxicity", toxic), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]

#: trained models and components have no SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), f"stage-{name}")
    return STAGES[-1][1](spark, docs, folder)
