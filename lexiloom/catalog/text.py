"""Tokens, n-grams and TF-IDF."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.catalog.registry import big, query, rounded
from lexiloom.catalog.tables import spread_documents
from lexiloom.functions.stopwords import FRENCH
from lexiloom.functions.tokens import TOKEN, drop_stop_words, truncate, word_tokens
from lexiloom.operators import tfidf
from lexiloom.operators.rows import except_rows, take_rows
from lexiloom.sources.tables import read_table

STOPS_SQL = "[" + ", ".join(f"'{w}'" for w in FRENCH) + "]"
TOKENS_SQL = f"regexp_extract_all(lower(text), '{TOKEN}')"


def grams_sql(source: str, key: str, rules: tfidf.TermRules) -> str:
    """``words``: tokens without stop words; ``grams``: their n-grams, shortest first."""
    lists = []
    for n in range(rules.low, rules.high + 1):
        parts = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
        lists.append("w" if n == 1 else f"list_transform(range(1, len(w) - {n - 2}), lambda i: {parts})")
    return f"""words AS (
  SELECT {key}, list_filter({TOKENS_SQL}, lambda t: NOT list_contains({STOPS_SQL}, t)) AS w FROM {source}),
grams AS (SELECT {key}, flatten([{', '.join(lists)}]) AS g FROM words)"""


def vocabulary_sql(key: str, rules: tfidf.TermRules, grams: str = "grams") -> str:
    """``vocab``: the kept terms; ``total``: the number of rows they are learnt from."""
    return f"""total AS (SELECT count(*) AS n FROM {grams}),
counts AS (SELECT term, count(*) AS tf, count(DISTINCT {key}) AS df
           FROM (SELECT {key}, unnest(g) AS term FROM {grams}) GROUP BY term),
vocab AS (SELECT term, tf, df FROM counts, total
          WHERE df >= {rules.min_df} AND df <= {rules.max_df}::DOUBLE * n ORDER BY tf DESC, term LIMIT {rules.max_features})"""


def weights_sql(key: str, grams: str = "grams") -> str:
    return f"""SELECT {key}, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY {key})), 6) AS weight
FROM (SELECT {key}, term, count(*) * (ln((1.0::DOUBLE + any_value(n)) / (1 + any_value(df))) + 1) AS w
      FROM (SELECT {key}, unnest(g) AS term FROM {grams}) JOIN vocab USING (term), total GROUP BY {key}, term)"""


def listed(tokens: str) -> list:
    return [big(F.size(tokens)).alias("n"), F.md5(F.array_join(tokens, "|")).alias("tokens_md5")]


LISTED_SQL = "len(k)::BIGINT AS n, md5(array_to_string(k, '|')) AS tokens_md5"


@query("t1_tokens", f"SELECT doc_id, {LISTED_SQL} FROM (SELECT doc_id, {TOKENS_SQL} AS k FROM documents)")
def t1(spark: SparkSession, sf: str) -> DataFrame:
    df = spread_documents(spark, sf, "doc_id", "text")
    return df.select("doc_id", word_tokens("text").alias("k")).select("doc_id", *listed("k"))


@query(
    "t2_stopwords",
    f"WITH {grams_sql('documents', 'doc_id', tfidf.SMALL)} SELECT doc_id, {LISTED_SQL.replace('(k', '(w')} FROM words",
)
def t2(spark: SparkSession, sf: str) -> DataFrame:
    df = spread_documents(spark, sf, "doc_id", "text")
    return df.select("doc_id", drop_stop_words(word_tokens("text"), FRENCH).alias("k")).select("doc_id", *listed("k"))


@query(
    "t3_ngrams",
    f"WITH {grams_sql('documents', 'doc_id', tfidf.LARGE)} SELECT doc_id, {LISTED_SQL.replace('(k', '(g')} FROM grams",
)
def t3(spark: SparkSession, sf: str) -> DataFrame:
    df = spread_documents(spark, sf, "doc_id", "text")
    return tfidf.with_terms(df, "text", tfidf.LARGE, "k").select("doc_id", *listed("k"))


@query(
    "t4_docfreq",
    f"""WITH {grams_sql('documents', 'doc_id', tfidf.SMALL)}, {vocabulary_sql('doc_id', tfidf.SMALL)}
SELECT term, counts.tf, counts.df FROM counts, total WHERE df >= {tfidf.SMALL.min_df} AND df <= {tfidf.SMALL.max_df}::DOUBLE * n""",
)
def t4(spark: SparkSession, sf: str) -> DataFrame:
    """Every term within the document-frequency bounds, however many there are."""
    df = spread_documents(spark, sf, "doc_id", "text")
    rules = tfidf.SMALL
    counts = tfidf.term_counts(tfidf.with_terms(df, "text", rules))
    rows = df.count()
    return counts.filter((F.col("df") >= rules.min_df) & (F.col("df") <= rules.max_df * rows))


@query(
    "t5_vocab",
    f"""WITH {grams_sql('documents', 'doc_id', tfidf.LARGE)}, {vocabulary_sql('doc_id', tfidf.LARGE)}
SELECT row_number() OVER (ORDER BY term) - 1 AS "position", term, df FROM vocab""",
)
def t5(spark: SparkSession, sf: str) -> DataFrame:
    """Top 5,000 terms by corpus count (a top-k report), numbered alphabetically."""
    rows = spread_documents(spark, sf, "doc_id").count()
    counts = tfidf.candidate_counts(spread_documents(spark, sf, "doc_id", "text"), "text", rows, tfidf.LARGE)
    kept = tfidf.vocabulary(counts, rows, tfidf.LARGE)
    ordered = F.sort_array(F.collect_list(F.struct("term", "df")))  # max_features entries at most
    return (
        kept.agg(ordered.alias("v"))
        .select(F.posexplode("v").alias("position", "v"))
        .select(big("position").alias("position"), "v.term", "v.df")
    )


@query(
    "t6_tfidf_long",
    f"""WITH {grams_sql('documents', 'doc_id', tfidf.SMALL)}, {vocabulary_sql('doc_id', tfidf.SMALL)}
{weights_sql('doc_id')}""",
)
def t6(spark: SparkSession, sf: str) -> DataFrame:
    df = spread_documents(spark, sf, "doc_id", "text")
    return _long(tfidf.fit_tfidf(df, "text", prune=False), df)


@query(
    "t6_tfidf_long_pruned",
    f"""WITH {grams_sql('documents', 'doc_id', tfidf.LARGE)}, {vocabulary_sql('doc_id', tfidf.LARGE)}
{weights_sql('doc_id')}""",
)
def t6_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The large rules, counted the way a large table is: n-grams of frequent words only."""
    df = spread_documents(spark, sf, "doc_id", "text")
    return _long(tfidf.fit_tfidf(df, "text", tfidf.LARGE, prune=True), df)


@query(
    "t6_tfidf_unigrams",
    f"""WITH {grams_sql('documents', 'doc_id', replace(tfidf.SMALL, high=1))},
{vocabulary_sql('doc_id', replace(tfidf.SMALL, high=1))}
{weights_sql('doc_id')}""",
)
def t6_unigrams(spark: SparkSession, sf: str) -> DataFrame:
    df = spread_documents(spark, sf, "doc_id", "text")
    return _long(tfidf.fit_tfidf(df, "text", replace(tfidf.SMALL, high=1)), df)


@query(
    "t7_tfidf_transform",
    f"""WITH {grams_sql('documents', 'doc_id', tfidf.SMALL)},
fitted AS (SELECT * FROM grams SEMI JOIN labels USING (doc_id)),
others AS (SELECT * FROM grams ANTI JOIN labels USING (doc_id)),
{vocabulary_sql('doc_id', tfidf.SMALL, 'fitted')}
{weights_sql('doc_id', 'others')}""",
)
def t7(spark: SparkSession, sf: str) -> DataFrame:
    df = spread_documents(spark, sf, "doc_id", "text")
    labels = read_table(spark, sf, "labels")
    model = tfidf.fit_tfidf(take_rows(df, labels, "doc_id"), "text")
    return _long(model, except_rows(df, labels, "doc_id"))


@query(
    "t8_truncate",
    f"SELECT doc_id, {LISTED_SQL} FROM (SELECT doc_id, ({TOKENS_SQL})[1:128] AS k FROM documents)",
)
def t8(spark: SparkSession, sf: str) -> DataFrame:
    """An encoder sees the first 128 tokens; the cut is the operator."""
    df = spread_documents(spark, sf, "doc_id", "text")
    return df.select("doc_id", truncate(word_tokens("text"), 128).alias("k")).select("doc_id", *listed("k"))


def _long(model: tfidf.TfidfModel, df: DataFrame) -> DataFrame:
    return model.long(df, "doc_id", "text").select("doc_id", "term", rounded("weight").alias("weight"))
