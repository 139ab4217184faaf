"""Sources, sinks, projections and scalar functions."""

from __future__ import annotations

from datetime import date

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.catalog.registry import big, query, rounded
from lexiloom.catalog.tables import TWEETS_SQL, documents, labelled, scored, spread_documents, tweets
from lexiloom.functions import clean, text
from lexiloom.operators import rows, schema
from lexiloom.operators.scaling import fit_vector_scaler
from lexiloom.plans import training
from lexiloom.plans.features import Inputs, prepare
from lexiloom.session import scratch_path
from lexiloom.sources import json_lines, results
from lexiloom.sources.tables import read_table

TWEET_SCHEMA = (
    "doc_id bigint, text string, user struct<lang: string, source: string>, "
    "extended_tweet struct<full_text: string>"
)


def written_lines(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.select(F.to_json(F.struct("*"))).write.text(path)
    return path


@query(
    "s1_jsonl_roundtrip",
    f"""WITH {TWEETS_SQL}
SELECT doc_id, md5(text) AS text_md5, user_lang, user_source, md5(extended) AS extended_md5 FROM tweets""",
)
def s1(spark: SparkSession, sf: str) -> DataFrame:
    df = json_lines.read_jsonl(spark, written_lines(tweets(spark, sf), "tweets"), TWEET_SCHEMA)
    return df.select(
        "doc_id",
        F.md5("text").alias("text_md5"),
        F.col("user.lang").alias("user_lang"),
        F.col("user.source").alias("user_source"),
        F.md5("extended_tweet.full_text").alias("extended_md5"),
    )


@query(
    "s2_json_coerce",
    "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, value, TRY_CAST(event_type AS BIGINT) AS not_a_number FROM events",
)
def s2(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    raw = read_table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        k.alias("k"),
        F.col("value").cast("string").alias("value"),
        F.col("event_type").alias("not_a_number"),
    )
    inferred = json_lines.read_jsonl(spark, written_lines(raw, "events"))
    types = {"event_id": "bigint", "k": "bigint", "value": "double", "not_a_number": "bigint"}
    return json_lines.coerce_types(inferred, types)


@query(
    "s3_flatten",
    f"""WITH {TWEETS_SQL}
SELECT doc_id, md5(text) AS text, user_lang, user_source, md5(extended) AS extended_tweet_full_text FROM tweets""",
)
def s3(spark: SparkSession, sf: str) -> DataFrame:
    flat = json_lines.flatten(tweets(spark, sf))
    return flat.withColumns({c: F.md5(c) for c in ("text", "extended_tweet_full_text")})


@query(
    "s4_load_tables",
    """SELECT 'train' AS part, doc_id, quality AS label, md5(text) AS text_md5, lang AS user_lang
FROM documents JOIN labels USING (doc_id)
UNION ALL
SELECT 'score', doc_id, NULL, md5(text), lang FROM documents ANTI JOIN labels USING (doc_id)""",
)
def s4(spark: SparkSession, sf: str) -> DataFrame:
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    source = tweets(spark, sf).withColumnRenamed("doc_id", "challenge_id")
    labels = labels.withColumnRenamed("doc_id", "challenge_id")
    shape = TWEET_SCHEMA.replace("doc_id", "challenge_id")
    train = json_lines.load_labelled(
        spark, written_lines(source.join(labels, "challenge_id"), "train"), shape + ", label int"
    )
    score = json_lines.load_scoring(spark, written_lines(rows.except_rows(source, labels, "challenge_id"), "score"), shape)
    columns = ("label", "challenge_id", "full_text", "user_lang")
    both = train.select(F.lit("train").alias("part"), *columns).unionByName(
        score.withColumn("label", F.lit(None).cast("int")).select(F.lit("score").alias("part"), *columns)
    )
    return both.select(
        "part", F.col("challenge_id").alias("doc_id"), "label", F.md5("full_text").alias("text_md5"), "user_lang"
    )


@query(
    "s5_submission",
    'SELECT doc_id AS "ID", (n_chars > 1500)::INT AS "Prediction" FROM documents JOIN labels USING (doc_id)',
)
def s5(spark: SparkSession, sf: str) -> DataFrame:
    path = results.write_submission(
        scored(spark, sf), scratch_path(spark, "outputs"), "fixed_scorer", "doc_id", day=date(2024, 1, 1)
    )
    return spark.read.option("header", True).schema("ID bigint, Prediction int").csv(path)


@query(
    "s6_cache_missing",
    "SELECT doc_id FROM documents ANTI JOIN embeddings ON doc_id = vec_id",
)
def s6(spark: SparkSession, sf: str) -> DataFrame:
    store = read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.lit("base").alias("encoder_id"), "embedding"
    )
    return results.missing_rows(documents(spark, sf).select("doc_id"), store, "doc_id", "base")


@query(
    "s7_saved_model",
    """WITH cells AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, dim::BIGINT AS dim,
       round((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w > 0 THEN stddev_pop(x) OVER w ELSE 1 END, 6) + 0.0::DOUBLE AS z
FROM cells WINDOW w AS (PARTITION BY dim)""",
)
def s7(spark: SparkSession, sf: str) -> DataFrame:
    df = read_table(spark, sf, "embeddings").select("vec_id", array_to_vector("embedding").alias("v"))
    path = scratch_path(spark, "model")
    results.save_model(Pipeline(stages=fit_vector_scaler(df, "v", "z")).fit(df), path)
    scaled = results.load_model(path).transform(df)
    long = scaled.select("vec_id", F.posexplode(vector_to_array("z")).alias("dim", "z"))
    return long.select("vec_id", big("dim").alias("dim"), rounded("z").alias("z"))


@query("s7_saved_classifier", "SELECT vec_id, TRUE AS same_class, TRUE AS same_probability FROM embeddings")
def s7_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """A trained classifier, saved and loaded, scores every vector as the one that was not saved."""
    inputs = Inputs("vec_id", vector="embedding")
    known = read_table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("label"))
    ready = prepare(known, inputs)
    model = training.build("logistic_regression_vectors").fit(ready, inputs)
    path = scratch_path(spark, "model")
    results.save_model(model, path)
    p = vector_to_array("probability")[1]
    before = model.transform(ready).select("vec_id", F.col("prediction").alias("c"), p.alias("p"))
    after = results.load_model(path).transform(ready).select("vec_id", F.col("prediction").alias("d"), p.alias("q"))
    return before.join(after, "vec_id").select(
        "vec_id", (F.col("c") == F.col("d")).alias("same_class"), (F.abs(F.col("p") - F.col("q")) < 1e-12).alias("same_probability")
    )


@query("p2_full_text", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def p2(spark: SparkSession, sf: str) -> DataFrame:
    flat = json_lines.flatten(tweets(spark, sf))
    return flat.select("doc_id", F.md5(text.full_text("text", "extended_tweet_full_text")).alias("text_md5"))


@query(
    "p2b_full_text_nonempty",
    """SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN (CASE WHEN doc_id % 2 = 0 THEN '' ELSE text END)
  ELSE text END) AS text_md5 FROM documents""",
)
def p2b(spark: SparkSession, sf: str) -> DataFrame:
    third, even = F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0
    df = documents(spark, sf).select(
        "doc_id",
        F.when(~(third & even), F.col("text")).alias("text"),
        F.when(third, "").otherwise(F.col("text")).alias("extended"),
    )
    return df.select("doc_id", F.md5(text.full_text_nonempty("text", "extended")).alias("text_md5"))


@query(
    "p3_template",
    r"""SELECT doc_id, md5('[user description] ' || CASE WHEN lang = 'fr' THEN 'nan' ELSE source END
  || chr(10) || chr(10) || '[tweet content] ' || text) AS prompt_md5 FROM documents""",
)
def p3(spark: SparkSession, sf: str) -> DataFrame:
    description = F.when(F.col("lang") != "fr", F.col("source"))
    return documents(spark, sf).select("doc_id", F.md5(text.prompt(description, "text")).alias("prompt_md5"))


@query(
    "p4_drop_all_null",
    "SELECT doc_id, lang, source, CASE WHEN n_chars > 1000 THEN n_chars END AS long_chars FROM documents",
)
def p4(spark: SparkSession, sf: str) -> DataFrame:
    df = documents(spark, sf).select(
        "doc_id",
        "lang",
        F.lit(None).cast("string").alias("nothing"),
        "source",
        F.lit(float("nan")).alias("no_number"),
        F.when(F.col("n_chars") > 1000, F.col("n_chars")).alias("long_chars"),
    )
    return schema.drop_all_null(df)


@query("p5_align", "SELECT doc_id, lang, source, n_chars FROM documents JOIN labels USING (doc_id)")
def p5(spark: SparkSession, sf: str) -> DataFrame:
    return schema.align(labelled(spark, sf, "lang", "source", "n_chars"), documents(spark, sf))


@query(
    "p9_common_numeric",
    """SELECT o_orderkey, o_custkey::FLOAT::DOUBLE AS o_custkey, o_totalprice::FLOAT::DOUBLE AS o_totalprice FROM orders""",
)
def p9(spark: SparkSession, sf: str) -> DataFrame:
    train = read_table(spark, sf, "orders").withColumn("only_here", F.lit(1))
    other = read_table(spark, sf, "orders")
    shared = schema.common_numbers(train, other, excluded=("o_orderkey",))
    df = schema.to_float32(train, shared, keep=("o_orderkey",))
    return df.select("o_orderkey", *[F.col(c).cast("double").alias(c) for c in shared])


@query("p10_positional", "SELECT source, doc_id, n_chars FROM documents")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    return schema.select_at(documents(spark, sf), [3, 0, 4])


@query(
    "p11_profile",
    """SELECT 0 AS "position", 'doc_id' AS name, 'bigint' AS "type", count(doc_id) AS non_null, count(*) AS "rows" FROM documents
UNION ALL SELECT 1, 'text', 'string', count(text), count(*) FROM documents
UNION ALL SELECT 2, 'lang', 'string', count(CASE WHEN lang <> 'fr' THEN lang END), count(*) FROM documents
UNION ALL SELECT 3, 'source', 'string', count(source), count(*) FROM documents
UNION ALL SELECT 4, 'n_chars', 'bigint', count(n_chars), count(*) FROM documents
UNION ALL SELECT 5, 'mean_chars', 'double', count(CASE WHEN n_chars > 500 THEN n_chars END), count(*) FROM documents""",
)
def p11(spark: SparkSession, sf: str) -> DataFrame:
    df = documents(spark, sf).withColumns(
        {
            "lang": F.when(F.col("lang") != "fr", F.col("lang")),
            "mean_chars": F.when(F.col("n_chars") > 500, F.col("n_chars").cast("double")).otherwise(F.lit(float("nan"))),
        }
    )
    return schema.profile(df)


@query("p13_semi_rows", "SELECT doc_id, lang, n_chars FROM documents SEMI JOIN labels USING (doc_id)")
def p13(spark: SparkSession, sf: str) -> DataFrame:
    return rows.take_rows(documents(spark, sf).select("doc_id", "lang", "n_chars"), read_table(spark, sf, "labels"), "doc_id")


@query(
    "p14_isin",
    """SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""",
)
def p14(spark: SparkSession, sf: str) -> DataFrame:
    users = read_table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return rows.take_rows(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), users, "o_custkey")


NON_SPACE_SQL = (
    r"[^\t\n\x{0b}\f\r\x{1c}\x{1d}\x{1e}\x{1f} \x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)

SURFACE_SQL = rf"""length(t)::BIGINT AS tweet_length,
  len(regexp_extract_all(t, '{NON_SPACE_SQL}'))::BIGINT AS word_count,
  (length(t) - length(replace(t, '#', '')))::BIGINT AS hashtags_count,
  (length(t) - length(replace(t, '@', '')))::BIGINT AS mentions_count,
  ((length(t) - length(replace(t, 'http', ''))) // 4)::BIGINT AS urls_count"""


def surface(t: str) -> list:
    return [big(c).alias(name) for name, c in text.surface_features(t).items()]


@query("f_surface", f"SELECT doc_id, {SURFACE_SQL.replace('(t', '(text')} FROM documents")
def f_surface(spark: SparkSession, sf: str) -> DataFrame:
    return spread_documents(spark, sf, "doc_id", "text").select("doc_id", *surface("text"))


@query(
    "f_urls_pages",
    f"SELECT page_id, {SURFACE_SQL} FROM (SELECT page_id, url || ' ' || html AS t FROM pages)",
)
def f_urls(spark: SparkSession, sf: str) -> DataFrame:
    joined = read_table(spark, sf, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("t"))
    return joined.select("page_id", *surface("t"))


@query(
    "f6_metadata_features",
    f"""SELECT doc_id, {SURFACE_SQL}, n_chars AS total_tweets,
  CASE WHEN lang IN ('fr', 'de') THEN 0 ELSE 1 END AS is_location_available
FROM (SELECT *, CASE WHEN source = 'src1' THEN 'nan' ELSE text END AS t FROM documents)""",
)
def f6(spark: SparkSession, sf: str) -> DataFrame:
    df = spread_documents(spark, sf, "doc_id", "text", "lang", "source", "n_chars").select(
        "doc_id",
        F.when(F.col("source") != "src1", F.col("text")).alias("full_text"),
        F.col("n_chars").alias("user_statuses_count"),
        F.when(F.col("lang") == "fr", "").when(F.col("lang") != "de", F.col("lang")).alias("user_location"),
    )
    surface_names = text.surface_features("full_text")
    features = text.metadata_features()
    return df.select("doc_id", *[(big(c) if n in surface_names else c).alias(n) for n, c in features.items()])


@query(
    "f_class_surface",
    f"""SELECT source, label, count(*) AS n,
  round(avg(tweet_length), 6) AS tweet_length, round(avg(word_count), 6) AS word_count,
  round(avg(hashtags_count), 6) AS hashtags_count, round(avg(mentions_count), 6) AS mentions_count,
  round(avg(urls_count), 6) AS urls_count
FROM (SELECT source, quality AS label, {SURFACE_SQL} FROM (SELECT *, text AS t FROM documents JOIN labels USING (doc_id)))
GROUP BY ALL""",
)
def f_class_surface(spark: SparkSession, sf: str) -> DataFrame:
    """How the texts of the two classes differ on the surface, by source."""
    features = text.surface_features("text")
    return (
        labelled(spark, sf, "text", "source")
        .select("source", "label", *[c.alias(n) for n, c in features.items()])
        .groupBy("source", "label")
        .agg(F.count(F.lit(1)).alias("n"), *[rounded(F.avg(c)).alias(c) for c in features])
    )


@query(
    "f7_presence",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' OR c_nationkey = 0 THEN 0 ELSE 1 END AS is_location_available
FROM customer""",
)
def f7(spark: SparkSession, sf: str) -> DataFrame:
    location = F.when(F.col("c_mktsegment") == "FURNITURE", "").when(F.col("c_nationkey") != 0, F.col("c_mktsegment"))
    return read_table(spark, sf, "customer").select("c_custkey", text.is_available(location).alias("is_location_available"))


@query(
    "f8_clean_numeric",
    "SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2, 3) THEN 0 ELSE value END AS value FROM events",
)
def f8(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("event_id") % 7
    dirty = (
        F.when(r == 0, F.lit(None))
        .when(r == 1, F.lit(float("nan")))
        .when(r == 2, F.lit(float("inf")))
        .when(r == 3, F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    return read_table(spark, sf, "events").select("event_id", clean.clean_number(dirty).alias("value"))


@query(
    "f9_bool_int",
    "SELECT doc_id, CASE WHEN lang = 'fr' THEN 0 ELSE (n_chars > 1000)::INT END AS is_long FROM documents",
)
def f9(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.when(F.col("lang") != "fr", F.col("n_chars") > 1000)
    return documents(spark, sf).select("doc_id", clean.bool_to_int(flag).alias("is_long"))


@query(
    "f10_list_len",
    "SELECT doc_id, CASE WHEN lang = 'fr' THEN 0 ELSE len(string_split(text, ' ')) END::BIGINT AS pieces FROM documents",
)
def f10(spark: SparkSession, sf: str) -> DataFrame:
    pieces = F.when(F.col("lang") != "fr", F.split("text", " ", -1))
    return documents(spark, sf).select("doc_id", big(clean.list_length(pieces)).alias("pieces"))


@query(
    "f12_clean_table",
    """SELECT doc_id, source, CASE WHEN n_chars % 4 = 0 THEN 0 ELSE n_chars END AS n_chars,
  CASE WHEN n_chars % 5 = 0 THEN 0 ELSE 1000.0::DOUBLE / n_chars END AS density,
  CASE WHEN lang = 'fr' THEN 0 ELSE (n_chars > 1000)::INT END AS is_long,
  len(string_split(text, ' '))::INT AS pieces FROM documents""",
)
def f12(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    dirty = documents(spark, sf).select(
        "doc_id",
        "text",
        "lang",
        "source",
        F.when(n % 4 != 0, n).alias("n_chars"),
        F.when(n % 5 == 0, F.lit(float("inf"))).otherwise(F.lit(1000.0) / n).alias("density"),
        F.when(F.col("lang") != "fr", n > 1000).alias("is_long"),
        F.split("text", " ", -1).alias("pieces"),
    )
    return schema.clean_metadata(dirty, schema.column_kinds(dirty))
