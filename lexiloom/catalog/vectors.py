"""Scaling, encoding, pooling, reduction and neighbours of vectors."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.catalog.registry import ORACLES, big, query, rounded
from lexiloom.catalog.tables import documents, spread_documents
from lexiloom.catalog.text import TOKENS_SQL
from lexiloom.functions import vectors
from lexiloom.operators import descent, encode, levels, neighbours, reduction, scaling, splits
from lexiloom.operators.rows import take_rows
from lexiloom.session import materialise, scratch_path
from lexiloom.sources.results import cached_vectors
from lexiloom.sources.tables import read_table

CELLS_SQL = """cells AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"""


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings")


def long(df: DataFrame, key: str, array: str, value: str) -> DataFrame:
    cells = df.select(key, F.posexplode(array).alias("dim", value))
    return cells.select(key, big("dim").alias("dim"), rounded(value).alias(value))


@query(
    "v1_standardize",
    """WITH t AS (SELECT o_orderkey, o_totalprice AS x,
  ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::BIGINT >= round(0.1::DOUBLE * 4294967296) AS train FROM orders),
f AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM t WHERE train)
SELECT o_orderkey, round((x - m) / s, 6) + 0.0::DOUBLE AS o_totalprice FROM t, f""",
)
def v1(spark: SparkSession, sf: str) -> DataFrame:
    """Learnt on the train rows, applied to all."""
    df = splits.random_holdout(read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    scaler = scaling.fit_column_scaler(df.filter("split = 'train'"), ["o_totalprice"])
    return scaler.transform(df).select("o_orderkey", rounded("o_totalprice").alias("o_totalprice"))


@query("v1b_standardize_vec", ORACLES["s7_saved_model"])
def v1b(spark: SparkSession, sf: str) -> DataFrame:
    df = embeddings(spark, sf).select("vec_id", array_to_vector("embedding").alias("v"))
    scaled = PipelineModel(scaling.fit_vector_scaler(df, "v", "z")).transform(df)
    return long(scaled.select("vec_id", vector_to_array("z").alias("z")), "vec_id", "z", "z")


@query(
    "v2_onehot",
    """WITH t AS (SELECT c_custkey, c_mktsegment AS raw, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS level
           FROM customer),
l AS (SELECT level, row_number() OVER (ORDER BY level NULLS LAST) - 1 AS slot
      FROM (SELECT DISTINCT level FROM t WHERE raw <> 'HOUSEHOLD'))
SELECT c_custkey, slot, (t.level IS NOT DISTINCT FROM l.level)::INT AS value FROM t, l""",
)
def v2(spark: SparkSession, sf: str) -> DataFrame:
    """One level is missing (null) and one is unseen when the levels are learnt."""
    segment = F.col("c_mktsegment")
    df = read_table(spark, sf, "customer").select(
        "c_custkey", segment.alias("raw"), F.when(segment != "MACHINERY", segment).alias("level")
    )
    known = materialise(levels.fit_levels(df.filter("raw <> 'HOUSEHOLD'"), "level"), "levels")
    hot = levels.slots("position", known.count())
    cells = levels.level_positions(df, known, "level").select("c_custkey", F.posexplode(hot).alias("slot", "value"))
    return cells.select("c_custkey", big("slot").alias("slot"), F.col("value").cast("int").alias("value"))


@query(
    "v4_concat",
    """WITH t AS (SELECT doc_id, list_concat(coalesce(embedding::DOUBLE[], list_transform(range(64), lambda i: 0.0::DOUBLE)),
                                     [n_chars::DOUBLE, length(lang)::DOUBLE]) AS v
           FROM documents LEFT JOIN embeddings ON doc_id = vec_id)
SELECT doc_id, generate_subscripts(v, 1) - 1 AS dim, round(unnest(v)::FLOAT::DOUBLE, 6) + 0.0::DOUBLE AS x FROM t""",
)
def v4(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.array(F.col("n_chars").cast("double"), F.length("lang").cast("double"))
    df = documents(spark, sf).select("doc_id", meta.alias("meta")).join(
        embeddings(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left"
    )
    df = df.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), 64)))
    combined = vectors.to_float(vectors.concat_vectors(F.col("embedding"), F.col("meta"))).cast("array<double>")
    return long(df.select("doc_id", combined.alias("v")), "doc_id", "v", "x")


@query("v5_pca")
def v5(spark: SparkSession, sf: str) -> DataFrame:
    df = embeddings(spark, sf).select("vec_id", array_to_vector("embedding").alias("v"))
    reduced = PipelineModel(reduction.fit_pca(df, "v", "p", 16)).transform(df)
    return long(reduced.select("vec_id", vector_to_array("p").alias("p")), "vec_id", "p", "x")


@query(
    "v5_pca_lengths",
    f"""WITH {CELLS_SQL}, z AS (SELECT vec_id, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM cells WINDOW w AS (PARTITION BY dim))
SELECT vec_id, round(sum(z * z), 6) AS length2 FROM z GROUP BY vec_id""",
)
def v5_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """All components together only rotate the scaled vectors, so squared lengths stay as they were."""
    df = embeddings(spark, sf).select("vec_id", array_to_vector("embedding").alias("v"))
    reduced = PipelineModel(reduction.fit_pca(df, "v", "p", 64)).transform(df)
    length2 = F.aggregate(vector_to_array("p"), F.lit(0.0), lambda acc, x: acc + x * x)
    return reduced.select("vec_id", rounded(length2).alias("length2"))


@query(
    "v5_pca_products",
    f"""WITH {CELLS_SQL}, z AS (SELECT vec_id, dim, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM cells WINDOW w AS (PARTITION BY dim))
SELECT a.vec_id, round(sum(a.z * b.z), 5) + 0.0::DOUBLE AS product FROM z a JOIN z b ON b.vec_id = a.vec_id + 1 AND b.dim = a.dim GROUP BY a.vec_id""",
)
def v5_products(spark: SparkSession, sf: str) -> DataFrame:
    """All components together keep the inner product of every vector with the next one."""
    df = embeddings(spark, sf).select("vec_id", array_to_vector("embedding").alias("v"))
    reduced = PipelineModel(reduction.fit_pca(df, "v", "p", 64)).transform(df).select("vec_id", vector_to_array("p").alias("p"))
    other = reduced.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"))
    product = F.aggregate(F.zip_with("p", "q", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return reduced.join(other, "vec_id").select("vec_id", (F.round(product, 5) + F.lit(0.0)).alias("product"))


@query(
    "v5_covariance",
    f"""WITH {CELLS_SQL}, z AS (SELECT vec_id, dim, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM cells WINDOW w AS (PARTITION BY dim))
SELECT a.dim::BIGINT AS i, b.dim::BIGINT AS j, round(avg(a.z * b.z), 6) + 0.0::DOUBLE AS c
FROM z a JOIN z b USING (vec_id) GROUP BY a.dim, b.dim""",
)
def v5_covariance(spark: SparkSession, sf: str) -> DataFrame:
    df = embeddings(spark, sf).select(array_to_vector("embedding").alias("v"))
    matrix = reduction.correlation_matrix(df, "v")
    cells = [(i, j, float(c)) for i, row in enumerate(matrix) for j, c in enumerate(row)]
    return spark.createDataFrame(cells, "i bigint, j bigint, c double").withColumn("c", rounded("c"))


KNN_SQL = """pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbour,
         round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM pairs
        QUALIFY rank <= 15)"""

KNN_ROWS_SQL = f"WITH {KNN_SQL} SELECT vec_id, rank, neighbour, round(distance, 6) AS distance FROM knn"


def near(df: DataFrame) -> DataFrame:
    return df.select("vec_id", big("rank").alias("rank"), "neighbour", rounded("distance").alias("distance"))


@query("v6_knn_cosine", KNN_ROWS_SQL)
def v6(spark: SparkSession, sf: str) -> DataFrame:
    return near(neighbours.knn_cosine(embeddings(spark, sf), "vec_id", "embedding"))


@query("v6_knn_cosine_cells", KNN_ROWS_SQL)
def v6_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same, with many pivots and blocks as a large table has."""
    return near(neighbours.knn_cosine(embeddings(spark, sf), "vec_id", "embedding", rows_per_pivot=25, block_rows=16))


@query("v6_knn_descent")
def v6_descent(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate neighbours of every vector; ``v6_knn_recall`` holds them against the exact ones."""
    return near(descent.knn_descent(embeddings(spark, sf), "vec_id", "embedding"))


@query("v6_knn_recall", f"WITH {KNN_SQL} SELECT count(*) AS wanted, TRUE AS nine_tenths_found FROM knn")
def v6_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many of all exact neighbours the descent found."""
    found = descent.knn_descent(embeddings(spark, sf), "vec_id", "embedding")
    exact = neighbours.knn_cosine(embeddings(spark, sf), "vec_id", "embedding")
    return descent.recall(found, exact, "vec_id").select("wanted", (10 * F.col("hits") >= 9 * F.col("wanted")).alias("nine_tenths_found"))


FUZZY_SQL = f"""RECURSIVE {KNN_SQL},
r AS (SELECT vec_id, coalesce(min(distance) FILTER (distance > 0), 0) AS rho, log2(count(*)) AS target, count(*) AS k FROM knn GROUP BY vec_id),
g AS (SELECT vec_id, neighbour, greatest(distance - rho, 0) AS gap FROM knn JOIN r USING (vec_id)),
gaps AS (SELECT vec_id, list(gap ORDER BY gap, neighbour) AS gaps FROM g GROUP BY vec_id),
s AS (SELECT vec_id, 0 AS step, 0.0::DOUBLE AS lo, 'infinity'::DOUBLE AS hi, 1.0::DOUBLE AS mid FROM r
  UNION ALL
  SELECT vec_id, step + 1, lo, hi, CASE WHEN hi = 'infinity'::DOUBLE THEN lo * 2 ELSE (lo + hi) / 2 END FROM (
    SELECT vec_id, step, CASE WHEN wide THEN lo ELSE mid END AS lo, CASE WHEN wide THEN mid ELSE hi END AS hi FROM (
      SELECT s.vec_id, step, lo, hi, mid, list_sum(list_transform(gaps, lambda x: exp(-x / mid))) > target AS wide
      FROM s JOIN gaps USING (vec_id) JOIN r USING (vec_id) WHERE step < 64))),
w AS (SELECT g.vec_id, neighbour, exp(-gap / mid) AS weight FROM g JOIN s ON g.vec_id = s.vec_id AND s.step = 64)"""


@query("v7_fuzzy_weights", f"WITH {FUZZY_SQL} SELECT vec_id, neighbour, round(weight, 6) AS weight FROM w")
def v7_weights(spark: SparkSession, sf: str) -> DataFrame:
    df = neighbours.fuzzy_weights(neighbours.knn_cosine(embeddings(spark, sf), "vec_id", "embedding"), "vec_id")
    return df.withColumn("weight", rounded("weight"))


@query(
    "v7_fuzzy_union",
    f"""WITH {FUZZY_SQL}
SELECT least(vec_id, neighbour) AS a, greatest(vec_id, neighbour) AS b,
  round(sum(weight) - CASE WHEN count(*) = 2 THEN min(weight) * max(weight) ELSE 0 END, 6) AS weight
FROM w GROUP BY a, b""",
)
def v7(spark: SparkSession, sf: str) -> DataFrame:
    weights = neighbours.fuzzy_weights(neighbours.knn_cosine(embeddings(spark, sf), "vec_id", "embedding"), "vec_id")
    return neighbours.fuzzy_union(weights, "vec_id").withColumn("weight", rounded("weight"))


# an embedding read as eight token vectors of eight dimensions; the mask keeps the first label % 9 of them
POOL_SQL = """WITH t AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, i % 8 AS dim, round(coalesce(sum(x) FILTER (i // 8 < label % 9), 0) / greatest(any_value(label % 9), 1e-9), 6)
  + 0.0::DOUBLE AS x FROM t GROUP BY vec_id, label, i % 8"""


def token_arrays(spark: SparkSession, sf: str) -> DataFrame:
    eight = F.sequence(F.lit(0), F.lit(7))
    tokens = F.transform(eight, lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    mask = F.transform(eight, lambda i: (i < F.col("label") % 9).cast("int"))
    return embeddings(spark, sf).select("vec_id", tokens.alias("tokens"), mask.alias("mask"))


@query("v8_mean_pool", POOL_SQL)
def v8(spark: SparkSession, sf: str) -> DataFrame:
    pooled = vectors.masked_mean(F.col("tokens"), F.col("mask"), 8)
    return long(token_arrays(spark, sf).select("vec_id", pooled.alias("v")), "vec_id", "v", "x")


@query("v8_mean_pool_long", POOL_SQL)
def v8_long(spark: SparkSession, sf: str) -> DataFrame:
    zipped = F.arrays_zip("tokens", "mask")
    table = token_arrays(spark, sf).select("vec_id", F.posexplode(zipped).alias("pos", "t"))
    table = table.select("vec_id", "pos", F.col("t.tokens").alias("vec"), F.col("t.mask").alias("mask"))
    return long(encode.pool_token_table(table, "vec_id", "vec", "mask", 8), "vec_id", "vector", "x")


FIRST_SQL = """SELECT vec_id, generate_subscripts(v, 1) - 1 AS dim, round(unnest(v), 6) + 0.0::DOUBLE AS x
FROM (SELECT vec_id, embedding[1:8]::DOUBLE[] AS v FROM embeddings)"""


@query("v9_first_pool", FIRST_SQL)
def v9(spark: SparkSession, sf: str) -> DataFrame:
    first = vectors.first_token(F.col("tokens")).cast("array<double>")
    return long(token_arrays(spark, sf).select("vec_id", first.alias("v")), "vec_id", "v", "x")


@query("v9_first_pool_long", FIRST_SQL)
def v9_long(spark: SparkSession, sf: str) -> DataFrame:
    table = token_arrays(spark, sf).select("vec_id", F.posexplode("tokens").alias("pos", "vec"))
    first = encode.first_token_table(table, "vec_id", "vec", "pos")
    return long(first.withColumn("vector", F.col("vector").cast("array<double>")), "vec_id", "vector", "x")


@query(
    "v10_encode",
    f"""WITH k AS (SELECT doc_id, ({TOKENS_SQL})[1:128] AS k FROM documents),
t AS (SELECT doc_id, md5(unnest(k)) AS h, len(k) AS n FROM k),
c AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS dim, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) / any_value(n)::DOUBLE AS x
      FROM t GROUP BY doc_id, dim)
SELECT d.doc_id, r.dim, round(coalesce(x, 0), 6) + 0.0::DOUBLE AS x
FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS dim) r LEFT JOIN c ON c.doc_id = d.doc_id AND c.dim = r.dim""",
)
def v10(spark: SparkSession, sf: str) -> DataFrame:
    df = spread_documents(spark, sf, "doc_id", "text")
    return long(encode.encode_texts(df, "doc_id", "text"), "doc_id", "vector", "x")


@query("s6_cached_vectors", ORACLES["v10_encode"])
def s6_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The store holds other texts under the ids of the labelled documents, then the right ones; all are read."""
    df = spread_documents(spark, sf, "doc_id", "text")
    path = scratch_path(spark, "vectors")

    def encoded(rows: DataFrame) -> DataFrame:
        return encode.encode_texts(rows, "digest", "text")

    known = take_rows(df, read_table(spark, sf, "labels"), "doc_id")
    edited = known.withColumn("text", F.concat(F.lit("edited "), "text"))
    for rows in (edited, known):
        cached_vectors(spark, rows, path, "text", "hash64-128", encoded)
    return long(cached_vectors(spark, df, path, "text", "hash64-128", encoded), "doc_id", "vector", "x")


@query(
    "m6_softmax_argmax",
    """WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS s FROM embeddings),
e AS (SELECT vec_id, s, list_transform(s, lambda x: exp(x - list_max(s))) AS e FROM t)
SELECT vec_id, (list_position(s, list_max(s)) - 1)::BIGINT AS prediction, generate_subscripts(e, 1) - 1 AS dim,
  round(unnest(e) / list_sum(e), 6) AS p FROM e""",
)
def m6(spark: SparkSession, sf: str) -> DataFrame:
    df = embeddings(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("s"))
    scored = df.select("vec_id", vectors.argmax(F.col("s")).alias("prediction"), vectors.softmax(F.col("s")).alias("p"))
    cells = scored.select("vec_id", "prediction", F.posexplode("p").alias("dim", "p"))
    return cells.select("vec_id", big("prediction").alias("prediction"), big("dim").alias("dim"), rounded("p").alias("p"))
