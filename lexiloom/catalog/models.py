"""Trained models, their evaluation and tuning. Iterative fits have no SQL; the rest does."""

from __future__ import annotations

from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.catalog.registry import big, query, rounded
from lexiloom.catalog.tables import documents, fold_sql, spread_documents
from lexiloom.catalog.text import grams_sql, vocabulary_sql
from lexiloom.functions.text import surface_features
from lexiloom.operators.encode import encode_texts
from lexiloom.operators.rows import except_rows
from lexiloom.operators.tfidf import LARGE
from lexiloom.plans import classifiers, training
from lexiloom.plans.features import FEATURES, Inputs, apply, number_stages, prepare, text_metadata_stages
from lexiloom.session import materialise
from lexiloom.sources.tables import read_table

GBT_ROUNDS = 300
NUMBERS = ("tweet_length", "word_count", "hashtags_count", "mentions_count", "urls_count")
TEXT = Inputs("doc_id", text="text")
FULL = Inputs("doc_id", text="text", numbers=NUMBERS, category="source")
DENSE = Inputs("doc_id", numbers=NUMBERS, category="source", vector="embedding")
VECTOR_CLASS = Inputs("vec_id", vector="embedding")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with metadata; ``label`` is null where there is none."""
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = spread_documents(spark, sf, "doc_id", "text", "source")
    return docs.join(labels, "doc_id", "left").withColumns(surface_features("text"))


def labelled(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label").isNotNull())


def with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every labelled document with the vector of its text."""
    rows = labelled(texts(spark, sf))
    vectors = encode_texts(rows, "doc_id", "text", encoder_id="hash64-128").withColumnRenamed("vector", "embedding")
    return rows.join(vectors, "doc_id")


def vector_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings of the lower five classes against those of the upper five."""
    return read_table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("label"))


def classes(scored: DataFrame, key: str) -> DataFrame:
    return scored.select(key, "label", F.col("prediction").cast("int").alias("prediction"))


def probabilities(scored: DataFrame, key: str) -> DataFrame:
    p = rounded(vector_to_array("probability")[1]).alias("probability")
    return scored.select(key, "label", F.col("prediction").cast("int").alias("prediction"), p)


@query(
    "v3_assembled",
    f"""WITH train AS (SELECT doc_id, text, source, length(text) AS n FROM documents SEMI JOIN labels USING (doc_id)),
{grams_sql('train', 'doc_id', LARGE)}, {vocabulary_sql('doc_id', LARGE)},
tfs AS (SELECT doc_id, sum(w) / sqrt(sum(w * w)) AS s, count(*) AS nz
  FROM (SELECT doc_id, term, count(*) * (ln((1.0::DOUBLE + any_value(n)) / (1 + any_value(df))) + 1) AS w
        FROM (SELECT doc_id, unnest(g) AS term FROM grams) JOIN vocab USING (term), total GROUP BY doc_id, term) GROUP BY doc_id),
z AS (SELECT doc_id, (n - avg(n) OVER ()) / stddev_pop(n) OVER () AS z FROM train)
SELECT doc_id, (SELECT count(*) FROM vocab) + 1 + (SELECT count(DISTINCT source) FROM train) AS size,
  coalesce(nz, 0) AS terms, round(coalesce(s, 0) + z + 1, 6) AS total
FROM z LEFT JOIN tfs USING (doc_id)""",
)
def v3(spark: SparkSession, sf: str) -> DataFrame:
    """Text, number and level slots side by side: their count, and the sum of all entries."""
    inputs = Inputs("doc_id", text="text", numbers=("tweet_length",), category="source")
    df = prepare(labelled(texts(spark, sf)), inputs)
    rows = apply(text_metadata_stages(df, inputs), df).select(
        "doc_id", vector_to_array("features").alias("v"), vector_to_array("text_features").alias("t")
    )
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x)
    terms = F.size(F.filter("t", lambda x: x != 0))
    return rows.select(
        "doc_id", big(F.size("v")).alias("size"), big(terms).alias("terms"), rounded(total).alias("total")
    )


@query("m1_logreg_scores")
def m1(spark: SparkSession, sf: str) -> DataFrame:
    plan = training.build("logistic_regression")
    return probabilities(training.holdout_scores(labelled(texts(spark, sf)), plan, TEXT), "doc_id")


@query("m1_logreg_metadata_scores")
def m1_metadata(spark: SparkSession, sf: str) -> DataFrame:
    plan = training.build("logistic_regression_metadata")
    return probabilities(training.holdout_scores(labelled(texts(spark, sf)), plan, FULL), "doc_id")


#: two standardised numbers of every labelled document, x1 and x2
PLANE_SQL = """x AS (SELECT doc_id, quality AS t, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS x1, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS x2
  FROM (SELECT doc_id, quality, length(text)::DOUBLE AS a, (length(text) - length(replace(text, '#', '')))::DOUBLE AS b
        FROM documents JOIN labels USING (doc_id)))"""
PLANE = Inputs("doc_id", numbers=("tweet_length", "hashtags_count"))


def _steps_sql(weight: str, target: str, c: float, steps: int) -> str:
    """Repeated ridge regressions in three unknowns: (I + c X'WX) b = c X'Wz, solved by determinants.

    ``weight`` and ``target`` may use t (0 or 1), m (the margin so far) and p (its logistic).
    """
    xs = ("x1", "x2", "1.0::DOUBLE")
    sums = [f"{c}::DOUBLE * sum(w * {xs[i]} * {xs[j]}) + {int(i == j)} AS h{i}{j}" for i in range(3) for j in range(i, 3)]
    sums += [f"{c}::DOUBLE * sum(w * z * {x}) AS r{i}" for i, x in enumerate(xs)]
    return f"""s AS (SELECT 0 AS step, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2
  UNION ALL
  SELECT step + 1,
    (r0 * (h11 * h22 - h12 * h12) - h01 * (r1 * h22 - h12 * r2) + h02 * (r1 * h12 - h11 * r2)) / det,
    (h00 * (r1 * h22 - h12 * r2) - r0 * (h01 * h22 - h12 * h02) + h02 * (h01 * r2 - r1 * h02)) / det,
    (h00 * (h11 * r2 - r1 * h12) - h01 * (h01 * r2 - r1 * h02) + r0 * (h01 * h12 - h11 * h02)) / det
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
    SELECT step, {", ".join(sums)} FROM (
      SELECT *, {weight} AS w, {target} AS z FROM (
        SELECT *, 1 / (1 + exp(-m)) AS p FROM (SELECT s.step, x.*, b0 * x1 + b1 * x2 + b2 AS m FROM s, x WHERE s.step < {steps})))
    GROUP BY step))),
b AS (SELECT * FROM s WHERE step = {steps})"""


def plane(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(labelled(texts(spark, sf)), PLANE)


@query(
    "m1_logreg_two_numbers",
    f"""WITH RECURSIVE {PLANE_SQL}, {_steps_sql("p * (1 - p)", "m + (t - p) / (p * (1 - p))", 1.0, 15)}
SELECT doc_id, round(1 / (1 + exp(-(b0 * x1 + b1 * x2 + b2))), 4) AS probability FROM x, b""",
)
def m1_two(spark: SparkSession, sf: str) -> DataFrame:
    df = plane(spark, sf)
    plan = training.Plan(partial(number_stages, output=FEATURES), partial(classifiers.logistic_regression, solver="newton", tol=1e-12))
    scored = plan.fit(df, PLANE).transform(df)
    return scored.select("doc_id", F.round(vector_to_array("probability")[1], 4).alias("probability"))


@query(
    "m2_svm_two_numbers",
    f"""WITH RECURSIVE {PLANE_SQL}, {_steps_sql("CASE WHEN (2 * t - 1) * m < 1 THEN 2.0::DOUBLE ELSE 0 END", "2.0::DOUBLE * t - 1", 1.0, 40)}
SELECT doc_id, round(b0 * x1 + b1 * x2 + b2, 4) + 0.0::DOUBLE AS margin FROM x, b""",
)
def m2_two(spark: SparkSession, sf: str) -> DataFrame:
    df = plane(spark, sf)
    plan = training.Plan(partial(number_stages, output=FEATURES), classifiers.linear_svm)
    scored = plan.fit(df, PLANE).transform(df)
    return scored.select("doc_id", (F.round(vector_to_array("rawPrediction")[1], 4) + F.lit(0.0)).alias("margin"))


#: rows of a hold-out are known to SQL; a model's scores are not, but it must give each row a probability and not lose to the majority
CHECKED_SQL = """WITH s AS (SELECT doc_id, quality AS label,
  row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id)) <= ceil(round(0.2::DOUBLE * count(*) OVER (PARTITION BY quality), 9)) AS val
  FROM labels)
SELECT doc_id, label, TRUE AS in_range, TRUE AS not_below_majority FROM s WHERE val"""


def checked(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    known = scored.select(key, "label", F.col("prediction").cast("int").alias("c"), vector_to_array("probability")[1].alias("p"))
    known = materialise(known, "scored")
    right, ones, rows = known.agg(F.sum((F.col("c") == F.col("label")).cast("int")), F.sum("label"), F.count(F.lit(1))).first()
    fair = right >= max(ones, rows - ones) * 0.97  # a tie with the majority counts, and chance on few rows
    return known.select(key, "label", (F.col("p").between(0, 1) & F.col("c").isin(0, 1)).alias("in_range"), F.lit(fair).alias("not_below_majority"))


@query("m3_gbt_checked", CHECKED_SQL)
def m3_checked(spark: SparkSession, sf: str) -> DataFrame:
    plan = training.build("boosted_trees", rounds=GBT_ROUNDS, depth=5)
    return checked(training.holdout_scores(with_vectors(spark, sf), plan, DENSE))


@query(
    "m5_mlp_checked",
    CHECKED_SQL.replace("doc_id", "vec_id").replace("quality", "(label < 5)::INT").replace("FROM labels", "FROM embeddings").replace(
        ", TRUE AS not_below_majority", ""
    ),
)
def m5_checked(spark: SparkSession, sf: str) -> DataFrame:
    """These vectors hold nothing about their class, so no accuracy is asked for."""
    scored = training.holdout_scores(vector_classes(spark, sf), training.build("perceptron"), VECTOR_CLASS)
    return checked(scored, "vec_id").drop("not_below_majority")


@query(
    "m9_cv_checked",
    f"""WITH f AS ({fold_sql('(SELECT doc_id, quality FROM labels)', 'doc_id', 'quality')})
SELECT fold, TRUE AS in_range, TRUE AS not_below_majority FROM f GROUP BY fold""",
)
def m9_checked(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled(texts(spark, sf))
    base = training.cross_validate(df.select("doc_id", "label"), training.build("majority"), Inputs("doc_id"))
    scored = training.cross_validate(df, training.build("logistic_regression"), TEXT)
    both = scored.join(base.withColumnRenamed("accuracy", "base"), "fold")
    fair = F.col("accuracy") >= F.col("base") * 0.97
    return both.select(big("fold").alias("fold"), F.col("accuracy").between(0, 1).alias("in_range"), fair.alias("not_below_majority"))


@query("m10_scored_rows", "SELECT doc_id AS \"ID\", TRUE AS is_class FROM documents ANTI JOIN labels USING (doc_id)")
def m10_rows(spark: SparkSession, sf: str) -> DataFrame:
    return m10(spark, sf).select("ID", F.col("Prediction").isin(0, 1).alias("is_class"))


@query(
    "m11_grid_settings",
    """SELECT r AS rounds, 5 AS depth, k AS components, TRUE AS in_range, 1::BIGINT AS best_settings
FROM (VALUES (100), (300)) a(r), (VALUES (32), (64)) b(k)""",
)
def m11_settings(spark: SparkSession, sf: str) -> DataFrame:
    """All settings of the grid, and that one of them is the best."""
    best = F.sum((F.col("best") & F.col("highest")).cast("bigint")).over(Window.partitionBy())
    rows = m11(spark, sf).withColumn("highest", F.col("accuracy") == F.max("accuracy").over(Window.partitionBy()))
    return rows.select("rounds", "depth", "components", F.col("accuracy").between(0, 1).alias("in_range"), best.alias("best_settings"))


@query("m2_svm_scores")
def m2(spark: SparkSession, sf: str) -> DataFrame:
    plan = training.build("svm")
    return classes(training.holdout_scores(labelled(texts(spark, sf)), plan, TEXT), "doc_id")


@query("m3_gbt_scores")
def m3(spark: SparkSession, sf: str) -> DataFrame:
    plan = training.build("boosted_trees", rounds=GBT_ROUNDS, depth=5)
    return probabilities(training.holdout_scores(with_vectors(spark, sf), plan, DENSE), "doc_id")


@query(
    "m4_majority",
    """SELECT doc_id, (SELECT quality FROM labels GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1) AS prediction
FROM documents""",
)
def m4(spark: SparkSession, sf: str) -> DataFrame:
    known = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    model = training.build("majority").fit(known, Inputs("doc_id"))
    return model.transform(documents(spark, sf).select("doc_id")).select("doc_id", F.col("prediction").cast("int").alias("prediction"))


@query("m5_mlp_scores")
def m5(spark: SparkSession, sf: str) -> DataFrame:
    plan = training.build("perceptron")
    return probabilities(training.holdout_scores(with_vectors(spark, sf), plan, DENSE), "doc_id")


@query("m9_cv_accuracy")
def m9(spark: SparkSession, sf: str) -> DataFrame:
    df = training.cross_validate(labelled(texts(spark, sf)), training.build("logistic_regression"), TEXT)
    return df.select(big("fold").alias("fold"), rounded("accuracy").alias("accuracy"))


@query(
    "m9_cv_majority",
    f"""WITH f AS ({fold_sql('(SELECT doc_id, quality FROM labels)', 'doc_id', 'quality')}),
m AS (SELECT h.fold, f.label AS prediction FROM (SELECT DISTINCT fold FROM f) h JOIN f ON f.fold <> h.fold GROUP BY h.fold, f.label
      QUALIFY row_number() OVER (PARTITION BY h.fold ORDER BY count(*) DESC, f.label) = 1)
SELECT fold, round(avg((label = prediction)::INT), 6) AS accuracy FROM f JOIN m USING (fold) GROUP BY fold""",
)
def m9_majority(spark: SparkSession, sf: str) -> DataFrame:
    known = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    df = training.cross_validate(known, training.build("majority"), Inputs("doc_id"))
    return df.select(big("fold").alias("fold"), rounded("accuracy").alias("accuracy"))


@query("m10_score_unlabelled")
def m10(spark: SparkSession, sf: str) -> DataFrame:
    df = texts(spark, sf)
    known = labelled(df)
    others = except_rows(df, read_table(spark, sf, "labels"), "doc_id").drop("label")
    scored = training.score_unlabelled(known, others, training.build("logistic_regression"), TEXT)
    return scored.select(F.col("doc_id").alias("ID"), F.col("prediction").cast("int").alias("Prediction"))


@query("m11_grid_best")
def m11(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grid; ``best`` marks the chosen setting."""
    results = training.grid_search(
        vector_classes(spark, sf), VECTOR_CLASS, rounds=(100, 300), depths=(5,), components=(32, 64)
    )
    rows = [(r.rounds, r.depth, r.components, round(r.accuracy, 6), i == 0) for i, r in enumerate(results)]
    return spark.createDataFrame(rows, "rounds int, depth int, components int, accuracy double, best boolean")


@query(
    "m12_best_epoch",
    """SELECT c_nationkey AS run, c_custkey AS epoch, c_acctbal AS accuracy FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1""",
)
def m12(spark: SparkSession, sf: str) -> DataFrame:
    runs = read_table(spark, sf, "customer").selectExpr("c_nationkey AS run", "c_custkey AS epoch", "c_acctbal AS accuracy")
    return training.best_epoch(runs, "run", "epoch", "accuracy")


@query("m12_epochs")
def m12_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Every epoch of a head, and what the restored best one does on the held-out rows."""
    states, scored = training.epochs(with_vectors(spark, sf), DENSE)
    restored = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    best = F.row_number().over(Window.orderBy(F.desc("accuracy"), "epoch")) == 1  # one row an epoch
    rows = states.select("epoch", rounded("loss").alias("loss"), rounded("accuracy").alias("accuracy"), best.alias("best"))
    return rows.withColumn("restored", F.when(F.col("best"), F.lit(round(restored, 6))))
