"""Splits, groups, feature scores and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.catalog.registry import big, query, rounded
from lexiloom.catalog.tables import SCORED_SQL, documents, fold_sql, scored
from lexiloom.operators import groups, metrics, selection, splits
from lexiloom.operators.information import neighbour_information
from lexiloom.sources.tables import read_table


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rows of a user; urgent ones have no user."""
    user = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey"))
    return read_table(spark, sf, "orders").select("o_orderkey", user.alias("user"))


ORDERS_SQL = """o AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS "user" FROM orders)"""

GROUP_SQL = f"""WITH {ORDERS_SQL},
g AS (SELECT "user", row_number() OVER (ORDER BY md5('42:' || "user")) AS r, count(*) OVER () AS n
      FROM (SELECT DISTINCT "user" FROM o WHERE "user" IS NOT NULL)),
split AS (SELECT o_orderkey, "user", CASE WHEN r <= ceil(round(0.1::DOUBLE * n, 9)) THEN 'val' ELSE 'train' END AS split
          FROM o JOIN g USING ("user"))"""


@query("k1_stratified_folds", fold_sql("(SELECT doc_id, quality FROM labels)", "doc_id", "quality"))
def k1(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_folds(labels(spark, sf), "doc_id", "label").withColumn("fold", big("fold"))


@query(
    "k1_fold_balance",
    f"SELECT fold, label, count(*) AS n FROM ({fold_sql('orders', 'o_orderkey', 'o_orderstatus')}) GROUP BY ALL",
)
def k1_balance(spark: SparkSession, sf: str) -> DataFrame:
    df = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    folds = splits.stratified_folds(df, "o_orderkey", "label")
    return folds.groupBy(big("fold").alias("fold"), "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k2_stratified_holdout",
    """SELECT doc_id, quality AS label,
  CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id))
            <= ceil(round(0.2::DOUBLE * count(*) OVER (PARTITION BY quality), 9)) THEN 'val' ELSE 'train' END AS split
FROM labels""",
)
def k2(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_holdout(labels(spark, sf), "doc_id", "label", 0.2)


@query(
    "k3_random_holdout",
    """SELECT doc_id, CASE WHEN ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT < round(0.1::DOUBLE * 4294967296)
  THEN 'val' ELSE 'train' END AS split FROM documents""",
)
def k3(spark: SparkSession, sf: str) -> DataFrame:
    return splits.random_holdout(documents(spark, sf).select("doc_id"), "doc_id", 0.1)


@query(
    "k3_exact_holdout",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id)) <= ceil(round(0.1::DOUBLE * count(*) OVER (), 9))
  THEN 'val' ELSE 'train' END AS split FROM documents""",
)
def k3_exact(spark: SparkSession, sf: str) -> DataFrame:
    return splits.random_holdout(documents(spark, sf).select("doc_id"), "doc_id", 0.1, exact=True)


@query("k4_group_holdout", f"{GROUP_SQL} SELECT * FROM split")
def k4(spark: SparkSession, sf: str) -> DataFrame:
    return splits.group_holdout(orders(spark, sf), "user", 0.1)


@query(
    "k4_leak_check",
    f"""{GROUP_SQL} SELECT count(*) AS users, count_if(sides > 1)::BIGINT AS leaking
FROM (SELECT "user", count(DISTINCT split) AS sides FROM split GROUP BY "user")""",
)
def k4_leak(spark: SparkSession, sf: str) -> DataFrame:
    per_user = splits.group_holdout(orders(spark, sf), "user", 0.1).groupBy("user").agg(
        F.bool_or(F.col("split") == "val").alias("val"), F.bool_or(F.col("split") == "train").alias("train")
    )
    return per_user.agg(
        F.count(F.lit(1)).alias("users"), F.count_if(F.col("val") & F.col("train")).alias("leaking")
    )


@query(
    "k5_first_per_group",
    f"""{GROUP_SQL} SELECT o_orderkey, "user", split FROM split
QUALIFY split = 'val' OR row_number() OVER (PARTITION BY "user" ORDER BY o_orderkey) = 1""",
)
def k5(spark: SparkSession, sf: str) -> DataFrame:
    return splits.first_per_train_group(orders(spark, sf), "user", "o_orderkey", 0.1)


@query(
    "g1_group_ids",
    f"""WITH {ORDERS_SQL} SELECT "user", 0::BIGINT AS part, md5(string_agg(o_orderkey, ',' ORDER BY o_orderkey)) AS ids
FROM o WHERE "user" IS NOT NULL GROUP BY "user" """,
)
def g1(spark: SparkSession, sf: str) -> DataFrame:
    df = groups.group_ids(orders(spark, sf), "user", "o_orderkey")
    return df.withColumn("ids", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")))


@query(
    "g1_group_ids_parts",
    """SELECT source, part, string_agg(doc_id, ',' ORDER BY doc_id) AS ids
FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS part FROM documents)
GROUP BY source, part""",
)
def g1_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Groups above the bound come in numbered parts; here the bound is 16 rows."""
    df = groups.group_ids(documents(spark, sf), "source", "doc_id", part_rows=16)
    return df.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("g2_explode", f"""WITH {ORDERS_SQL} SELECT "user", o_orderkey FROM o WHERE "user" IS NOT NULL""")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    return groups.ungroup(groups.group_ids(orders(spark, sf), "user", "o_orderkey"), "user", key="o_orderkey")


@query(
    "g3_user_texts",
    """SELECT conv_id, 0::BIGINT AS part, md5(string_agg(text, ' ' ORDER BY turn)) AS full_text_agg,
  md5(conv_id || ' ' || string_agg(text, ' ' ORDER BY turn)) AS combined_text
FROM conversations GROUP BY conv_id""",
)
def g3(spark: SparkSession, sf: str) -> DataFrame:
    df = groups.user_texts(read_table(spark, sf, "conversations"), "conv_id", "turn", "text")
    return df.withColumns({c: F.md5(c) for c in ("full_text_agg", "combined_text")})


@query(
    "g3_user_texts_parts",
    """WITH r AS (
  SELECT source, doc_id, text, quality,
    (coalesce(sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      // 20000)::BIGINT AS part,
    first_value(quality) OVER (PARTITION BY source ORDER BY doc_id) AS label
  FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, part, any_value(label) AS label, md5(string_agg(text, ' ' ORDER BY doc_id)) AS full_text_agg,
  md5(CASE WHEN part = 0 THEN source || ' ' ELSE '' END || string_agg(text, ' ' ORDER BY doc_id)) AS combined_text
FROM r GROUP BY source, part""",
)
def g3_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of a user with more than 20,000 characters come in parts; the label is that of the first row."""
    df = documents(spark, sf).join(labels(spark, sf), "doc_id", "left")
    out = groups.user_texts(df, "source", "doc_id", "text", label="label", part_chars=20_000)
    return out.withColumns({c: F.md5(c) for c in ("full_text_agg", "combined_text")})


@query(
    "g4_first_label",
    """SELECT source, quality AS label FROM documents JOIN labels USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1""",
)
def g4(spark: SparkSession, sf: str) -> DataFrame:
    df = documents(spark, sf).select("doc_id", "source").join(labels(spark, sf), "doc_id")
    return groups.first_label(df, "source", "doc_id", "label")


@query(
    "g5_label_join",
    """WITH l AS (SELECT lang, max(quality) AS label FROM documents JOIN labels USING (doc_id) WHERE lang <> 'fr' GROUP BY lang),
t AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)
SELECT lang, source, n, label FROM t LEFT JOIN l USING (lang)""",
)
def g5(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "lang", "source")
    known = docs.filter("lang <> 'fr'").join(labels(spark, sf), "doc_id").groupBy("lang").agg(F.max("label").alias("label"))
    return groups.attach_labels(docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), known, "lang")


FOLD_SCORES_SQL = f"""f AS ({fold_sql('(SELECT doc_id, quality FROM labels)', 'doc_id', 'quality')}),
s AS (SELECT fold, avg((n_chars > 1500)::INT = f.label) AS accuracy
      FROM (SELECT fold, label, n_chars FROM f JOIN documents USING (doc_id)) f GROUP BY fold)""".replace(
    "avg((n_chars > 1500)::INT = f.label)", "avg(((n_chars > 1500)::INT = f.label)::INT)"
)


def folded(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_folds(scored(spark, sf), "doc_id", "label")


@query("g6_fold_summary", f"WITH {FOLD_SCORES_SQL} SELECT round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std FROM s")
def g6(spark: SparkSession, sf: str) -> DataFrame:
    per_fold = folded(spark, sf).groupBy("fold").agg(metrics.accuracy().alias("accuracy"))
    df = groups.fold_summary(per_fold, "accuracy")
    return df.select(rounded("mean").alias("mean"), rounded("std").alias("std"))


@query(
    "g7_class_weights",
    """SELECT l_returnflag, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight
FROM lineitem GROUP BY l_returnflag""",
)
def g7(spark: SparkSession, sf: str) -> DataFrame:
    items = read_table(spark, sf, "lineitem")
    weights = groups.class_weight_table(items, "l_returnflag")
    weighted = groups.with_class_weight(groups.class_counts(items, "l_returnflag"), "l_returnflag", weights)
    return weighted.withColumn("weight", rounded("weight"))


@query(
    "g9_group_ratio",
    """SELECT count(*) AS "rows", count(DISTINCT o_custkey) AS groups,
  round(count(*) / count(DISTINCT o_custkey)::DOUBLE, 6) AS rows_per_group FROM orders""",
)
def g9(spark: SparkSession, sf: str) -> DataFrame:
    df = groups.group_ratio(read_table(spark, sf, "orders"), "o_custkey")
    return df.withColumn("rows_per_group", rounded("rows_per_group"))


@query(
    "g10_top_k",
    """SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey
ORDER BY spent DESC, o_custkey LIMIT 10""",
)
def g10(spark: SparkSession, sf: str) -> DataFrame:
    spent = read_table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return groups.top_k(spent, "spent", "o_custkey", 10)


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

UNPIVOT_SQL = "u AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, l_returnflag AS cls, {c} AS x FROM lineitem" for c in FEATURES
) + ")"

ANOVA_SQL = f"""{UNPIVOT_SQL},
c AS (SELECT feature, cls, count(*)::DOUBLE AS n, avg(x) AS m, var_pop(x) AS v FROM u GROUP BY ALL),
a AS (SELECT feature, avg(x) AS m FROM u GROUP BY feature),
f AS (SELECT feature, round((sum(n * (c.m - a.m) * (c.m - a.m)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) AS f
      FROM c JOIN a USING (feature) GROUP BY feature)"""


@query("r1_anova_f", f"WITH {ANOVA_SQL} SELECT feature, f FROM f")
def r1(spark: SparkSession, sf: str) -> DataFrame:
    df = selection.anova_f(read_table(spark, sf, "lineitem"), FEATURES, "l_returnflag")
    return df.withColumn("f", rounded("f"))


@query("r2_select_k_best", f"WITH {ANOVA_SQL} SELECT feature, f FROM f ORDER BY f DESC, feature LIMIT 2")
def r2(spark: SparkSession, sf: str) -> DataFrame:
    df = selection.select_k_best(read_table(spark, sf, "lineitem"), FEATURES, "l_returnflag", 2)
    return df.withColumn("f", rounded("f"))


@query(
    "r3_mutual_info",
    f"""WITH {UNPIVOT_SQL},
e AS (SELECT feature, unnest(quantile_disc(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM u GROUP BY feature),
b AS (SELECT u.feature, cls, (SELECT count(DISTINCT edge) FROM e WHERE e.feature = u.feature AND u.x > e.edge) AS bin FROM u),
j AS (SELECT feature, bin, cls, count(*)::DOUBLE AS n FROM b GROUP BY ALL),
p AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, cls) AS nc,
             sum(n) OVER (PARTITION BY feature) AS nt FROM j)
SELECT feature, round(sum(n / nt * ln(n * nt / (nb * nc))), 6) AS mi FROM p GROUP BY feature""",
)
def r3(spark: SparkSession, sf: str) -> DataFrame:
    items = read_table(spark, sf, "lineitem").select(*FEATURES, "l_returnflag")
    df = selection.mutual_information(items, FEATURES, "l_returnflag")
    return df.withColumn("mi", rounded("mi"))


@query(
    "r3_neighbour_information",
    """WITH RECURSIVE u AS (SELECT c_mktsegment AS cls, unnest(['c_acctbal', 'c_nationkey']) AS feature, unnest([c_acctbal::DOUBLE, c_nationkey::DOUBLE]) AS x FROM customer),
c AS (SELECT feature, cls, x, count(*) AS m, sum(count(*)) OVER (PARTITION BY feature, cls) AS n FROM u GROUP BY feature, cls, x),
near AS (SELECT a.feature, a.cls, a.x, a.m, a.n, abs(b.x - a.x) AS d, sum(b.m - (b.x = a.x)::INT) AS k
         FROM c a JOIN c b USING (feature, cls) GROUP BY ALL),
upto AS (SELECT *, sum(k) OVER (PARTITION BY feature, cls, x ORDER BY d) AS seen FROM near),
r AS (SELECT feature, cls, x, any_value(m) AS m, any_value(n) AS n, least(3, any_value(n) - 1) AS kth, min(d) FILTER (seen >= least(3, n - 1)) AS d
      FROM upto GROUP BY feature, cls, x),
v AS (SELECT feature, x, count(*) AS n FROM u GROUP BY feature, x),
i AS (SELECT r.feature, cls, r.x, any_value(m) AS m, any_value(r.n) AS n, any_value(kth) AS kth, sum(v.n) AS inside
      FROM r JOIN v ON r.feature = v.feature AND (abs(v.x - r.x) < d - 1e-12::DOUBLE * (abs(r.x) + d) OR v.x = r.x) GROUP BY r.feature, cls, r.x),
h AS (SELECT 1 AS n, 0.0::DOUBLE AS h UNION ALL SELECT n + 1, h + 1.0::DOUBLE / n FROM h WHERE n < (SELECT count(*) FROM customer)),
t AS (SELECT feature, sum(m) AS n, sum(m * (hk.h - hn.h - hi.h)) / sum(m) AS mean
      FROM i JOIN h hk ON hk.n = kth JOIN h hn ON hn.n = i.n JOIN h hi ON hi.n = inside GROUP BY feature)
SELECT feature, round(greatest(h + mean, 0), 6) AS mi FROM t JOIN h USING (n)""",
)
def r3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-neighbour estimate; the harmonic sums in SQL are the digamma function but for a constant that cancels."""
    rows = read_table(spark, sf, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment")
    return neighbour_information(rows, ["c_acctbal", "c_nationkey"], "c_mktsegment").withColumn("mi", rounded("mi"))


@query("e1_accuracy", f"WITH {SCORED_SQL} SELECT round(avg((label = prediction)::INT), 6) AS accuracy FROM scored")
def e1(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).agg(rounded(metrics.accuracy()).alias("accuracy"))


PRF_SQL = """round(count_if(label = 1 AND prediction = 1) / count_if(prediction = 1)::DOUBLE, 6) AS "precision",
  round(count_if(label = 1 AND prediction = 1) / count_if(label = 1)::DOUBLE, 6) AS recall,
  round(2 * count_if(label = 1 AND prediction = 1) / (count_if(label = 1) + count_if(prediction = 1))::DOUBLE, 6) AS f1"""

AUC_SQL = """(SELECT round((sum(r) FILTER (label = 1) - np * (np + 1) / 2.0::DOUBLE) / (np * nn::DOUBLE), 6)
  FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r,
               count_if(label = 1) OVER () AS np, count_if(label = 0) OVER () AS nn FROM scored) GROUP BY np, nn)"""


@query("e2_prf", f"WITH {SCORED_SQL} SELECT {PRF_SQL} FROM scored")
def e2(spark: SparkSession, sf: str) -> DataFrame:
    df = metrics.precision_recall_f1(scored(spark, sf))
    return df.select(*[rounded(c).alias(c) for c in df.columns])


@query("e3_auc", f"WITH {SCORED_SQL} SELECT {AUC_SQL} AS auc")
def e3(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.roc_auc(scored(spark, sf)).select(rounded("auc").alias("auc"))


@query(
    "e4_logloss",
    f"""WITH {SCORED_SQL}
SELECT round(avg(-ln(greatest(CASE WHEN label = 1 THEN score ELSE 1 - score END, 1e-15))), 6) AS logloss FROM scored""",
)
def e4(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).agg(rounded(metrics.log_loss(probability="score")).alias("logloss"))


@query(
    "e5_metrics_row",
    f"""WITH {SCORED_SQL} SELECT round(avg((label = prediction)::INT), 6) AS accuracy, {PRF_SQL}, {AUC_SQL} AS auc FROM scored""",
)
def e5(spark: SparkSession, sf: str) -> DataFrame:
    df = metrics.metric_row(scored(spark, sf))
    return df.select(*[rounded(c).alias(c) for c in df.columns])


@query(
    "e6_fold_report",
    f"""WITH {FOLD_SCORES_SQL} SELECT fold, round(accuracy, 6) AS accuracy,
  round(avg(accuracy) OVER (), 6) AS mean, round(stddev_pop(accuracy) OVER (), 6) AS std FROM s""",
)
def e6(spark: SparkSession, sf: str) -> DataFrame:
    df = metrics.fold_report(folded(spark, sf))
    return df.select(big("fold").alias("fold"), *[rounded(c).alias(c) for c in ("accuracy", "mean", "std")])
