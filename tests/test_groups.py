import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import groups, ordering


@pytest.fixture
def skewed(spark):
    """A third of the rows share one key."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 40))
    return spark.range(3000).select("id", key.alias("g"), F.concat(F.lit("t"), F.col("id")).alias("text"), (F.col("id") % 2).alias("label"))


@pytest.fixture
def many_buckets(monkeypatch):
    monkeypatch.setattr(ordering.order_cuts, "__defaults__", (None, 10, 8, 16))


def members(df):
    out = {}
    for r in df.select("id", "g", "text").filter("g is not null").orderBy("id").collect():
        out.setdefault(r.g, []).append((r.id, r.text))
    return out


def test_group_ids_keep_every_member_in_order(skewed, many_buckets):
    parts = {}
    for r in groups.group_ids(skewed, "g", "id", part_rows=100).collect():
        assert len(r.ids) <= 100
        parts[r.g, r.part] = r.ids
    want = members(skewed)
    for g, rows in want.items():
        got = [parts[g, p] for p in range(sum(k == g for k, _ in parts))]
        assert [i for ids in got for i in ids] == [i for i, _ in rows]
    assert sum(k == "hot" for k, _ in parts) == 10
    assert groups.ungroup(groups.group_ids(skewed, "g", "id"), "g").count() == sum(map(len, want.values()))


def test_user_texts_join_to_the_whole(skewed, many_buckets):
    got = {}
    for r in groups.user_texts(skewed, "g", "id", "text", "label", part_chars=500).collect():
        got.setdefault(r.g, {})[r.part] = r
    for g, rows in members(skewed).items():
        parts = [got[g][p] for p in sorted(got[g])]
        assert " ".join(p.full_text_agg for p in parts) == " ".join(t for _, t in rows)
        assert " ".join(p.combined_text for p in parts) == f"{g} " + " ".join(t for _, t in rows)
        assert {p.label for p in parts} == {rows[0][0] % 2}
    assert len(got["hot"]) > 5


def test_null_text_is_spelled_out(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x")], "g string, id long, text string")
    assert groups.user_texts(df, "g", "id", "text").first().combined_text == "a nan x"


def test_running_totals_over_negative_and_equal_steps(spark, many_buckets):
    values = [(float(v),) for v in (-5, -4.5, 0, 0.25, 1e9, 2, 3, 7, 8, 9)] + [(float(v),) for v in range(100, 300)]
    df = spark.createDataFrame(values, "x double")
    (cuts,) = ordering.order_cuts(df, ["x"])
    assert len(cuts.cuts) > 1 and cuts.fine > 1
    got = {r.x: r.before for r in ordering.running_totals(df, [], "x", {"before": F.lit(1)}, cuts).collect()}
    assert got == {v: i for i, v in enumerate(sorted(v for v, in values))}


def test_exact_quantiles(spark, many_buckets):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=5001), np.where(rng.random(5001) < 0.4, 7.0, rng.integers(0, 50, 5001))
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double").repartition(5)
    shares = [0.1, 0.25, 0.5, 0.9, 1.0]
    want = {c: [float(v) for v in np.quantile(x, shares, method="inverted_cdf")] for c, x in (("a", a), ("b", b))}
    assert ordering.exact_quantiles(df, ["a", "b"], shares) == want


def test_first_label_weights_and_top_k(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 1, 0), ("b", 3, 1), ("b", 4, 1)], "g string, id long, label int")
    assert dict(groups.first_label(df, "g", "id", "label").collect()) == {"a": 0, "b": 1}
    assert groups.class_weights(df, "label") == {0: 4 / 2, 1: 4 / 6}
    scores = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", 3.0), ("d", 1.0), ("e", None)], "name string, s double")
    assert [r.name for r in groups.top_k(scores, "s", "name", 4).collect()] == ["c", "a", "d", "b"]
    tied = spark.createDataFrame([(1,), (0,), (1,), (0,), (None,)], "label int")
    assert groups.majority_class(tied, "label") == 0


@pytest.mark.parametrize("n", [150_000, 250_000])
@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_a_hot_group_keeps_null_and_string_keys(spark, n, kind):
    key = F.when(F.col("id") % 10 == 3, None).otherwise(F.col("id")) if kind == "bigint" else F.format_string("row%09d", "id")
    df = spark.range(n).select(key.cast(kind).alias("k"), F.lit("hot").alias("g"), F.lit("ab").alias("t"))
    parts = groups.user_texts(df, "g", "k", "t", part_chars=100_000)
    assert parts.agg(F.sum(F.size(F.split("full_text_agg", " ")))).first()[0] == n
    ids = groups.group_ids(df, "g", "k", part_rows=40_000)
    assert ids.agg(F.sum(F.size("ids"))).first()[0] == df.where("k is not null").count()


def test_weights_of_many_classes(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("label"))
    weighted = groups.with_class_weight(df, "label", groups.class_weight_table(df, "label"))
    assert weighted.where("abs(weight - 1) < 1e-12").count() == 20_000
