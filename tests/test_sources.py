import datetime

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.session import scratch_path
from lexiloom.sources import json_lines, results


def write(tmp_path, lines):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


SCHEMA = "text string, user struct<description: string>, extended_tweet struct<full_text: string>, label int"


def test_blank_lines_are_skipped(spark, tmp_path):
    path = write(tmp_path, ['{"text": "a"}', "", "   ", '{"text": "b"}'])
    assert sorted(r.text for r in json_lines.read_jsonl(spark, path, "text string").collect()) == ["a", "b"]


def test_malformed_line_raises(spark, tmp_path):
    path = write(tmp_path, ['{"text": "a"}', '{"text": '])
    with pytest.raises(Exception, match="(?i)malformed"):
        json_lines.read_jsonl(spark, path, "text string").collect()


def test_load_labelled_flattens_and_repairs(spark, tmp_path):
    path = write(
        tmp_path,
        [
            '{"text": "a", "user": {"description": "d"}, "extended_tweet": {"full_text": "long"}, "label": 1}',
            '{"text": "b", "user": {"description": null}, "label": 0}',
            '{"text": "c", "extended_tweet": {"full_text": ""}, "label": 0}',
        ],
    )
    df = json_lines.load_labelled(spark, path, SCHEMA)
    assert df.columns == ["text", "user_description", "extended_tweet_full_text", "label", "full_text"]
    assert {r.text: r.full_text for r in df.collect()} == {"a": "long", "b": "b", "c": ""}
    nonempty = json_lines.load_labelled(spark, path, SCHEMA, nonempty=True)
    assert {r.text: r.full_text for r in nonempty.collect()}["c"] == "c"


def test_load_without_extended_object(spark, tmp_path):
    path = write(tmp_path, ['{"text": "a", "challenge_id": "7"}'])
    row = json_lines.load_scoring(spark, path).first()
    assert (row.full_text, row.challenge_id) == ("a", 7)
    with pytest.raises(ValueError, match="key"):
        json_lines.load_scoring(spark, path, key="other")


def test_flatten_keeps_lists_and_refuses_collisions(spark):
    df = spark.sql("SELECT named_struct('b', named_struct('c', 1), 'l', array(1, 2)) AS a, 2 AS x")
    flat = json_lines.flatten(df)
    assert flat.columns == ["a_b_c", "a_l", "x"]
    assert flat.first().a_l == [1, 2]
    with pytest.raises(ValueError, match="collide"):
        json_lines.flatten(spark.sql("SELECT named_struct('b', 1) AS a, 2 AS a_b"))


def test_coerce_bad_value_is_null(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "k string")
    assert [r.k for r in json_lines.coerce_types(df, {"k": "bigint"}).collect()] == [1, None, None]


def test_submission_file(spark, tmp_path):
    df = spark.createDataFrame([("3", 1.0), ("4", 0.0)], "challenge_id string, prediction double")
    path = results.write_submission(df, str(tmp_path), "model", "challenge_id", day=datetime.date(2024, 5, 6))
    assert path.endswith("model_20240506.csv")
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["ID", "Prediction"]
    assert sorted(map(tuple, back.collect())) == [("3", "1"), ("4", "0")]


def test_cached_vectors_belong_to_the_text(spark):
    seen = []

    def encode(df):
        seen.append(sorted(str(r.t) for r in df.collect()))
        return df.select("digest", F.array(F.length(F.coalesce("t", F.lit(""))).cast("double")).alias("vector"))

    path = scratch_path(spark, "store")
    one = spark.createDataFrame([(1, "a"), (2, "bb"), (2, "bb"), (None, "bb"), (4, None)], "k long, t string")
    two = spark.createDataFrame([(1, "ccc"), (2, "bb"), (3, "")], "k long, t string")  # an id with another text
    got = results.cached_vectors(spark, one, path, "t", "base", encode)
    assert sorted(((r.k, r.vector) for r in got.collect()), key=repr) == sorted([(1, [1.0]), (2, [2.0]), (2, [2.0]), (None, [2.0]), (4, [0.0])], key=repr)
    both = results.cached_vectors(spark, two, path, "t", "base", encode)
    assert sorted((r.k, r.vector) for r in both.collect()) == [(1, [3.0]), (2, [2.0]), (3, [0.0])]
    results.cached_vectors(spark, two, path, "t", "tuned", encode)
    assert seen == [["None", "a", "bb"], ["", "ccc"], ["", "bb", "ccc"]]
    encode(one.limit(1).withColumn("digest", results.content_key("t"))).write.mode("append").parquet(f"{path}/encoder_id=base")
    assert results.cached_vectors(spark, one, path, "t", "base", encode).count() == 5  # a text that was appended twice


def test_the_store_is_not_shuffled(spark):
    """Looking up what is stored moves the texts' digests; removing repeats and compaction keep each text once."""

    def encode(df):
        return df.select("digest", F.array(F.length("t").cast("double")).alias("vector"))

    path, other = scratch_path(spark, "store"), scratch_path(spark, "store")
    df = spark.range(300).selectExpr("id", "concat('text ', id) as t")
    results.cached_vectors(spark, df, path, "t", "e", encode, buckets=4)
    kind = T.ArrayType(T.DoubleType())
    store = results.open_store(spark, path, "e", kind, 4)
    spark.table(store).limit(50).repartition(4, "digest").write.insertInto(store)  # another run had them too
    assert spark.table(store).count() == 350
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = results.cached_vectors(spark, df, path, "t", "e", encode, buckets=4)
        assert got.count() == 300
        plan = got._jdf.queryExecution().sparkPlan().toString()
        executed = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    stored = executed[executed.index("SortAggregate") if "SortAggregate" in executed else executed.index("Aggregate") :]
    assert "vectors_" in plan and "Bucketed: true" in stored and "Exchange" not in stored
    results.compact_store(spark, path, other, "e", kind, 4)
    compact = spark.table(results.open_store(spark, other, "e", kind, 4))
    assert compact.count() == 300 and compact.select("digest").distinct().count() == 300


def test_a_missing_vector_is_an_error(spark):
    df = spark.createDataFrame([(1, "a")], "k long, t string")
    with pytest.raises(Exception, match="does not hold"):
        results.cached_vectors(spark, df, scratch_path(spark, "store"), "t", "none", lambda d: d.limit(0).select("digest", F.array(F.lit(1.0)).alias("vector"))).collect()


def test_model_round_trip(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    path = scratch_path(spark, "model")
    results.save_model(PipelineModel([VectorAssembler(inputCols=["a", "b"], outputCol="v")]), path)
    assert list(results.load_model(path).transform(df).first().v) == [1.0, 2.0]
