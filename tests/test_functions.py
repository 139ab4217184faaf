import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import clean, text, tokens, vectors
from lexiloom.functions.stopwords import FRENCH
from lexiloom.operators import schema


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def surface(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in text.surface_features("t").items()]).collect()]


def test_surface_edge_rows(spark):
    assert surface(spark, ["#a @b http://x httpx", None, "", " a b　"]) == [
        (20, 4, 1, 1, 2),
        (3, 1, 0, 0, 0),
        (0, 0, 0, 0, 0),
        (5, 2, 0, 0, 0),
    ]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), min_size=20, max_size=60))
def test_surface_matches_python(spark, values):
    want = [(len(v), len(v.split()), v.count("#"), v.count("@"), v.count("http")) for v in values]
    assert surface(spark, values) == want


def test_full_text_rules(spark):
    t, null, empty = F.lit("a"), F.lit(None).cast("string"), F.lit("")
    row = one(
        spark,
        text.full_text(t, null),
        text.full_text(t, empty),
        text.full_text_nonempty(t, empty),
        text.full_text_nonempty(null, null),
        text.prompt(null, t),
    )
    assert tuple(row) == ("a", "", "a", "", "[user description] nan\n\n[tweet content] a")


def test_metadata_features(spark):
    df = spark.sql("SELECT 'a #b' AS full_text, 7L AS user_statuses_count, '' AS user_location")
    row = df.select(*[c.alias(n) for n, c in text.metadata_features().items()]).first()
    assert tuple(row) == (4, 2, 1, 0, 0, 7, 0)


def test_location(spark):
    values = [F.lit(v).cast("string") for v in (None, "", " ")]
    assert tuple(one(spark, *[text.is_available(v) for v in values])) == (0, 0, 1)


def test_cleaning(spark):
    numbers = [None, math.nan, math.inf, -math.inf, 2.5]
    assert tuple(one(spark, *[clean.clean_number(F.lit(v).cast("double")) for v in numbers])) == (0, 0, 0, 0, 2.5)
    lists = [F.lit(None).cast("array<int>"), F.array().cast("array<int>"), F.array(F.lit(1), F.lit(2))]
    assert tuple(one(spark, *[clean.list_length(v) for v in lists])) == (0, 0, 2)
    flags = [F.lit(v).cast("boolean") for v in (True, False, None)]
    assert tuple(one(spark, *[clean.bool_to_int(v) for v in flags])) == (1, 0, 0)


def test_tokens_and_stop_words(spark):
    words = tokens.word_tokens(F.lit("L'Été, à la_mer 2024 x é"))
    kept = tokens.drop_stop_words(words, FRENCH)
    row = one(spark, words, kept, tokens.truncate(words, 2), tokens.word_tokens(F.lit(None).cast("string")))
    assert tuple(row) == (["été", "la_mer", "2024"], ["la_mer", "2024"], ["été", "la_mer"], [])


def test_pooling_and_softmax(spark):
    v = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0)))
    on, off = F.array(F.lit(1), F.lit(1)), F.array(F.lit(0), F.lit(0))
    scores = F.array(F.lit(1.0), F.lit(1000.0), F.lit(1000.0))
    row = one(
        spark,
        vectors.masked_mean(v, on, 2),
        vectors.masked_mean(v, off, 2),
        vectors.first_token(v),
        vectors.softmax(scores),
        vectors.argmax(scores),
    )
    assert tuple(row) == ([2.0, 4.0], [0.0, 0.0], [1.0, 2.0], [0.0, 0.5, 0.5], 1)


def test_schema_operators(spark):
    df = spark.sql(
        "SELECT 1L AS challenge_id, 1 AS label, 2 AS n, true AS b, array(1) AS l, 'x' AS s, 3 AS retweet_count, "
        "double('nan') AS gone, CAST(NULL AS string) AS empty, 1.5D AS y"
    )
    kinds = schema.column_kinds(df)
    assert (kinds.numbers, kinds.booleans, kinds.lists) == (["n", "gone", "y"], ["b"], ["l"])
    assert "gone" not in schema.drop_all_null(df).columns and "empty" not in schema.drop_all_null(df).columns
    other = spark.sql("SELECT 1 AS n, 'z' AS s, 'q' AS y")
    assert schema.align(df, other).columns == ["n", "s", "y"]
    assert schema.common_numbers(df, other) == ["n"]
    cleaned = schema.clean_metadata(df, kinds)
    assert "retweet_count" not in cleaned.columns
    assert (cleaned.first().gone, cleaned.first().b, cleaned.first().l) == (0.0, 1, 1)
    with pytest.raises(ValueError, match="missing"):
        schema.drop_columns(df, ["nope"], strict=True)
    assert schema.drop_columns(df, ["nope", "n"]).columns == [c for c in df.columns if c != "n"]
    assert schema.select_at(df, [2, 0]).columns == ["n", "challenge_id"]
    assert schema.profile(df).count() == len(df.columns)
