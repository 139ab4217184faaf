"""Plan shapes that must hold at any size."""

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "k1_stratified_folds",
        "k2_stratified_holdout",
        "k3_random_holdout",
        "k4_group_holdout",
        "s3_flatten",
        "f12_clean_table",
        "v1_standardize",
        "v1b_standardize_vec",
        "v2_onehot",
        "v8_mean_pool",
        "v9_first_pool",
        "m4_majority",
        "m6_softmax_argmax",
    ],
)
def test_rows_stay_where_they_are(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize(
    "name,exchanges",
    [("g1_group_ids", 1), ("g3_user_texts", 1), ("g4_first_label", 1), ("r1_anova_f", 2), ("v7_fuzzy_union", 4)],
)
def test_number_of_shuffles(spark, name, exchanges):
    assert plan(spark, name).count("Exchange hashpartitioning") == exchanges


@pytest.mark.parametrize("name", ["e5_metrics_row", "e6_fold_report", "g5_label_join", "k5_first_per_group", "r3_mutual_info", "v6_knn_cosine"])
def test_no_cross_join(spark, name):
    text = plan(spark, name)
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_only_used_columns_are_read(spark):
    assert "ReadSchema: struct<l_returnflag:string>" in plan(spark, "g7_class_weights")
    assert "ReadSchema: struct<o_custkey:bigint>" in plan(spark, "g9_group_ratio")
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,5000.0)" in plan(spark, "p14_isin")
