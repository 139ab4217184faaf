from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import splits


def table(spark, n, labels):
    return spark.range(n).select(F.col("id"), labels.alias("label"))


@pytest.mark.parametrize("n,k", [(0, 5), (3, 5), (10, 5), (13, 4)])
def test_fold_sizes(n, k):
    sizes = splits.fold_sizes(n, k)
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_folds_are_balanced_with_a_hot_class(spark):
    df = table(spark, 20_011, F.when(F.col("id") % 3 == 0, 1).when(F.col("id") < 4, 2).otherwise(0))
    counts = {}
    for r in splits.stratified_folds(df, "id", "label").groupBy("label", "fold").count().collect():
        counts.setdefault(r["label"], {})[r["fold"]] = r["count"]
    for label, folds in counts.items():
        n = sum(folds.values())
        assert [folds.get(f, 0) for f in range(5)] == splits.fold_sizes(n, 5), label


def test_tiny_class_and_null_label(spark):
    df = table(spark, 4, F.when(F.col("id") < 3, 1))
    folds = [r.fold for r in splits.stratified_folds(df, "id", "label").orderBy("id").collect()]
    assert sorted(folds[:3]) == [0, 1, 2] and folds[3] is None


def test_same_seed_same_rows_and_other_seed_other_rows(spark):
    df = table(spark, 1000, F.col("id") % 2)

    def sides(d, seed):
        return {r.id: r.split for r in splits.stratified_holdout(d, "id", "label", 0.2, seed).collect()}

    first = sides(df, 42)
    assert first == sides(df.orderBy(F.rand(1)).repartition(3), 42)
    assert first != sides(df, 43)
    assert Counter(first.values()) == {"val": 200, "train": 800}


def test_exact_and_threshold_holdout(spark):
    df = spark.range(5000)
    exact = Counter(r.split for r in splits.random_holdout(df, "id", 0.1, exact=True).collect())
    assert exact == {"val": 500, "train": 4500}
    loose = Counter(r.split for r in splits.random_holdout(df, "id", 0.1).collect())
    assert 400 < loose["val"] < 600


def test_group_holdout_never_splits_a_group(spark):
    group = F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 50)
    df = spark.range(3000).select("id", group.alias("g"))
    rows = splits.group_holdout(df, "g", 0.1).collect()
    sides = {}
    for r in rows:
        sides.setdefault(r.g, set()).add(r.split)
    assert None not in sides and all(len(s) == 1 for s in sides.values())
    assert sum(s == {"val"} for s in sides.values()) == -(-len(sides) // 10)
    kept = splits.first_per_train_group(df, "g", "id", 0.1).collect()
    per_group = Counter(r.g for r in kept)
    everything = Counter(r.g for r in rows)
    for g, side in sides.items():
        assert per_group[g] == (1 if side == {"train"} else everything[g])


def test_five_thousand_classes(spark):
    """Every class against its rows in order of their hashes; sizes from 1 to 9 rows, and one hot class."""
    import hashlib

    df = spark.range(30_000).selectExpr("id", "if(id < 8000, -1, 1 + (id * id) % 4999) as label")
    rows = {}
    for r in df.collect():
        rows.setdefault(r.label, []).append((hashlib.md5(f"42:{r.id}".encode()).hexdigest(), r.id))
    want = {}
    for members in rows.values():
        sizes = splits.fold_sizes(len(members), 5)
        sides = [f for f, m in enumerate(sizes) for _ in range(m)]
        want |= {i: side for (_, i), side in zip(sorted(members), sides, strict=True)}
    assert len(rows) > 2000
    got = splits.stratified_folds(df, "id", "label")
    assert got.columns == ["id", "label", "fold"] and {r.id: r.fold for r in got.collect()} == want
    held = {r.id for r in splits.stratified_holdout(df, "id", "label", 0.2).where("split = 'val'").collect()}
    assert held == {i for members in rows.values() for _, i in sorted(members)[: -(-len(members) // 5)]}


@pytest.mark.parametrize("kind", ["boolean", "double", "string"])
def test_classes_of_other_types(spark, kind):
    df = spark.range(100).selectExpr("id", f"cast(id % 2 as {kind}) as label")
    sizes = splits.stratified_folds(df, "id", "label", 4).groupBy("label", "fold").count().collect()
    assert sorted(r["count"] for r in sizes) == [12] * 4 + [13] * 4


def test_first_rows_with_keys_that_repeat_across_groups(spark):
    df = spark.range(200).selectExpr("id % 50 as g", "id div 50 as k", "id as v")
    out = splits.first_per_train_group(df, "g", "k", 0.1)
    train = out.where("split = 'train'").collect()
    assert len(train) == 45 and all(r.k == 0 for r in train)
    assert out.where("split = 'val'").count() == 20


def test_folds_of_many_classes(spark):
    df = spark.range(5000).selectExpr("id", "concat('c', id % 250) as label")
    sizes = splits.stratified_folds(df, "id", "label").groupBy("label", "fold").count().collect()
    assert len(sizes) == 1250 and all(r["count"] == 4 for r in sizes)
