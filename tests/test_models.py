import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lexiloom.operators.metrics import accuracy
from lexiloom.plans import classifiers, features, training
from lexiloom.plans.features import Inputs, prepare
from lexiloom.session import scratch_path
from lexiloom.sources.results import load_model, save_model

INPUTS = Inputs("id", vector="v", numbers=("n",), category="c")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 5))
    y = (x @ [1.5, -2, 0.5, 0, 0] + 0.8 + rng.logistic(size=400) * 0.5 > 0).astype(int)
    rows = [(i, [float(v) for v in r], float(r[0] * 3), "ab"[i % 2], int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, v array<double>, n double, c string, label int").repartition(4).cache()


@pytest.mark.parametrize("solver", ["newton", "l-bfgs"])
@pytest.mark.parametrize("balanced", [False, True])
def test_logistic_regression_reaches_the_stated_optimum(points, solver, balanced):
    df = points.withColumn("features", array_to_vector("v"))
    inputs = Inputs("id")
    stages = classifiers.logistic_regression(df, inputs, c=0.7, balanced=balanced, tol=1e-14, solver=solver)
    rows = df.orderBy("id").collect()
    x = np.array([[*r.v, 1.0] for r in rows])
    y = np.array([2 * r.label - 1 for r in rows])
    weight = np.ones(len(y))
    if balanced:
        weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    linear = next(s for s in stages if hasattr(s, "coefficients"))
    w = linear.coefficients.toArray()
    gradient = w - 0.7 * x.T @ (weight * y / (1 + np.exp(y * (x @ w))))
    assert np.abs(gradient).max() < 1e-4
    scored = features.apply(stages, df).orderBy("id").select(vector_to_array("probability")[1], "prediction").collect()
    np.testing.assert_allclose([r[0] for r in scored], 1 / (1 + np.exp(-(x @ w))), atol=1e-9)
    assert [r[1] for r in scored] == (x @ w > 0).astype(float).tolist()
    assert set(features.apply(stages, df).columns) >= {"id", "label", "prediction", "probability"}


@pytest.mark.parametrize("c", [0.05, 2.0])
def test_svm_reaches_the_optimum_of_the_squared_hinge(points, c):
    df = points.withColumn("features", array_to_vector("v"))
    stages = classifiers.linear_svm(df, Inputs("id"), c=c)
    rows = df.orderBy("id").collect()
    x = np.array([[*r.v, 1.0] for r in rows])
    y = np.array([2 * r.label - 1 for r in rows])
    w = next(s for s in stages if hasattr(s, "coefficients")).coefficients.toArray()
    gradient = w - 2 * c * x.T @ (y * np.maximum(1 - y * (x @ w), 0))
    assert np.abs(gradient).max() < 1e-6
    scored = features.apply(stages, df).orderBy("id").select(vector_to_array("rawPrediction")[1], "prediction").collect()
    np.testing.assert_allclose([r[0] for r in scored], x @ w, atol=1e-9)
    assert [r[1] for r in scored] == (x @ w > 0).astype(float).tolist()


def test_both_solvers_give_the_same_columns_and_rows(points):
    df = points.withColumn("features", array_to_vector("v"))
    found = []
    for solver in classifiers.SOLVERS:
        out = features.apply(classifiers.logistic_regression(df, Inputs("id"), tol=1e-12, solver=solver), df)
        rows = out.orderBy("id").select(vector_to_array("rawPrediction")[1].alias("m"), vector_to_array("probability")[1].alias("p")).collect()
        found.append((set(out.columns), np.array([[r.m, r.p] for r in rows])))
    assert found[0][0] == found[1][0]
    np.testing.assert_allclose(found[0][1], found[1][1], atol=1e-4)
    with pytest.raises(ValueError, match="solver"):
        classifiers.logistic_regression(df, Inputs("id"), solver="auto")


def test_a_category_of_many_levels(spark):
    df = spark.range(12_000).selectExpr("id", "concat('s', id % 5000) as c", "double(id) as n", "cast(id % 2 as int) as label")
    inputs = Inputs("id", numbers=("n",), category="c")
    stages, _ = features.metadata_stages(prepare(df, inputs), inputs)
    assert features.apply(stages, prepare(df, inputs)).first().meta_levels.size == 5000


@pytest.mark.parametrize(
    "name,parameters",
    [
        ("boosted_trees", {"rounds": 10, "depth": 3}),
        ("boosted_trees_pca", {"rounds": 10, "depth": 3, "components": 3}),
        ("perceptron", {"hidden": 8, "max_iter": 40}),
    ],
)
def test_models_beat_the_majority(points, name, parameters):
    scored = training.holdout_scores(points, training.build(name, **parameters), INPUTS)
    base = training.holdout_scores(points, training.build("majority"), INPUTS)
    assert scored.count() == base.count()
    assert scored.agg(accuracy()).first()[0] > base.agg(accuracy()).first()[0] + 0.1


@pytest.fixture(scope="module")
def tweets(spark):
    rng = np.random.default_rng(10)
    words = np.array(["soleil", "pluie", "vent", "neige", "orage", "brume", "ciel", "nuage"])
    rows = []
    for i in range(160):
        y = i % 2
        p = np.array([4, 1, 1, 1, 1, 1, 1, 1] if y else [1, 4, 1, 1, 1, 1, 1, 1]) / 11
        rows.append((i, " ".join(rng.choice(words, 9, p=p)), float(i % 7), None if i % 5 == 0 else "web", y))
    return spark.createDataFrame(rows, "id long, text string, n double, c string, label int").repartition(4).cache()


TEXT = Inputs("id", text="text", numbers=("n",), category="c")


@pytest.mark.parametrize("name", ["logistic_regression", "svm", "logistic_regression_metadata"])
def test_text_models_cross_validate(tweets, name):
    rows = training.cross_validate(tweets, training.build(name), TEXT, folds=3).collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2]
    assert np.mean([r.accuracy for r in rows]) > 0.7


def test_score_unlabelled_keeps_keys_and_saves(tweets, spark):
    known, others = tweets.filter("id < 120"), tweets.filter("id >= 120").drop("label")
    plan = training.build("logistic_regression_metadata")
    scored = training.score_unlabelled(known, others, plan, TEXT)
    assert {r.id for r in scored.collect()} == set(range(120, 160))
    model = plan.fit(prepare(known, TEXT), TEXT)
    path = scratch_path(spark, "model")
    save_model(model, path)
    want = {r.id: r.prediction for r in scored.collect()}
    got = {r.id: r.prediction for r in load_model(path).transform(prepare(others, TEXT)).collect()}
    assert got == want


def test_unknown_level_is_all_zeros_and_missing_is_a_level(tweets, spark):
    inputs = Inputs("id", category="c")
    train = prepare(tweets, inputs)
    stages = features.category_stages(train, inputs, "o")
    other = prepare(spark.createDataFrame([(1, "web"), (2, "new"), (3, None)], "id long, c string"), inputs)
    got = {r.id: r.o.toArray().tolist() for r in features.apply(stages, other).collect()}
    assert got[2] == [0, 0] and sorted([got[1], got[3]]) == [[0, 1], [1, 0]]


def test_prepare_repairs_what_models_see(spark):
    df = spark.sql("SELECT 1L AS id, double('nan') AS a, true AS b, array(1, 2) AS l, CAST(NULL AS string) AS t")
    row = prepare(df, Inputs("id", text="t", numbers=("a", "b", "l"))).first()
    assert (row.a, row.b, row.l, row.t) == (0.0, 1.0, 2.0, "nan")


def test_grid_keeps_all_parameters(points):
    inputs = Inputs("id", vector="v")
    results = training.grid_search(points, inputs, rounds=(3,), depths=(2, 3), components=(2, 4))
    assert {(r.depth, r.components) for r in results} == {(2, 2), (2, 4), (3, 2), (3, 4)}
    assert results[0].accuracy == max(r.accuracy for r in results)


def test_grid_cells_are_separate_fits(points):
    """Scores on the way of a long fit, on the leading components of a larger PCA, are those of fits of their own."""
    inputs = Inputs("id", vector="v")
    together = training.grid_search(points, inputs, rounds=(2, 5), depths=(2,), components=(2, 4))
    for cell in together:
        alone = training.grid_search(points, inputs, rounds=(cell.rounds,), depths=(cell.depth,), components=(cell.components,))
        assert alone == [cell]


def test_epochs_and_the_best_of_them(points):
    states, scored = training.epochs(points, INPUTS, hidden=4, max_iter=5, batches=2)
    rows = states.orderBy("epoch").collect()
    assert [r.epoch for r in rows] == list(range(5))
    assert scored.agg(accuracy()).first()[0] == max(r.accuracy for r in rows)


def test_registry():
    with pytest.raises(ValueError, match="unknown"):
        training.build("nope")
    with pytest.raises(ValueError, match="needs"):
        training.build("svm").check(Inputs("id"))


def test_labels_of_scored_rows_are_never_read(tweets):
    """Flipping every held-out label changes no prediction."""
    split = training.stratified_holdout(tweets, "id", "label", 0.25)
    flipped = split.withColumn("label", F.when(F.col("split") == "val", 1 - F.col("label")).otherwise(F.col("label")))
    plan = training.build("logistic_regression")

    def predictions(df):
        rows = prepare(df, TEXT)
        model = plan.fit(rows.filter("split = 'train'"), TEXT)
        return {r.id: r.prediction for r in model.transform(rows.filter("split = 'val'")).collect()}

    assert predictions(split) == predictions(flipped)
