"""The trust-region solver against gradients in plain numpy, with many columns and sparse rows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lexiloom.plans import classifiers, linear
from lexiloom.plans.features import Inputs
from lexiloom.session import scratch_path
from lexiloom.sources.results import load_model, save_model


def sparse_table(spark, rows, columns, seed):
    rng = np.random.default_rng(seed)
    x = np.zeros((rows, columns))
    for i in range(rows):
        x[i, rng.choice(columns, 12, replace=False)] = rng.random(12) + 0.1
    x[3] = 0
    y = (x @ rng.normal(size=columns) + rng.normal(size=rows) * 0.3 > 0).astype(int)
    data = [(i, int(y[i]), Vectors.dense(x[i]) if i % 7 == 0 and columns < 100 else Vectors.sparse(columns, {int(j): float(x[i, j]) for j in np.flatnonzero(x[i])})) for i in range(rows)]
    return spark.createDataFrame(data, ["id", "label", "features"]).repartition(4), x, y


def gradient(w, x, y, c, loss, weight):
    sign = 2 * y - 1
    wide = np.hstack([x, np.ones((len(x), 1))])
    m = sign * (wide @ w)
    slope = -1 / (1 + np.exp(m)) if loss == "logistic" else -2 * np.maximum(1 - m, 0)
    return w + c * wide.T @ (weight * sign * slope)


@pytest.mark.parametrize("columns", [40, 5000, 50_000])
def test_svm_with_many_columns(spark, columns):
    df, x, y = sparse_table(spark, 300, columns, columns)
    stages = classifiers.linear_svm(df, Inputs("id"), c=1.0)
    w = stages[0].coefficients.toArray()
    assert np.abs(gradient(w, x, y, 1.0, "squared_hinge", np.ones(len(y)))).max() < 1e-6
    scored = PipelineModel(stages).transform(df).orderBy("id")
    rows = scored.select(vector_to_array("rawPrediction")[1], "prediction").collect()
    np.testing.assert_allclose([r[0] for r in rows], x @ w[:-1] + w[-1], atol=1e-9)
    assert set(scored.columns) == {"id", "label", "features", "rawPrediction", "prediction"}


@pytest.mark.parametrize("balanced", [False, True])
def test_newton_with_many_columns(spark, balanced):
    df, x, y = sparse_table(spark, 300, 5000, 1)
    stages = classifiers.logistic_regression(df, Inputs("id"), c=2.0, balanced=balanced, tol=1e-10, solver="newton")
    weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 1).sum())) if balanced else np.ones(len(y))
    w = stages[0].coefficients.toArray()
    assert np.abs(gradient(w, x, y, 2.0, "logistic", weight)).max() < 1e-6


def test_products_are_the_derivative_of_the_gradient(spark):
    df, x, y = sparse_table(spark, 80, 20, 2)
    rows = df.select("features", (2.0 * F.col("label") - 1).alias("sign"), F.lit(1.5).alias("weight"))
    problem = linear.Problem(linear.blocks_of(rows, 20), 20, 0.7, "logistic")
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=21), rng.normal(size=21)
    value, g = problem.at(w)
    np.testing.assert_allclose(g, gradient(w, x, y, 0.7, "logistic", 1.5), atol=1e-10)
    step = 1e-6
    np.testing.assert_allclose(problem.curved(w, v), (problem.at(w + step * v)[1] - problem.at(w - step * v)[1]) / (2 * step), atol=1e-6)
    assert abs((problem.at(w + step * v)[0] - problem.at(w - step * v)[0]) / (2 * step) - g @ v) < 1e-6


def test_stretches_and_one_class(spark, monkeypatch):
    monkeypatch.setattr(linear, "STRETCH", 7)
    df, x, y = sparse_table(spark, 60, 30, 3)
    w = classifiers.linear_svm(df, Inputs("id"))[0].coefficients.toArray()
    assert np.abs(gradient(w, x, y, 1.0, "squared_hinge", 1.0)).max() < 1e-6
    same = df.withColumn("label", F.lit(1))
    scored = PipelineModel(classifiers.linear_svm(same, Inputs("id"))).transform(same)
    assert scored.where("prediction = 1").count() == 60


def test_saved_model(spark):
    df, _, _ = sparse_table(spark, 60, 30, 4)
    model = PipelineModel(classifiers.logistic_regression(df, Inputs("id"), solver="newton"))
    path = scratch_path(spark, "linear")
    save_model(model, path)
    want, got = ({r.id: r.p for r in m.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()} for m in (model, load_model(path)))
    assert want == got


def test_scaled_gradients_need_few_products():
    """Columns of very different weight: the diagonal takes the difference out, and the answer is the same."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 60)) * np.logspace(-3, 2, 60)
    h, g, asked = np.eye(60) + x.T @ x, rng.normal(size=60), []

    def product(v):
        asked.append(v)
        return h @ v

    s, hs = linear._within(product, g, np.diag(h), np.inf, 1e-9 * np.linalg.norm(g))
    np.testing.assert_allclose(s, np.linalg.solve(h, -g), rtol=1e-6)
    np.testing.assert_allclose(hs, h @ s, atol=1e-6)
    assert len(asked) < 60
    scale = np.diag(h)
    edge, _ = linear._within(product, g, scale, 0.1 * linear._length(s, scale), 1e-9)
    assert linear._length(edge, scale) == pytest.approx(0.1 * linear._length(s, scale))


@pytest.mark.parametrize("direct", [0, 1 << 20])
def test_parts_add_up_on_either_side(spark, monkeypatch, direct):
    monkeypatch.setattr(linear, "DIRECT", direct)
    monkeypatch.setattr(linear, "STRETCH", 7)
    df, x, y = sparse_table(spark, 80, 20, 2)
    blocks = linear.blocks_of(df.select("features", (2.0 * F.col("label") - 1).alias("sign"), F.lit(1.0).alias("weight")), 20)
    assert blocks.rdd.getNumPartitions() > 1
    total = linear.summed(blocks, 21, lambda b: b.back(b.y, 20))
    np.testing.assert_allclose(total, np.append((2 * y - 1) @ x, (2 * y - 1).sum()), atol=1e-12)
