"""The network head against a plain numpy version, and its epochs."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lexiloom.plans import classifiers, head
from lexiloom.plans.features import Inputs
from lexiloom.session import scratch_path
from lexiloom.sources.results import load_model, save_model

RULES = head.Rules(hidden=6, epochs=4, batches=3, rate=0.02, drop=0.4, decay=0.1, warmup=0.2, seed=5)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 4))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.8).astype(int)
    df = spark.createDataFrame([(i, int(t), [float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, label int, v array<double>")
    df = df.withColumn("features", array_to_vector("v")).repartition(4).cache()
    keys = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    return df, np.array([keys[i] for i in range(150)], np.int64).view(np.uint64), x, y


def plain_states(keys, x, y, rules):
    """Per unit and row in loops over layers, with the gradient by differences of the loss as a check elsewhere."""
    w = head.first_weights(x.shape[1], rules.hidden, 2, rules.seed)
    params = [a.copy() for a in w]
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in params]
    steps, taken, out = rules.epochs * rules.batches, 0, []
    warm = int(rules.warmup * steps)
    for epoch in range(rules.epochs):
        batch = head.dealt(keys, epoch, rules)
        for b in range(rules.batches):
            step, at = epoch * rules.batches + b, batch == b
            m1 = head.kept_units(keys[at], step, 0, x.shape[1], rules.drop, rules.seed)
            m2 = head.kept_units(keys[at], step, 1, rules.hidden, rules.drop, rules.seed)
            xs = x[at] * m1
            a = xs @ params[0] + params[1]
            h = np.where(a > 0, a, 0) * m2
            z = h @ params[2] + params[3]
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            dz = (p - np.eye(2)[y[at]]) / at.sum()
            da = (dz @ params[2].T) * m2 * (a > 0)
            grads = [xs.T @ da, da.sum(0), h.T @ dz, dz.sum(0)]
            rate = rules.rate * ((step + 1) / (warm + 1) if step < warm else (steps - step) / (steps - warm))
            taken += 1
            for i, g in enumerate(grads):
                m, v = moments[i]
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                moments[i] = (m, v)
                params[i] = params[i] * (1 - rate * rules.decay) - rate * (m / (1 - 0.9**taken)) / (np.sqrt(v / (1 - 0.999**taken)) + 1e-8)
        out.append([q.copy() for q in params])
    return out


def test_states_against_plain(table):
    df, keys, x, y = table
    train = df.where("id < 110")
    states = head.fit_head(head.head_rows(train, "id", "label", "features"), 4, 2, RULES, head.head_rows(df.where("id >= 110"), "id", "label", "features"))
    rows = states.orderBy("epoch").collect()
    for row, params in zip(rows, plain_states(keys[:110], x[:110], y[:110], RULES), strict=True):
        for a, b in zip(head.Weights.loads(bytes(row.weights)), params, strict=True):
            np.testing.assert_allclose(a, b, atol=1e-10)
        z = np.maximum(x[110:] @ params[0] + params[1], 0) @ params[2] + params[3]
        assert abs(row.accuracy - (z.argmax(axis=1) == y[110:]).mean()) < 1e-12


def test_gradient_is_that_of_the_loss(table):
    _, keys, x, y = table
    w = head.first_weights(4, 5, 2, 1)
    rng = np.random.default_rng(0)
    v = rng.normal(size=w.flat().size)
    value = lambda t: head.gradient(w.like(w.flat() + t * v), keys, x, y, 3, 0.3, 9)[-2]
    g = head.gradient(w, keys, x, y, 3, 0.3, 9)[:-2]
    assert abs((value(1e-6) - value(-1e-6)) / 2e-6 - g @ v) < 1e-4 * abs(g @ v)


def test_dropped_shares():
    keys = head.mixed(np.arange(5000, dtype=np.uint64))
    one, two = head.kept_units(keys, 1, 0, 20, 0.5, 1), head.kept_units(keys, 2, 0, 20, 0.5, 1)
    assert set(np.unique(one)) == {0.0, 2.0} and np.abs((one > 0).mean(axis=0) - 0.5).max() < 0.03
    assert abs(((one > 0) & (two > 0)).mean() - 0.25) < 0.01


def test_the_best_epoch_is_restored(table):
    df, _, _, _ = table
    train, val = df.where("id < 110"), df.where("id >= 110")
    options = {"hidden": 6, "max_iter": 6, "batches": 2, "rate": 0.05, "drop": 0.2, "seed": 3}
    states = classifiers.head_states(train, Inputs("id"), validation=val, **options).orderBy("epoch").collect()
    best = max(states, key=lambda r: (r.accuracy, -r.epoch))
    model = PipelineModel(classifiers.perceptron(train, Inputs("id"), validation=val, **options))
    scored = model.transform(val).select("label", "prediction", vector_to_array("probability").alias("p"), vector_to_array("features").alias("x")).collect()
    z = head.Weights.loads(bytes(best.weights)).logits(np.array([r.x for r in scored]))
    np.testing.assert_allclose([r.p for r in scored], head.softmax(z), atol=1e-12)
    assert np.mean([r.label == r.prediction for r in scored]) == best.accuracy
    last = head.best_state(classifiers.head_states(train, Inputs("id"), **options))
    assert last[0] == 5
    path = scratch_path(df.sparkSession, "head")
    save_model(model, path)
    again = load_model(path).transform(val).select("prediction").collect()
    assert [r.prediction for r in again] == [r.prediction for r in scored]
