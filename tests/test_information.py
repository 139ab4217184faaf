"""Mutual information by neighbours against a plain version over all pairs."""

import numpy as np
import pytest

from lexiloom.operators.information import NEAR, neighbour_information


def digamma(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, int(n)))


def plain(x, y, k):
    keep = ~np.isnan(x) & np.array([v is not None for v in y])
    x, y = x[keep], np.array(y, object)[keep]
    keep = np.array([(y == v).sum() > 1 for v in y], bool)
    x, y = x[keep], y[keep]
    terms = []
    for i in range(len(x)):
        own = np.abs(x[(y == y[i])] - x[i])
        own = np.sort(own)[1:]
        kth = min(k, len(own))
        d = own[kth - 1]
        far = np.abs(x - x[i])
        m = (far < d - NEAR * (abs(x[i]) + d)).sum() if d > 0 else (far == 0).sum()
        terms.append(digamma(kth) - digamma((y == y[i]).sum()) - digamma(m))
    return max(0.0, digamma(len(x)) + np.mean(terms)) if len(x) else None


@pytest.mark.parametrize(("k", "block"), [(3, 100_000), (3, 4), (1, 3), (5, 7)])
def test_against_plain(spark, k, block):
    rng = np.random.default_rng(k)
    n = 260
    y = ["a" if v < 0.6 else "b" if v < 0.95 else "c" for v in rng.random(n)]
    y[7], y[8] = "single", None
    shift = np.array([{"a": 0, "b": 1.5, "c": 3}.get(v, 0) for v in y])
    x = np.column_stack([rng.normal(size=n) + shift, rng.integers(0, 6, n), rng.normal(size=n), np.round(rng.normal(size=n) + shift, 1) * 0.1, np.full(n, 3.0)])
    x[5, 0] = np.nan
    rows = [(*map(float, r), t) for r, t in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "p double, q double, r double, s double, t double, label string").repartition(5)
    got = {r.feature: r.mi for r in neighbour_information(df, ["p", "q", "r", "s", "t"], "label", k, block).collect()}
    for j, name in enumerate("pqrst"):
        assert got[name] == pytest.approx(plain(x[:, j], y, k), abs=1e-9), name
    assert got["p"] > 0.2


def test_nothing_to_score(spark):
    df = spark.createDataFrame([(1.0, None), (None, "a"), (2.0, "b")], "x double, label string")
    assert neighbour_information(df, ["x"], "label").collect() == []
