"""The layout of a neighbour graph, and places of new rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import layout
from lexiloom.operators.neighbours import fuzzy_union, fuzzy_weights, knn_cosine


def clusters(n, seed, shift=0):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(4, 12)) * 4
    of = rng.integers(0, 4, n)
    return of, centres[of] + rng.normal(size=(n, 12))


@pytest.fixture(scope="module")
def laid(spark):
    of, x = clusters(240, 1)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    edges = fuzzy_union(fuzzy_weights(knn_cosine(df, "id", "v", 12), "id"), "id")
    coords = layout.layout(edges, epochs=25, iterations=12)
    return df, of, coords, {r.id: np.array(r.coords) for r in coords.collect()}


def trustworthiness(x, y, k):
    """Share of near places that are near rows, as usually defined."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = 1 - unit @ unit.T
    np.fill_diagonal(far, -1)
    rank = np.argsort(np.argsort(far, axis=1), axis=1)
    close = np.linalg.norm(y[:, None] - y[None], axis=2)
    np.fill_diagonal(close, np.inf)
    near = np.argsort(close, axis=1)[:, :k]
    n = len(x)
    lost = sum(max(rank[i, j] - k, 0) for i in range(n) for j in near[i])
    return 1 - 2 * lost / (n * k * (2 * n - 3 * k - 1))


def test_near_places_are_near_rows(laid):
    df, of, _, places = laid
    x = np.array([r.v for r in df.orderBy("id").collect()])
    y = np.array([places[i] for i in range(240)])
    assert np.isfinite(y).all()
    assert trustworthiness(x, y, 10) > 0.85
    centres = np.array([y[of == c].mean(axis=0) for c in range(4)])
    assert (np.linalg.norm(y[:, None] - centres, axis=2).argmin(axis=1) == of).mean() > 0.95


def test_new_rows_land_in_their_cluster(spark, laid):
    df, of, coords, places = laid
    new_of, new_x = clusters(40, 2)
    new = spark.createDataFrame([(1000 + i, [float(c) for c in v]) for i, v in enumerate(new_x)], "id long, v array<double>")
    near = layout.knn_between(new, df, "id", "v", 12, block_rows=50)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    x = np.array([r.v for r in df.orderBy("id").collect()])
    best = np.argsort(1 - unit(new_x) @ unit(x).T, axis=1, kind="stable")[:, :12]
    got = {(r.id, r["rank"]): r.neighbour for r in near.collect()}
    assert all(got[1000 + i, k + 1] == best[i, k] for i in range(40) for k in range(12))
    put = {r.id: np.array(r.coords) for r in layout.place_new(near, coords, "id").collect()}
    y = np.array([places[i] for i in range(240)])
    centres = np.array([y[of == c].mean(axis=0) for c in range(4)])
    found = [int(np.linalg.norm(put[1000 + i] - centres, axis=1).argmin()) for i in range(40)]
    assert np.mean(np.array(found) == new_of) > 0.9
    same = layout.place_new(layout.knn_between(df.where("id < 5").withColumn("id", F.col("id") + 5000), df, "id", "v", 12), coords, "id")
    assert all(np.abs(np.array(r.coords) - places[r.id - 5000]).max() < 1e-2 for r in same.collect())


def test_spectral_start_spans_the_leading_eigenvectors(spark):
    """Two blocks joined by a weak edge: the second eigenvector tells them apart."""
    rng = np.random.default_rng(5)
    edges = [(i, j, float(rng.random() + 0.5)) for b in (0, 10) for i in range(b, b + 10) for j in range(i + 1, b + 10)] + [(0, 10, 0.05)]
    both = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "src long, dst long, weight double")
    got = {r.id: r.coords[0] for r in layout.spectral(both, 1, 30, 42).collect()}
    signs = [np.sign(got[i]) for i in range(20)]
    assert len(set(signs[:10])) == 1 and len(set(signs[10:])) == 1 and signs[0] != signs[10]


def test_no_edges(spark):
    assert layout.layout(spark.createDataFrame([], "a long, b long, weight double")).collect() == []
