"""The qd solver and the whitening against dense linear algebra in plain numpy."""

import math

import numpy as np
import pytest

from lexiloom.llm import qd, whitening


def graded(n, seed):
    rng = np.random.default_rng(seed)
    return np.triu(rng.normal(size=(n, n))) * 10.0 ** -np.linspace(0, 6, n)[:, None]


MATRICES = {
    "random": np.triu(np.random.default_rng(1).normal(size=(40, 40))),
    "graded": graded(30, 2),
    "identity": np.eye(7),
    "zero": np.zeros((5, 5)),
    "one": np.array([[3.0]]),
    "rank one": np.outer(np.arange(1.0, 7), np.ones(6)),
    "equal pairs": np.kron(np.eye(6), np.array([[2.0, 1.0], [0.0, 3.0]])),
    "close values": np.diag(1 + 1e-9 * np.arange(20)) + np.diag(np.full(19, 1e-10), 1),
    "wilkinson": np.linalg.cholesky(np.diag(np.abs(np.arange(-10.0, 11)) + 3) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)).T,
    "ones above": np.diag(np.full(25, 1e-3)) + np.diag(np.ones(24), 1),
}


@pytest.mark.parametrize("name", sorted(MATRICES))
def test_singular_values_and_vectors(name):
    a = MATRICES[name]
    n = len(a)
    values, v = qd.right_singular(a, n)
    true = np.linalg.svd(a, compute_uv=False)
    np.testing.assert_allclose(values, true, rtol=1e-11, atol=1e-14 * max(true[0], 1e-300))
    np.testing.assert_allclose(v.T @ v, np.eye(n), atol=1e-9)
    big = max(true[0] ** 2, 1e-300)
    assert np.abs(a.T @ (a @ v) - v * values**2).max() <= 1e-9 * big


def test_small_values_keep_their_digits():
    """A graded bidiagonal: dense methods lose the smallest values, dqds must not."""
    from fractions import Fraction

    d, e = [1.0, 1e-5, 1e-10], [1e-3, 1e-8]
    q, s = [Fraction(x) ** 2 for x in d], [Fraction(x) ** 2 for x in e]
    got = np.sort(qd.dqds(np.array([float(x) for x in q]), np.array([float(x) for x in s])))
    det = q[0] * q[1] * q[2]  # product of the eigenvalues
    assert abs(got.prod() / float(det) - 1) < 1e-13

    def characteristic(x):
        x = Fraction(x)
        diag = [q[0], s[0] + q[1], s[1] + q[2]]
        off = [q[0] * s[0], q[1] * s[1]]
        p0, p1 = Fraction(1), diag[0] - x
        for i in (1, 2):
            p0, p1 = p1, (diag[i] - x) * p1 - off[i - 1] * p0
        return p1

    for value in got:
        assert characteristic(value * (1 - 1e-13)) * characteristic(value * (1 + 1e-13)) < 0


def plain(rows, components):
    """Exact sums, and eigenvectors of the covariance of the distinct whole-number vectors."""
    usable = [(k, [math.floor(float(np.float32(c)) * 256) for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x in usable), default=0)
    usable = [(k, x + [0] * (width - len(x))) for k, x in usable]
    distinct = sorted({tuple(x) for _, x in usable})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for k, x in usable:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        out.setdefault(k, []).append((deviation, np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)]) @ vectors / np.sqrt(values)))
    return n, out, values / (centred**2).sum() * n


def test_against_plain(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 9)) * np.array([4, 3, 2, 1.5, 1, 1, 0.5, 0.5, 0.1])
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(200 + i, rows[3][1]) for i in range(50)] + [(300, [c + 1e-5 for c in rows[4][1]])]
    rows += [(400, None), (401, [None] * 9), (402, [float("nan")] * 9), (403, [1.0] * 8 + [float("inf")]), (404, [1.0, -0.0]), (None, rows[5][1])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, component string").repartition(7)
    got = whitening.whiten(df, components=4).collect()
    n, expected, explained = plain(rows, 4)
    assert {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert len(got) == 4 * sum(map(len, expected.values()))
    for c in range(4):
        mine = {r.vec_id: r for r in got if r.component == c + 1}
        sign = np.sign(mine[7].whitened * expected[7][0][1][c])
        for k, parts in expected.items():
            assert int(mine[k].deviation) == parts[0][0]
            assert abs(sign * mine[k].whitened - parts[0][1][c]) < 1e-8
            assert abs(mine[k].explained / explained[c] - 1) < 1e-10


def test_large_numbers_stay_exact(spark):
    rows = [(1, [2.0**40, 1.0]), (2, [-(2.0**40), 3.0]), (3, [0.5, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(df, components=1).collect()}
    _, expected, _ = plain(rows, 1)
    assert got == {k: v[0][0] for k, v in expected.items()}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, None)], [(1, []), (2, [])], [(1, [1.0]), (2, [1.0])]])
def test_nothing_to_whiten(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whiten(df)
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_rank_below_the_components(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert len(got) == 9 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
