"""Singular values and right vectors of a small square matrix, to high relative accuracy.

Householder reflections from both sides make the matrix upper bidiagonal; the differential quotient
difference algorithm with shifts (dqds) finds the squares of its singular values; a twisted
factorisation of the shifted tridiagonal product gives each vector. All on arrays of the matrix's
own size (vector dimensions), which no number of rows changes.
"""

import numpy as np

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny
CLUSTER = 1e-3


def bidiagonalise(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal d, upper diagonal e and orthogonal V with ``a = U B V'`` for some orthogonal U."""
    a = np.array(a, float)
    n = a.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        norm = np.linalg.norm(x)
        if norm == 0 or not len(x):
            return x, 0.0
        w = x / norm
        w[0] += 1.0 if w[0] >= 0 else -1.0
        return w, 2.0 / float(w @ w)

    for k in range(n):
        w, beta = reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(w, w @ a[k:, k:])
        if k < n - 2:
            w, beta = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= beta * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _transform(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One dqds transform; the last value is the least pivot, negative where the shift was too large."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(max(n - 1, 0))
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        new_q[i] = d + e[i]
        if new_q[i] <= 0:
            if d < 0 or shift > 0:
                return q, e, -1.0
            new_e[i], d = 0.0, q[i + 1] - shift  # a zero pivot splits the matrix
        else:
            ratio = q[i + 1] / new_q[i]
            new_e[i] = e[i] * ratio
            d = d * ratio - shift
        least = min(least, d)
        if least < 0:
            return q, e, least
    new_q[n - 1] = d
    return new_q, new_e, least


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues of ``B'B`` for the bidiagonal B with diagonal ``sqrt(q)`` and upper diagonal ``sqrt(e)``.

    A shift below the least eigenvalue keeps every pivot positive, so no digit is lost by
    cancellation. A shift found too large is cut down and at last left out; a transform
    without a shift never fails.
    """
    q, e = np.array(q, float), np.array(e, float)
    found, total, idle = [], 0.0, 0
    while len(q):
        n = len(q)
        if n == 1:
            found.append(total + q[0])
            break
        if e[-1] <= EPS * EPS * (total + q[-1]) or e[-1] <= TINY:
            found.append(total + q[-1])
            q, e = q[:-1], e[:-1]
            continue
        if n == 2:
            # the larger root first: the other is the product over it
            s = 0.5 * (q[0] + q[1] + e[0])
            gap = np.sqrt(max((0.5 * (q[0] - q[1] + e[0])) ** 2 + q[1] * e[0], 0.0))
            larger = s + gap
            found += [total + (q[0] * (q[1] / larger) if larger > 0 else 0.0), total + larger]
            break
        inner = np.flatnonzero(e <= EPS * EPS * (total + np.minimum(q[:-1], q[1:])))
        if len(inner):
            at = int(inner[-1]) + 1
            return np.array(found + list(total + dqds(q[:at], e[: at - 1])) + list(total + dqds(q[at:], e[at:])))
        if idle % 2 == 0 and q[0] * 2 < q[-1]:
            q, e = q[::-1].copy(), e[::-1].copy()  # small values belong at the end
        # Gershgorin below for the last rows, from the last pivots
        root = np.sqrt(q[-1])
        guess = max(root - 0.5 * np.sqrt(e[-1]), 0.0) ** 2 - 0.5 * np.sqrt(e[-1] * q[-1]) if idle < 200 else 0.0
        shift = max(min(guess, q[-1]), 0.0)
        for _ in range(4):
            new_q, new_e, least = _transform(q, e, shift)
            if least >= 0:
                break
            shift = max(shift + least, 0.0) * 0.9 if least > -shift else shift * 0.25
        else:
            shift = 0.0
            new_q, new_e, least = _transform(q, e, 0.0)
        q, e, total, idle = new_q, new_e, total + shift, idle + 1
        if idle > 100 * n + 1000:
            raise ArithmeticError("dqds did not settle")
    return np.array(found)


def twisted(d: np.ndarray, e: np.ndarray, value: float) -> list[np.ndarray]:
    """Unit vectors z with ``B'B z`` near ``value z``, best first: one for each of the four best twists."""
    n = len(d)
    safe = np.where(np.abs(d) > 0, d, EPS * max(np.abs(d).max(), np.abs(e).max(initial=0.0), TINY))
    pivots, low = safe * safe, (e / safe[:-1] if n > 1 else np.zeros(0))
    floor = EPS * EPS * max(float(pivots.max()), TINY)
    s, plus = np.empty(n), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        p = s[i] + pivots[i]
        p = p if abs(p) > floor else floor
        plus[i] = pivots[i] * low[i] / p
        s[i + 1] = plus[i] * low[i] * s[i] - value
    back, minus = np.empty(n), np.empty(max(n - 1, 0))
    back[n - 1] = pivots[n - 1] - value
    for i in range(n - 2, -1, -1):
        p = pivots[i] * low[i] * low[i] + back[i + 1]
        p = p if abs(p) > floor else floor
        ratio = pivots[i] / p
        minus[i] = low[i] * ratio
        back[i] = back[i + 1] * ratio - value
    gamma = np.abs(s + back + value)
    out = []
    for k in np.argsort(gamma, kind="stable")[:4]:
        z = np.zeros(n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -plus[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -minus[i] * z[i]
        big = np.abs(z).max()
        if np.isfinite(big):
            z /= big
            out.append(z / np.linalg.norm(z))
    return out


def _blocks(d: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """Where the bidiagonal falls apart: an entry above the diagonal that no digit of its row sees."""
    scale = max(np.abs(d).max(initial=0.0), np.abs(e).max(initial=0.0))
    cuts = np.flatnonzero(np.abs(e) <= EPS * np.maximum(np.abs(d[:-1]) + np.abs(d[1:]), EPS * scale)) + 1
    edges = [0, *cuts.tolist(), len(d)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def right_singular(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest singular values of ``a``, and their right vectors as columns.

    Vectors of values that are close to each other are made orthogonal among themselves; where
    the best twist points along a vector that is already there, the next one is taken.
    """
    d, e, v = bidiagonalise(a)
    n = len(d)
    pairs = []
    for low, high in _blocks(d, e):
        values = np.sort(dqds(d[low:high] ** 2, e[low : high - 1] ** 2))[::-1] if high > low else []
        pairs += [(float(x), low, high) for x in values]
    pairs = sorted(pairs, key=lambda p: -p[0])[:most]
    values, vectors = [], np.zeros((n, len(pairs)))
    for j, (value, low, high) in enumerate(pairs):
        near = [i for i in range(j) if abs(values[i] - value) <= CLUSTER * values[i]]
        tries = twisted(d[low:high], e[low : high - 1], value)
        tries += list(np.eye(high - low)[:, : len(near) + 1].T)
        kept = None
        for z in tries:
            own = np.zeros(n)
            own[low:high] = z
            for _ in range(2):
                own -= vectors[:, near] @ (vectors[:, near].T @ own)
            left = np.linalg.norm(own)
            if left > 1e-3:
                kept = own / left
                break
        vectors[:, j] = kept if kept is not None else 0.0
        values.append(value)
    return np.sqrt(np.maximum(values, 0.0)), v @ vectors
