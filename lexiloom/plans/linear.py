"""Linear models with an L2 penalty by a trust-region Newton method (M1, M2).

Minimises ``|w|^2 / 2 + c * sum s loss(y w x)`` where every x has a constant 1 appended. Each step solves the
Newton system by conjugate gradients inside a radius, and a product of the Hessian with a vector is one pass
over the rows: ``v + c X'(D (X v))``. The Hessian itself is never formed, so columns cost one number each, on
the driver and in a task, and only rows times non-zero entries cost time. The gradients are scaled by the
Hessian's diagonal, which one more pass a step gives, so fewer products are needed.

Rows are written once as sparse blocks. A pass sums a block's part in numpy. Where the parts of all partitions
are at most ``DIRECT`` bytes the driver adds them up; else they meet by stretches of columns, and the driver gets
one vector.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import materialise

BLOCK = 4096
STRETCH = 1 << 14
DIRECT = 8 << 20
FORCING = 0.1
MAX_PRODUCTS = 500


class Loss(NamedTuple):
    """Value, slope and curvature in the margin ``m = y w x``."""

    value: Callable[[np.ndarray], np.ndarray]
    slope: Callable[[np.ndarray], np.ndarray]
    curve: Callable[[np.ndarray], np.ndarray]


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -700, 700)))


LOSSES = {
    "logistic": Loss(lambda m: np.logaddexp(0, -m), lambda m: -_sigmoid(-m), lambda m: _sigmoid(m) * _sigmoid(-m)),
    "squared_hinge": Loss(lambda m: np.maximum(1 - m, 0) ** 2, lambda m: -2 * np.maximum(1 - m, 0), lambda m: 2.0 * (m < 1)),
}

BLOCKS = "n int, y binary, s binary, counts binary, at binary, x binary"


class Block(NamedTuple):
    """Rows in sparse form: entry k of row ``row[k]`` is ``x[k]`` in column ``at[k]``."""

    y: np.ndarray
    s: np.ndarray
    row: np.ndarray
    at: np.ndarray
    x: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.x * w[self.at], len(self.y)) + w[-1]

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        out = np.bincount(self.at, self.x * r[self.row], size + 1)
        out[size] = r.sum()
        return out


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of a table with a vector, a sign (1 or -1) and a weight."""
    vector, sign, weight = rows.columns

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                own = batch.slice(i, BLOCK)
                y, s = (own.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1))
                dense = own.column(2).to_numpy(zero_copy_only=False) == 1
                x = own.column(4).flatten().to_numpy(zero_copy_only=False).astype(float)
                given = own.column(3).flatten().to_numpy(zero_copy_only=False)
                counts = np.diff(own.column(4).offsets.to_numpy()).astype(np.int64)
                place = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
                place[~np.repeat(dense, counts)] = given
                held = [pa.array([a.tobytes()], pa.binary()) for a in (y, s, counts, place.astype(np.int32), x)]
                yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *held], names=["n", "y", "s", "counts", "at", "x"])

    udt = F.unwrap_udt(vector)
    indices = F.coalesce(udt["indices"], F.array().cast("array<int>"))
    flat = rows.select(F.col(sign).alias("sign"), F.col(weight).alias("weight"), udt["type"].alias("type"), indices.alias("at"), udt["values"].alias("x"))
    return materialise(flat.mapInArrow(blocked, BLOCKS), "linear")


def _unpacked(batch: pa.RecordBatch) -> Iterator[Block]:
    for n, y, s, counts, at, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        row = np.repeat(np.arange(n), np.frombuffer(counts, np.int64))
        yield Block(np.frombuffer(y), np.frombuffer(s), row, np.frombuffer(at, np.int32), np.frombuffer(x))


def added_up(blocks: DataFrame, length: int, unpack: Callable[[pa.RecordBatch], Iterator], part: Callable[..., np.ndarray]) -> np.ndarray:
    """Sum over all blocks of vectors of ``length``; the parts of all tasks meet in stretches."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            for block in unpack(batch):
                total += part(block)
        out = [total[i : i + STRETCH].tobytes() for i in range(0, length, STRETCH)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out, pa.binary())], names=["i", "v"])

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column(1).to_pylist():
                total = np.frombuffer(v) + (0 if total is None else total)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["i", "v"])

    parts = blocks.mapInArrow(partial, "i int, v binary")
    tasks = blocks.rdd.getNumPartitions()
    if tasks > 1 and 8 * length * tasks > DIRECT:
        parts = parts.groupBy("i").applyInArrow(merged, "i int, v binary")
    rows = parts.collect()
    out = np.zeros(length)
    for row in rows:
        v = np.frombuffer(bytes(row.v))
        out[row.i * STRETCH : row.i * STRETCH + len(v)] += v
    return out


def summed(blocks: DataFrame, length: int, part: Callable[[Block], np.ndarray]) -> np.ndarray:
    return added_up(blocks, length, _unpacked, part)


class Problem(NamedTuple):
    blocks: DataFrame
    size: int
    c: float
    loss: str

    def at(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Objective and gradient."""
        loss, size = LOSSES[self.loss], self.size

        def part(b: Block) -> np.ndarray:
            m = b.y * b.times(w)
            return np.append(b.back(b.s * b.y * loss.slope(m), size), (b.s * loss.value(m)).sum())

        out = summed(self.blocks, size + 2, part)
        return float(w @ w / 2 + self.c * out[-1]), w + self.c * out[:-1]

    def curved(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The Hessian at w times v."""
        loss, size = LOSSES[self.loss], self.size
        return v + self.c * summed(self.blocks, size + 1, lambda b: b.back(b.s * loss.curve(b.y * b.times(w)) * b.times(v), size))

    def diagonal(self, w: np.ndarray) -> np.ndarray:
        """The diagonal of the Hessian at w."""
        loss, size = LOSSES[self.loss], self.size
        return 1 + self.c * summed(self.blocks, size + 1, lambda b: b._replace(x=b.x * b.x).back(b.s * loss.curve(b.y * b.times(w)), size))


def _within(
    product: Callable[[np.ndarray], np.ndarray], g: np.ndarray, scale: np.ndarray, radius: float, enough: float
) -> tuple[np.ndarray, np.ndarray]:
    """Conjugate gradients for ``H s = -g``, scaled by a diagonal, until the residual is ``enough`` or s meets the radius; s and ``H s``.

    Lengths are those under ``scale``: in them s only grows.
    """
    s, hs, r = np.zeros_like(g), np.zeros_like(g), -g
    d = r / scale
    rr = float(r @ d)
    for _ in range(MAX_PRODUCTS):
        if np.linalg.norm(r) <= enough:
            break
        hd = product(d)
        step = rr / float(d @ hd)
        if _length(s + step * d, scale) >= radius:
            a, b, gap = float(d @ (scale * d)), float(s @ (scale * d)), radius * radius - float(s @ (scale * s))
            step = gap / (b + np.sqrt(b * b + a * gap)) if b >= 0 else (np.sqrt(b * b + a * gap) - b) / a
            return s + step * d, hs + step * hd
        s, hs, r = s + step * d, hs + step * hd, r - step * hd
        before, rr = rr, float(r @ (r / scale))
        d = r / scale + (rr / before) * d
    return s, hs


def _length(s: np.ndarray, scale: np.ndarray) -> float:
    return float(np.sqrt(s @ (scale * s)))


def minimise(problem: Problem, steps: int, tol: float) -> np.ndarray:
    """Weights whose gradient is ``tol`` times the first one, or as small as doubles allow."""
    w = np.zeros(problem.size + 1)
    value, g = problem.at(w)
    start = np.abs(g).max(initial=0.0)
    first, radius, scale = np.linalg.norm(g), None, None
    for _ in range(steps):
        size = np.linalg.norm(g)
        if np.abs(g).max(initial=0.0) <= tol * start:
            break
        if scale is None:
            scale = problem.diagonal(w)
            radius = _length(g / scale, scale) if radius is None else radius
        s, hs = _within(lambda v: problem.curved(w, v), g, scale, radius, size * min(FORCING, np.sqrt(size / first)))  # noqa: B023
        expected = -float(g @ s) - float(s @ hs) / 2
        found, slope = problem.at(w + s)
        if expected <= 1e-13 * abs(value):  # the values no longer tell: the gradient decides
            if np.linalg.norm(slope) >= size:
                break
            w, value, g, scale = w + s, found, slope, None
            continue
        ratio, reach = (value - found) / expected, _length(s, scale)
        if ratio < 0.25:
            radius = min(radius, reach) * 0.25
        elif ratio > 0.75:
            radius = max(radius, 2.5 * reach)
        if ratio > 1e-4:
            w, value, g, scale = w + s, found, slope, None
    return w


class LinearScore(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``rawPrediction`` and ``prediction``, and for a logistic model ``probability``; all in the JVM."""

    weights = Param(Params._dummy(), "weights", "weights and intercept as text", TypeConverters.toString)
    logistic = Param(Params._dummy(), "logistic", "is the margin a logit?", TypeConverters.toBoolean)
    featuresCol = Param(Params._dummy(), "featuresCol", "the vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, weights: str = "", logistic: bool = True, featuresCol: str = "features"):  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)

    @staticmethod
    def dumps(w: np.ndarray) -> str:
        return base64.b64encode(np.asarray(w, float).tobytes()).decode()

    @property
    def coefficients(self) -> DenseVector:
        """The weights, and last the one of the constant 1."""
        return Vectors.dense(np.frombuffer(base64.b64decode(self.getOrDefault(self.weights))))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w = self.coefficients.toArray()
        product = ElementwiseProduct(scalingVec=Vectors.dense(w[:-1]), inputCol=self.getOrDefault(self.featuresCol), outputCol="_parts")
        margin = F.aggregate(F.unwrap_udt("_parts")["values"], F.lit(0.0), lambda a, x: a + x) + F.lit(float(w[-1]))
        scored = product.transform(dataset).withColumn("_margin", margin)
        m = F.col("_margin")
        added = {"rawPrediction": array_to_vector(F.array(-m, m)), "prediction": (m > 0).cast("double")}
        if self.getOrDefault(self.logistic):
            added["probability"] = array_to_vector(F.array(1 / (1 + F.exp(m)), 1 / (1 + F.exp(-m))))
        return scored.withColumns(added).drop("_parts", "_margin")


def fit_linear(rows: DataFrame, size: int, features: str, loss: str, c: float, steps: int, tol: float) -> LinearScore:
    """A scoring stage from a table with a vector, a sign (1 or -1) and a weight."""
    w = minimise(Problem(blocks_of(rows, size), size, c, loss), steps, tol)
    return LinearScore(weights=LinearScore.dumps(w), logistic=loss == "logistic", featuresCol=features)
