"""Whitening of embeddings: directions from blockwise QR and a bidiagonal qd solver.

Every entry c becomes the whole number ``floor(scale * c)``. The fit list is each distinct vector once; its
covariance (divisor n) has the whitening directions as eigenvectors.

How: sums are exact and combined per partition. The centred rows of a partition are reduced block by
block to one triangle (QR); the triangles of all partitions are reduced ``FAN`` at a time until one is
left, whose singular values and right vectors ``qd`` finds, so the covariance matrix is never formed and
no digits are lost by squaring. What reaches the driver is one row of sums, one triangle, and one small
matrix of the whitened covariance: sizes of the dimension, not of the table. Directions go to the tasks
with the function (components x dimension numbers).

Defined results: rows whose vector is null or holds null, NaN or infinite entries are left out; vectors
of different lengths count as filled up with zeros to the longest; an empty table, or one with a single
distinct vector, has no component and so no rows; components whose eigenvalue is zero to working
precision are not returned; equal eigenvalues may come with any basis of their space; repeated rows are
scored each for itself; null ids stay null; other columns, also ones named like results, are left out.
Entries times ``scale`` must stay below 2^52, which keeps them exact.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.qd import EPS, right_singular
from lexiloom.session import materialise

SCALE = 256
BLOCK_ROWS = 2048
FAN = 64
EXACT = 2**62


def whole_entries(vector: str | Column, scale: int) -> Column:
    """The entries as whole numbers, null where the vector is not usable."""
    c = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(c, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.when(finite, F.transform(c, lambda x: F.floor(x.cast("double") * float(scale))))


def matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    """One row for each list, filled up with zeros."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dimension).all():
        return values.reshape(-1, dimension)
    out = np.zeros((len(lengths), dimension), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


class Moments(NamedTuple):
    """Number of fitted vectors, sums of their entries, and the largest entry in size."""

    n: int
    sums: tuple[int, ...]
    largest: int

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: in 64 bits where that holds them, else in Python's numbers."""
        if self.n * max(self.largest, 1) * 2 < EXACT:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n``, each entry rounded once."""
        return self.scaled(x).astype(float) / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of the squares of ``n * x - sums``, exact."""
        apart = self.scaled(x)
        if self.dimension * (self.n * max(self.largest, 1) * 2) ** 2 >= EXACT:
            most = int(np.abs(apart).max(initial=0))
            if self.dimension * most * most >= EXACT:
                apart = apart.astype(object)
        return (apart * apart).sum(axis=1).tolist()


def fit_list(vectors: DataFrame) -> DataFrame:
    """Each distinct ``x`` once, written: three passes read it."""
    return materialise(vectors.select("x").distinct(), "whitening-fit")


def moments(fit: DataFrame) -> Moments:
    """Exact sums over the fit list."""
    dimension = fit.agg(F.max(F.size("x"))).first()[0] or 0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, largest, total = 0, 0, [0] * dimension
        for batch in batches:
            x = matrix(batch.column(0), dimension)
            n += len(x)
            if x.size:
                largest = max(largest, int(x.max()), -int(x.min()))
                total = [a + b for a, b in zip(total, _exact_sums(x), strict=True)]
        rows = pa.array(range(dimension), pa.int32()), pa.array(total, pa.decimal128(38, 0))
        facts = pa.array([n] * dimension, pa.int64()), pa.array([largest] * dimension, pa.int64())
        yield pa.RecordBatch.from_arrays([*rows, *facts], names=["i", "total", "n", "largest"])

    if dimension == 0:
        return Moments(fit.count(), (), 0)
    parts = fit.mapInArrow(sums, "i int, total decimal(38,0), n bigint, largest bigint")
    rows = parts.groupBy("i").agg(F.sum("total"), F.sum("n"), F.max("largest")).orderBy("i").collect()
    return Moments(int(rows[0][2]), tuple(int(r[1]) for r in rows), int(rows[0][3]))


def _exact_sums(x: np.ndarray) -> list[int]:
    """Sums of columns; entries are below 2^52, so 1,024 of them fit."""
    parts = [x[i : i + 1024].sum(axis=0) for i in range(0, len(x), 1024)]
    return [sum(int(v) for v in column) for column in zip(*parts, strict=True)]


def _triangle(rows: np.ndarray, so_far: np.ndarray | None) -> np.ndarray:
    return np.linalg.qr(rows if so_far is None else np.vstack((so_far, rows)), mode="r")


def triangle(fit: DataFrame, facts: Moments) -> np.ndarray:
    """R of the centred rows: a square matrix with ``R'R = sum (x - mean)(x - mean)'``."""
    d = facts.dimension
    schema = "part int, r binary"

    def emit(part: int, r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                r = _triangle(facts.centred(matrix(batch.column(0).slice(i, BLOCK_ROWS), d)), r)
        yield from emit(TaskContext.get().partitionId(), r)

    def reduce_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, part = None, 0
        for batch in batches:
            for p, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r, part = _triangle(np.frombuffer(own, float).reshape(-1, d), r), p
        yield from emit(part // FAN, r)

    parts = fit.rdd.getNumPartitions()
    found = fit.mapInArrow(reduce_rows, schema)
    while parts > 1:
        parts = -(-parts // FAN)
        # at most FAN triangles share ``part // FAN``; each is dimension x dimension
        found = found.repartition(parts, F.expr(f"part div {FAN}")).sortWithinPartitions("part")
        found = found.groupBy(F.expr(f"part div {FAN}")).applyInArrow(_by_group(reduce_triangles), schema)
    r = np.zeros((d, d))
    rows = found.collect()
    if rows:
        own = np.frombuffer(rows[0].r, float).reshape(-1, d)
        r[: len(own)] = own
    return r


def _by_group(reduce):
    def grouped(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(reduce(iter(table.sort_by("part").to_batches()))))

    return grouped


class Whitening(NamedTuple):
    """Directions (dimension x components), their eigenvalues and the trace of the covariance."""

    facts: Moments
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.facts.centred(x) @ self.directions / np.sqrt(self.eigenvalues)


def fit_whitening(fit: DataFrame, components: int) -> Whitening:
    facts = moments(fit)
    if facts.n == 0 or facts.dimension == 0:
        return Whitening(facts, np.zeros((facts.dimension, 0)), np.zeros(0), 0.0, 0.0)
    r = triangle(fit, facts)
    values, directions = right_singular(r, components)
    trace = float((r * r).sum()) / facts.n
    kept = values > values.max(initial=0.0) * EPS * 8 * facts.dimension
    found = Whitening(facts, np.ascontiguousarray(directions[:, kept]), values[kept] ** 2 / facts.n, trace, 0.0)
    return found._replace(identity_error=_identity_error(fit, found))


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry in size of the whitened fit list's covariance minus the identity, from the rows."""
    k, d = len(model.eigenvalues), model.facts.dimension

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                w = model.whitened(matrix(batch.column(0).slice(i, BLOCK_ROWS), d))
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], names=["i", "s"])

    if k == 0:
        return 0.0
    rows = fit.mapInArrow(products, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    covariance = np.array([row.s for row in rows]).reshape(k, k) / model.facts.n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(docs: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """One row for each usable row and component.

    ``key, component, n, deviation, whitened, explained, identity_error``. ``deviation`` is exact, a
    whole number of up to 38 digits; a longer one raises.
    """
    rows = docs.select(F.col(key).alias("__key"), whole_entries(vector, scale).alias("x")).where("x is not null")
    model = fit_whitening(fit_list(rows), components)
    k, d = len(model.eigenvalues), model.facts.dimension

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            x = matrix(vectors, d)
            whitened = model.whitened(x) if k else np.zeros((len(x), 0))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(whitened.ravel()), k) if k else pa.array([[]] * len(x), pa.list_(pa.float64()))
            deviation = pa.array(model.facts.deviation(x), pa.decimal128(38, 0))
            yield pa.StructArray.from_arrays([deviation, lists.cast(pa.list_(pa.float64()))], names=["deviation", "whitened"])

    score = F.arrow_udf(scores, "deviation decimal(38,0), whitened array<double>")
    shares = (model.eigenvalues / model.trace).tolist() if k else []
    explained = F.array(*map(F.lit, shares)) if k else F.lit(None).cast(T.ArrayType(T.DoubleType()))
    if k == 0:  # nothing to score
        rows = rows.where(F.lit(False))
    scored = rows.select("__key", score("x").alias("s")).select("__key", "s.deviation", F.posexplode("s.whitened").alias("i", "whitened"))
    return scored.select(
        F.col("__key").alias(key),
        (F.col("i") + 1).alias("component"),
        F.lit(model.facts.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("i")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
