"""A small network on fixed vectors, trained in steps over parts of the rows (M5), and its best epoch.

Dropout, a linear layer, ReLU, dropout, a linear layer, softmax; cross-entropy; Adam with decoupled weight
decay, and a step that warms up and then falls to zero. Every epoch deals the rows into ``batches`` by a
hash; a step sums the gradients of one batch over all partitions, and the driver, which holds the weights
alone, moves them. Dropped units are a hash of row, step and unit, so the fit does not depend on how rows
are placed.

After each epoch the weights are one more row of a table in the shared folder, with the accuracy on the
validation rows. The best epoch is the first with the highest accuracy; its weights are read back.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.plans.boosting import mixed
from lexiloom.plans.linear import added_up
from lexiloom.session import materialise, scratch_path

BLOCK = 4096
BETAS, EPSILON = (0.9, 0.999), 1e-8


class Weights(NamedTuple):
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self])

    def like(self, flat: np.ndarray) -> Weights:
        ends = np.cumsum([a.size for a in self])[:-1]
        return Weights(*(p.reshape(a.shape) for p, a in zip(np.split(flat, ends), self, strict=True)))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def dumps(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, *self)
        return held.getvalue()

    @staticmethod
    def loads(data: bytes) -> Weights:
        held = np.load(io.BytesIO(data))
        return Weights(*(held[f"arr_{i}"] for i in range(4)))


def first_weights(size: int, hidden: int, classes: int, seed: int) -> Weights:
    """Uniform in +-1/sqrt(inputs), as linear layers usually start."""
    rng = np.random.default_rng(seed)
    layer = lambda a, b: (rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a))
    return Weights(*layer(max(size, 1), hidden), *layer(hidden, classes))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def kept_units(keys: np.ndarray, step: int, layer: int, units: int, drop: float, seed: int) -> np.ndarray:
    """Factors of the units of each row: 0 where dropped, else ``1 / (1 - drop)``."""
    if drop <= 0:
        return np.ones((len(keys), units))
    salt = mixed(np.array([[seed, 2 * step + layer]], np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    unit = mixed(np.arange(units, dtype=np.uint64) + salt[:, :1] + (salt[:, 1:] << np.uint64(1)))
    h = mixed(keys[:, None] ^ unit)
    return (h >= np.uint64(int(drop * 2**64))) / (1 - drop)


def gradient(w: Weights, keys: np.ndarray, x: np.ndarray, y: np.ndarray, step: int, drop: float, seed: int) -> np.ndarray:
    """Sums over the rows: the gradient of the cross-entropy, the cross-entropy, and the rows."""
    m1 = kept_units(keys, step, 0, x.shape[1], drop, seed)
    m2 = kept_units(keys, step, 1, w.w1.shape[1], drop, seed)
    x = x * m1
    a = x @ w.w1 + w.b1
    h = np.maximum(a, 0) * m2
    p = softmax(h @ w.w2 + w.b2)
    rows = np.arange(len(y))
    loss = -np.log(np.maximum(p[rows, y], 1e-300)).sum()
    p[rows, y] -= 1
    back = (p @ w.w2.T) * m2 * (a > 0)
    return np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), (h.T @ p).ravel(), p.sum(axis=0), [loss, len(y)]])


class Rules(NamedTuple):
    hidden: int
    epochs: int
    batches: int
    rate: float
    drop: float
    decay: float
    warmup: float
    seed: int


def dealt(keys: np.ndarray, epoch: int, rules: Rules) -> np.ndarray:
    """The batch of each row in an epoch."""
    salt = mixed(np.array([rules.seed + 1, epoch], np.int64).view(np.uint64) + np.uint64(0xD1B54A32D192ED03))
    return (mixed(keys ^ salt[0] ^ (salt[1] << np.uint64(1))) % np.uint64(rules.batches)).astype(int)


def rate_at(step: int, rules: Rules) -> float:
    steps = rules.epochs * rules.batches
    warm = int(rules.warmup * steps)
    return rules.rate * ((step + 1) / (warm + 1) if step < warm else (steps - step) / max(steps - warm, 1))


class Adam:
    """Moments of the gradient; weights shrink by ``decay`` apart from them."""

    def __init__(self, size: int):
        self.first, self.second, self.steps = np.zeros(size), np.zeros(size), 0

    def move(self, w: np.ndarray, g: np.ndarray, rate: float, decay: float) -> np.ndarray:
        self.steps += 1
        self.first = BETAS[0] * self.first + (1 - BETAS[0]) * g
        self.second = BETAS[1] * self.second + (1 - BETAS[1]) * g * g
        first, second = self.first / (1 - BETAS[0] ** self.steps), self.second / (1 - BETAS[1] ** self.steps)
        return w * (1 - rate * decay) - rate * first / (np.sqrt(second) + EPSILON)


BLOCKS = "n int, keys binary, y binary, x binary"


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks of a table with the columns key hash, class and array of features."""

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                own = batch.slice(i, BLOCK)
                keys, y = (own.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                x = own.column(2).flatten().to_numpy(zero_copy_only=False).astype(float)
                held = [pa.array([a.tobytes()], pa.binary()) for a in (keys, y, x)]
                yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *held], names=["n", "keys", "y", "x"])

    return materialise(rows.mapInArrow(blocked, BLOCKS), "head")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for n, keys, y, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield np.frombuffer(keys, np.uint64), np.frombuffer(y, np.int64), np.frombuffer(x).reshape(n, -1)


def summed(blocks: DataFrame, length: int, part: Callable[..., np.ndarray]) -> np.ndarray:
    return added_up(blocks, length, _unpacked, lambda block: part(*block))


def head_rows(df: DataFrame, key: str, label: str, features: str) -> DataFrame:
    return df.select(F.xxhash64(key).alias("key"), F.col(label).cast("long").alias("y"), vector_to_array(features).alias("x"))


def fit_head(train: DataFrame, size: int, classes: int, rules: Rules, validation: DataFrame | None = None) -> DataFrame:
    """``epoch, loss, accuracy, weights``: one row an epoch. Tables hold key hash, class and array of features.

    ``loss`` is the mean over the steps of the epoch, with dropout; ``accuracy`` is that of the validation
    rows without, and null where there are none.
    """
    spark = train.sparkSession
    blocks = blocks_of(train)
    others = blocks_of(validation) if validation is not None else None
    w = first_weights(size, rules.hidden, classes, rules.seed)
    adam, path = Adam(w.flat().size), scratch_path(spark, "head-states")
    for epoch in range(rules.epochs):
        loss, seen = 0.0, 0.0
        for b in range(rules.batches):
            step = epoch * rules.batches + b

            def part(keys: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
                at = dealt(keys, epoch, rules) == b  # noqa: B023
                return gradient(w, keys[at], x[at], y[at], step, rules.drop, rules.seed)  # noqa: B023

            out = summed(blocks, adam.first.size + 2, part)
            loss, seen = loss + out[-2], seen + out[-1]
            if out[-1]:
                w = w.like(adam.move(w.flat(), out[:-2] / out[-1], rate_at(step, rules), rules.decay))
        accuracy = None
        if others is not None:
            own = w
            right = summed(others, 2, lambda keys, y, x: np.array([(own.logits(x).argmax(axis=1) == y).sum(), len(y)], float))  # noqa: B023
            accuracy = float(right[0] / right[1]) if right[1] else None
        state = (epoch, float(loss / seen) if seen else None, accuracy, bytearray(w.dumps()))
        spark.createDataFrame([state], STATES).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(STATES).parquet(path)


STATES = "epoch int, loss double, accuracy double, weights binary"


def best_state(states: DataFrame) -> tuple[int, Weights]:
    """The first epoch with the highest accuracy, or the last one where none was measured."""
    order = F.struct(F.coalesce("accuracy", F.lit(-1.0)), F.when(F.col("accuracy").isNull(), F.col("epoch")).otherwise(-F.col("epoch")))
    row = states.agg(F.max_by("epoch", order).alias("epoch"), F.max_by("weights", order).alias("weights")).first()
    return row.epoch, Weights.loads(bytes(row.weights))


class HeadScore(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``rawPrediction``, ``probability`` and ``prediction``."""

    weights = Param(Params._dummy(), "weights", "the layers as text", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "the vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, weights: str = "", featuresCol: str = "features"):  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)

    @staticmethod
    def of(w: Weights, features: str) -> HeadScore:
        return HeadScore(weights=base64.b64encode(w.dumps()).decode(), featuresCol=features)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w = Weights.loads(base64.b64decode(self.getOrDefault(self.weights)))

        def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in batches:
                z = w.logits(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1))
                both = (pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), z.shape[1]).cast(pa.list_(pa.float64())) for a in (z, softmax(z)))
                top = pa.array(z.argmax(axis=1).astype(float))
                yield pa.StructArray.from_arrays([*both, top], names=["raw", "p", "top"])

        score = F.arrow_udf(scores, "raw array<double>, p array<double>, top double")
        scored = dataset.withColumn("_score", score(vector_to_array(F.col(self.getOrDefault(self.featuresCol)))))
        return scored.withColumns(
            {
                "rawPrediction": array_to_vector("_score.raw"),
                "probability": array_to_vector("_score.p"),
                "prediction": F.col("_score.top"),
            }
        ).drop("_score")
