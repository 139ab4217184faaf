"""Second-order boosted trees on histograms (M3).

Each feature is cut into at most ``bins`` intervals at its quantiles. A round draws rows and columns once,
and grows one tree level by level: tasks sum the gradients and Hessians of the logistic loss for each
(node, feature, interval), and the sums of a node and some features meet in one place, where the best cut is
found. Only that cut travels to the driver. A leaf weighs ``-G / (H + penalty)``, times the step.

Scale: rows are read as blocks of one-byte interval numbers next to the margin so far. The trees of the last
``KEPT`` rounds are applied on the fly; then the margins are written again, so neither the work of a round
nor the lineage grows with the rounds. Between two writings the blocks are held by at most as many tasks as
there are cores, so what a level shuffles does not grow with the rows. Where the rows are a single partition there is nothing to meet, and
those rounds are one job. Sums are whole numbers (gradients in units of 2^-24), so the trees do
not depend on the number of partitions or the order of their results. Rows are drawn by a hash of key and
round, columns by round: the first r rounds are the same whatever the number of rounds.

Defined results: NaN counts as larger than every number; a node without a cut of positive gain, or whose
cuts leave a child below ``min_child`` in Hessians, stays a leaf; of equal gains the first feature and then
the smallest value wins.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.session import materialise

BINS = 256
SKETCH = 4096
BLOCK = 4096
KEPT = 25
UNIT = 1 << 24
#: features whose sums travel as one row
TOGETHER = 16
LEAST_GAIN = 1e-6


class Trees(NamedTuple):
    """Trees as rows of arrays; node i has the children 2i + 1 and 2i + 2, and feature -1 is a leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margins(self, x: np.ndarray, rounds: Sequence[int] = (), start: np.ndarray | None = None) -> np.ndarray:
        """Margin of each row after each number of rounds, by default after all; one tree is added after another."""
        wanted = list(rounds) or [len(self.feature)]
        out = np.empty((len(x), len(wanted)))
        total, row = np.full(len(x), self.base) if start is None else start, np.arange(len(x))
        for t in range(max(wanted, default=0) + 1):
            for i, r in enumerate(wanted):
                if r == t:
                    out[:, i] = total
            if t < min(len(self.feature), max(wanted)):
                total = total + self.value[t][landed(x, row, self.feature[t], self.cut[t])]
        return out

    def dumps(self) -> str:
        held = io.BytesIO()
        np.savez_compressed(held, base=self.base, feature=self.feature, cut=self.cut, value=self.value)
        return base64.b64encode(held.getvalue()).decode()

    @staticmethod
    def loads(text: str) -> Trees:
        held = np.load(io.BytesIO(base64.b64decode(text)))
        return Trees(float(held["base"]), held["feature"], held["cut"], held["value"])


def landed(x: np.ndarray, row: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The leaf, or the node not split yet, of every row; rows with ``x <= cut`` go left."""
    node = np.zeros(len(x), np.int64)
    depth = (len(feature) + 1).bit_length() - 2
    for _ in range(depth):
        f = feature[node]
        right = ~(x[row, f] <= cut[node])
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def drawn_rows(keys: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Is a row part of a round? ``keys`` are 64-bit hashes."""
    salt = mixed(np.array([seed, turn], np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    turned = keys ^ (salt[:1] ^ (salt[1:] << np.uint64(1)))
    return mixed(turned) < np.uint64(min(int(share * 2**64), 2**64 - 1))


def drawn_columns(size: int, seed: int, turn: int, share: float) -> np.ndarray:
    return np.sort(np.random.default_rng([seed, turn]).permutation(size)[: max(1, int(share * size))])


# --- intervals ---------------------------------------------------------------------------------------------


def compressed(values: np.ndarray, weights: np.ndarray, most: int = SKETCH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their weights; beyond ``most``, values at equal steps of weight."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, int)
    values, weights = values[at], np.add.reduceat(weights, at) if len(at) else weights
    if len(values) <= most:
        return values, weights
    ends = np.cumsum(weights)
    step = np.searchsorted(ends, ends[-1] * (np.arange(1, most + 1) / most) * (1 - 1e-12))
    step = np.unique(np.minimum(step, len(values) - 1))
    return values[step], np.diff(ends[step], prepend=0)


def cuts_of(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` values to cut at: all but the largest, or those at equal steps of weight.

    Missing values stand as infinity; the last number before them is always a cut.
    """
    if len(values) <= bins:
        return values[:-1]
    ends = np.cumsum(weights)
    missing = [len(values) - 2] if np.isinf(values[-1]) else []
    steps = bins - len(missing)
    at = np.searchsorted(ends, ends[-1] * np.arange(1, steps) / steps)
    return values[np.unique([*at[at < len(values) - 1], *missing]).astype(int)]


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def feature_cuts(rows: DataFrame, size: int, bins: int) -> list[np.ndarray]:
    """The cuts of every feature of a table with one array column."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [(np.zeros(0), np.zeros(0)) for _ in range(size)]
        for batch in batches:
            x = _vectors(batch.column(0), size)
            for f in range(size):
                own = np.where(np.isnan(x[:, f]), np.inf, x[:, f])
                held[f] = compressed(np.concatenate((held[f][0], own)), np.concatenate((held[f][1], np.ones(len(own)))))
        for f in range(size):
            yield _sketch_row(f, TaskContext.get().partitionId(), *held[f])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, stack = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if feature is not None:
                cuts = cuts_of(*_folded(stack, 0), bins)
                yield _sketch_row(feature, 0, cuts, np.zeros(0))

        for batch in batches:
            for f, v, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if f != feature:
                    yield from close()
                    feature, stack = f, []
                stack.append((0, np.frombuffer(v), np.frombuffer(w)))
                while len(stack) > 1 and stack[-1][0] == stack[-2][0]:  # as many merges as a binary tree has levels
                    level = stack[-1][0] + 1
                    stack[-2:] = [(level, *_folded(stack[-2:], SKETCH))]
        yield from close()

    schema = "feature int, part int, v binary, w binary"
    parts = rows.mapInArrow(sketched, schema).repartition("feature").sortWithinPartitions("feature", "part")
    found = {r.feature: np.frombuffer(bytes(r.v)) for r in parts.mapInArrow(merged, schema).select("feature", "v").collect()}
    return [found.get(f, np.zeros(0)) for f in range(size)]


def _folded(sketches: list, most: int) -> tuple[np.ndarray, np.ndarray]:
    values, weights = (np.concatenate([s[i] for s in sketches]) for i in (1, 2))
    return compressed(values, weights, most or max(len(values), 1))


def _sketch_row(feature: int, part: int, v: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([feature], pa.int32()), pa.array([part], pa.int32()), pa.array([v.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["feature", "part", "v", "w"])


# --- rows in blocks ----------------------------------------------------------------------------------------

BLOCKS = "n int, keys binary, labels binary, codes binary, margins binary"


def _block(keys: np.ndarray, labels: np.ndarray, codes: np.ndarray, margins: np.ndarray) -> pa.RecordBatch:
    held = [pa.array([a.tobytes()], pa.binary()) for a in (keys, labels, codes, margins)]
    return pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int32()), *held], names=["n", "keys", "labels", "codes", "margins"])


def _unpacked(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for n, *held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        keys, labels, codes, margins = held
        kind = np.uint8 if len(codes) == n * size else np.uint16
        yield np.frombuffer(keys, np.uint64), np.frombuffer(labels, np.uint8), np.frombuffer(codes, kind).reshape(n, size), np.frombuffer(margins)


def coded(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The interval of each entry; ``x <= cuts[i]`` exactly where the interval is at most i."""
    kind = np.uint8 if max((len(c) for c in cuts), default=0) < 256 else np.uint16
    out = np.empty(x.shape, kind)
    for f, own in enumerate(cuts):
        out[:, f] = np.searchsorted(own, x[:, f], side="left")
    return out


def blocks_of(rows: DataFrame, cuts: list[np.ndarray], base: float) -> DataFrame:
    """Blocks of a table with the columns key hash, label and array of features."""
    size = len(cuts)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                own = batch.slice(i, BLOCK)
                keys = own.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                labels = own.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
                yield _block(keys, labels, coded(_vectors(own.column(2), size), cuts), np.full(len(keys), base))

    return materialise(rows.mapInArrow(blocked, BLOCKS), "boosting")


def with_margins(blocks: DataFrame, size: int, trees: Trees) -> DataFrame:
    """The blocks with the margins that some more trees give, written."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, labels, codes, margins in _unpacked(batch, size):
                yield _block(keys, labels, codes, trees.margins(codes, start=margins)[:, 0])

    return materialise(blocks.mapInArrow(moved, BLOCKS), "boosting")


# --- one level ---------------------------------------------------------------------------------------------


class Rules(NamedTuple):
    rounds: int
    depth: int
    step: float
    rows: float
    columns: float
    penalty: float
    min_child: float
    seed: int


class Best(NamedTuple):
    """Sums of a node, and its best cut; ``gain`` is negative where there is none."""

    node: int
    gain: float
    feature: int
    code: int
    g_left: int
    h_left: int
    g: int
    h: int


def gradients(labels: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss, in units of 2^-24."""
    p = 1 / (1 + np.exp(-margins))
    return np.rint((p - labels) * UNIT), np.rint(np.maximum(p * (1 - p), 1e-16) * UNIT)


def best_cut(node: int, features: np.ndarray, sums: np.ndarray, rules: Rules) -> Best:
    """The best cut of a node by the sums (2, features, intervals) of some features."""
    total = sums[:, 0, :].sum(axis=1)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    g, h = left / UNIT
    g_all, h_all = total / UNIT
    lam = rules.penalty
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g * g / (h + lam) + (g_all - g) ** 2 / (h_all - h + lam) - g_all * g_all / (h_all + lam)
    gain = np.where((h >= rules.min_child) & (h_all - h >= rules.min_child), gain, -1.0)
    if not gain.size or not gain.max() > LEAST_GAIN:
        return Best(node, -1.0, -1, -1, 0, 0, int(total[0]), int(total[1]))
    f, code = divmod(int(np.argmax(gain)), gain.shape[1])
    return Best(node, float(gain[f, code]), int(features[f]), code, int(left[0, f, code]), int(left[1, f, code]), int(total[0]), int(total[1]))


class Level(NamedTuple):
    """The open nodes of the tree that a round is growing, after the trees that the margins do not hold yet."""

    turn: int
    recent: Trees
    tree: Trees
    open_nodes: list[int]


class Shape(NamedTuple):
    """Features of the table, and the most intervals of one."""

    size: int
    width: int

    def sums(self, parts: Iterator[tuple], level: Level, rules: Rules) -> np.ndarray:
        """Sums (2, open nodes, drawn features, intervals) over blocks of rows."""
        features = drawn_columns(self.size, rules.seed, level.turn, rules.columns)
        place = np.full(level.tree.feature.shape[1], -1)
        place[level.open_nodes] = np.arange(len(level.open_nodes))
        sums = np.zeros((2, len(level.open_nodes), len(features), self.width), np.int64)
        offset = np.arange(len(features)) * self.width
        row_cells, cells = len(features) * self.width, sums[0].size
        for keys, labels, codes, margins in parts:
            drawn = np.flatnonzero(drawn_rows(keys, rules.seed, level.turn, rules.rows))
            codes = codes[drawn]
            margins = level.recent.margins(codes, start=margins[drawn])[:, 0]
            own = place[landed(codes, np.arange(len(codes)), level.tree.feature[0], level.tree.cut[0])]
            inside = np.flatnonzero(own >= 0)
            cell = (own[inside, None] * row_cells + offset + codes[inside][:, features]).ravel()
            for i, v in enumerate(gradients(labels[drawn], margins)):
                # whole numbers of at most 25 bits: a block's sums are exact in doubles
                sums[i] += np.bincount(cell, np.repeat(v[inside], len(features)), cells).astype(np.int64).reshape(sums.shape[1:])
        return sums


def planes(sums: np.ndarray) -> bytes:
    """Whole numbers as their lowest bytes, then the next ones, and so on: the upper ones, nearly all equal, compress."""
    return np.ascontiguousarray(sums, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(held: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def held_blocks(blocks: DataFrame, size: int) -> RDD:
    """The blocks as arrays, kept by at most as many tasks as there are cores: each task sends the sums of its rows."""
    tasks = min(blocks.rdd.getNumPartitions(), blocks.sparkSession.sparkContext.defaultParallelism)
    columns = ("n", "keys", "labels", "codes", "margins")

    def unpacked(rows: Iterator) -> Iterator[tuple]:
        for row in rows:
            yield from _unpacked(pa.RecordBatch.from_pydict({c: [row[c]] for c in columns}), size)

    return blocks.coalesce(tasks).rdd.mapPartitions(unpacked).persist(StorageLevel.MEMORY_AND_DISK)


def level_cuts(blocks: RDD, shape: Shape, level: Level, rules: Rules) -> list[Best]:
    """The best cut of every open node, from all tasks, in one job of two stages."""
    features = drawn_columns(shape.size, rules.seed, level.turn, rules.columns)
    groups = -(-len(features) // TOGETHER)

    def summed(parts: Iterator[tuple]) -> Iterator[tuple[int, bytes]]:
        sums = shape.sums(parts, level, rules)
        for n in range(len(level.open_nodes)):
            for k in range(groups):
                yield n * groups + k, planes(sums[:, n, k * TOGETHER : (k + 1) * TOGETHER])

    def chosen(slot: int, parts: Iterable[bytes]) -> tuple:
        node, k = divmod(slot, groups)
        own = features[k * TOGETHER : (k + 1) * TOGETHER]
        total = sum(from_planes(b) for b in parts).reshape(2, len(own), shape.width)
        return tuple(best_cut(level.open_nodes[node], own, total, rules))

    slots = len(level.open_nodes) * groups
    rows = blocks.mapPartitions(summed).groupByKey(min(slots, blocks.getNumPartitions())).map(lambda s: chosen(*s)).collect()
    found: dict[int, Best] = {}
    for row in sorted((Best(*r) for r in rows), key=lambda b: (b.node, -b.gain, b.feature, b.code)):
        found.setdefault(row.node, row)
    return [found[n] for n in level.open_nodes if n in found]


Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def grow(cuts_of_level: Callable[[Level], list[Best]], turn: int, rules: Rules, recent: Trees) -> Tree:
    """One tree: feature, interval and weight of every node."""
    nodes = 2 ** (rules.depth + 1) - 1
    feature, code, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    weight = lambda g, h: -rules.step * (g / UNIT) / (h / UNIT + rules.penalty)
    open_nodes = [0]
    while open_nodes:
        following = []
        for best in cuts_of_level(Level(turn, recent, Trees(0.0, feature[None], code[None], value[None]), open_nodes)):
            value[best.node] = weight(best.g, best.h)
            if best.gain < 0:
                continue
            feature[best.node], code[best.node], value[best.node] = best.feature, best.code, 0.0
            left = 2 * best.node + 1
            value[left], value[left + 1] = weight(best.g_left, best.h_left), weight(best.g - best.g_left, best.h - best.h_left)
            if 2 * left + 1 < nodes:
                following += [left, left + 1]
        open_nodes = following
    return feature, code, value


def stacked(trees: Sequence[Tree], rules: Rules) -> Trees:
    return Trees(0.0, *(np.array([t[i] for t in trees]).reshape(-1, 2 ** (rules.depth + 1) - 1) for i in range(3)))


TREES = "turn int, feature binary, code binary, value binary"


def grow_in_one_task(blocks: DataFrame, shape: Shape, turns: range, rules: Rules) -> list[Tree]:
    """The trees of some rounds over rows that are one partition: its sums have nothing to meet.

    The same sums and choices as over many partitions, so the same trees.
    """

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [block for batch in batches for block in _unpacked(batch, shape.size)]
        none = stacked([], rules)

        def cuts_of_level(level: Level) -> list[Best]:
            features = drawn_columns(shape.size, rules.seed, level.turn, rules.columns)
            sums = shape.sums(iter(held), level, rules)
            return [best_cut(node, features, sums[:, n], rules) for n, node in enumerate(level.open_nodes)] if held else []

        for turn in turns:
            tree = grow(cuts_of_level, turn, rules, none)
            moved = stacked([tree], rules)
            held = [(keys, labels, codes, moved.margins(codes, start=margins)[:, 0]) for keys, labels, codes, margins in held]
            row = [pa.array([turn], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in tree)]
            yield pa.RecordBatch.from_arrays(row, names=["turn", "feature", "code", "value"])

    rows = sorted(blocks.coalesce(1).mapInArrow(grown, TREES).collect(), key=lambda r: r.turn)
    return [(np.frombuffer(bytes(r.feature), np.int64), np.frombuffer(bytes(r.code)), np.frombuffer(bytes(r.value))) for r in rows]


def fit_trees(rows: DataFrame, size: int, rules: Rules, bins: int = BINS) -> Trees:
    """Trees for a table with the columns key hash, label (0 or 1) and array of features."""
    ones, n = rows.agg(F.sum(F.col(rows.columns[1]).cast("long")), F.count(F.lit(1))).first()
    share = min(max((ones or 0) / max(n, 1), 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    cuts = feature_cuts(rows.select(rows.columns[2]), size, bins)
    blocks = blocks_of(rows, cuts, base)
    shape = Shape(size, max((len(c) for c in cuts), default=0) + 1)
    alone = blocks.rdd.getNumPartitions() <= 1
    grown: list[Tree] = []
    while len(grown) < rules.rounds:
        first = len(grown)
        if first:
            blocks = with_margins(blocks, size, stacked(grown[-KEPT:], rules))
        turns = range(first, min(first + KEPT, rules.rounds))
        if alone:
            grown += grow_in_one_task(blocks, shape, turns, rules)
            continue
        held = held_blocks(blocks, size)
        for turn in turns:
            recent = stacked(grown[first:], rules)
            grown.append(grow(lambda level: level_cuts(held, shape, level, rules), turn, rules, recent))  # noqa: B023
        held.unpersist()
    trees = stacked(grown, rules)
    values = np.zeros(trees.feature.shape)
    for f, own in enumerate(cuts):
        at = trees.feature == f
        values[at] = own[trees.cut[at].astype(int)]
    return Trees(base, trees.feature.astype(np.int32), values, trees.value)


# --- as a stage --------------------------------------------------------------------------------------------


def margin_column(trees: Trees, features: Column, rounds: Sequence[int] = ()) -> Column:
    """Margins after each number of rounds, as an array."""
    size, wanted = int(trees.feature.max(initial=0)) + 1, list(rounds)

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            width = len(column.flatten()) // len(column) if len(column) else size
            out = trees.margins(_vectors(column, width), wanted)
            yield pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))

    return F.arrow_udf(scores, "array<double>")(features)


class BoostedTrees(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``rawPrediction``, ``probability`` and ``prediction``."""

    trees = Param(Params._dummy(), "trees", "the trees as text", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "the vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees: str = "", featuresCol: str = "features"):  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)

    def model(self) -> Trees:
        return Trees.loads(self.getOrDefault(self.trees))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        margin = margin_column(self.model(), vector_to_array(F.col(self.getOrDefault(self.featuresCol))))[0]
        scored = dataset.withColumn("_margin", margin)
        m = F.col("_margin")
        p = 1 / (1 + F.exp(-m))
        return scored.withColumns(
            {
                "rawPrediction": array_to_vector(F.array(-m, m)),
                "probability": array_to_vector(F.array(1 - p, p)),
                "prediction": (m > 0).cast("double"),
            }
        ).drop("_margin")
