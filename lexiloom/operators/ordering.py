"""Exact running totals and quantiles over groups and columns of any size.

A window over one group is one task, so a group that holds a third of the rows
stalls. Here the order column is cut into buckets first: rows are ranked inside
``(group, bucket)``, and the totals of the earlier buckets are added. Where the
cuts lie changes only the balance, never the result.
"""

from __future__ import annotations

import math
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = 256
MAX_FINE = 512
BUCKET_ROWS = 2_000_000

NULL_BUCKET, NAN_BUCKET = -1, 1 << 30  # where Spark's own order puts them: nulls first, NaN last
PREFIX_BYTES = 6  # of a string, as a number that a double holds exactly

_BUCKET = "_bucket"


@dataclass(frozen=True)
class OrderCuts:
    """Quantile cuts of a column, each range cut again into equal steps.

    The quantiles follow the data roughly and come from a small sketch; the
    steps make up to ``QUANTILES * MAX_FINE`` buckets out of them. A string counts
    as the number of its bytes after the first ``skip``, which all strings share.
    """

    cuts: list[float]
    low: float
    high: float
    fine: int
    skip: int | None = None

    def add(self, df: DataFrame, order: str, bucket: str) -> DataFrame:
        """Add a bucket number that never decreases with ``order``; nulls and NaN have buckets of their own."""
        value, coarse = f"{bucket}_x", f"{bucket}_q"
        wide = df.withColumn(value, _as_number(F.col(f"`{order}`"), self.skip))
        x = F.col(value)
        missing = F.when(x.isNull(), F.lit(NULL_BUCKET)).when(F.isnan(x), F.lit(NAN_BUCKET))
        if not self.cuts:
            return wide.withColumn(bucket, missing.otherwise(F.lit(0))).drop(value)
        infinity = float("inf")
        splits = [-infinity, *self.cuts, infinity]
        wide = Bucketizer(splits=splits, inputCol=value, outputCol=coarse, handleInvalid="keep").transform(wide)
        q = F.col(coarse).cast("int")
        number = q
        if self.fine > 1:
            starts = [self.low, *self.cuts]
            widths = [hi - lo for lo, hi in zip(starts, [*self.cuts, self.high])]
            share = (x - F.get(F.lit(starts), q)) / F.get(F.lit([w if w > 0 else 1.0 for w in widths]), q)
            step = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * self.fine).cast("int")
            number = q * self.fine + F.least(step, F.lit(self.fine - 1))
        return wide.withColumn(bucket, missing.otherwise(number)).drop(value, coarse)


def _as_number(c: Column, skip: int | None) -> Column:
    """A double that never decreases with the column."""
    if skip is None:
        return c.cast("double")
    head = F.hex(F.substring(F.encode(c, "UTF-8"), skip + 1, PREFIX_BYTES))
    return F.conv(F.rpad(head, 2 * PREFIX_BYTES, "0"), 16, 10).cast("double")


def _shared_bytes(df: DataFrame, orders: Sequence[str]) -> dict[str, int]:
    """For each string column, the number of first bytes that its least and its greatest value share."""
    strings = [c for c in orders if dict(df.dtypes)[c] == "string"]
    if not strings:
        return {}
    row = df.agg(*[f(f"`{c}`").alias(f"{n}{i}") for i, c in enumerate(strings) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    ends = {c: [(row[f"{n}{i}"] or "").encode() for n in ("lo", "hi")] for i, c in enumerate(strings)}
    return {c: len(os.path.commonprefix(pair)) for c, pair in ends.items()}


def order_cuts(
    df: DataFrame,
    orders: Sequence[str],
    size: Column | None = None,
    bucket_size: int = BUCKET_ROWS,
    quantiles: int = QUANTILES,
    max_fine: int = MAX_FINE,
) -> list[OrderCuts]:
    """Cuts for each of the columns from narrow passes.

    ``size`` is what a bucket is measured in, one per row unless given.
    """
    shares = [i / quantiles for i in range(1, quantiles)]
    shared = _shared_bytes(df, orders)
    xs = [_as_number(F.col(f"`{c}`"), shared.get(c)) for c in orders]
    xs = [F.when(~F.isnan(x), x) for x in xs]
    row = df.agg(
        F.sum(F.lit(1) if size is None else size).alias("size"),
        *[F.percentile_approx(x, shares, 2 * quantiles).alias(f"q{i}") for i, x in enumerate(xs)],
        *[F.min(x).alias(f"lo{i}") for i, x in enumerate(xs)],
        *[F.max(x).alias(f"hi{i}") for i, x in enumerate(xs)],
    ).first()
    fine = min(max_fine, math.ceil((row["size"] or 0) / (quantiles * bucket_size)))
    found = []
    for i in range(len(xs)):
        cuts = sorted({c for c in row[f"q{i}"] or [] if math.isfinite(c)})
        ends = (row[f"lo{i}"], row[f"hi{i}"])
        steps = max(1, fine) if all(e is not None and math.isfinite(e) for e in ends) else 1
        found.append(OrderCuts(cuts, *ends, steps, shared.get(orders[i])))
    return found


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    totals: Mapping[str, Column],
    cuts: OrderCuts,
) -> DataFrame:
    """Add one column per entry of ``totals``: its sum over the rows before this one.

    ``order`` is a number or a string and unique inside a group; rows come in Spark's
    own order, so nulls are first and NaN last. Rows stay as they are. Null groups are one group.
    """
    inner = Window.partitionBy(*groups, _BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    bucketed = cuts.add(df, order, _BUCKET)
    zero = F.lit(0)
    local = bucketed.select("*", *[F.coalesce(F.sum(v).over(inner), zero).alias(name) for name, v in totals.items()])
    sums = {f"_sum_{name}": v for name, v in totals.items()}
    per_bucket = bucketed.groupBy(*groups, _BUCKET).agg(*[F.sum(v).alias(s) for s, v in sums.items()])
    outer = Window.partitionBy(*groups).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.select(
        *groups, _BUCKET, *[F.coalesce(F.sum(s).over(outer), zero).alias(s) for s in sums]
    )
    before = before.withColumnsRenamed({c: f"_of_{c}" for c in (*groups, _BUCKET)})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*groups, _BUCKET)])
    joined = local.join(before, same, "inner")
    return joined.select(
        *df.columns, *[(F.col(name) + F.col(f"_sum_{name}")).alias(name) for name in totals]
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float]
) -> dict[str, list[float]]:
    """For each column the smallest value with at least that share of the rows at or below it.

    Approximate cuts give buckets; their counts tell which bucket holds each
    rank; only those few buckets are then shuffled, as counts per value.
    """
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    xs = numbers.columns
    bucketed = numbers
    for i, cuts in enumerate(order_cuts(numbers, xs, quantiles=128, max_fine=64)):
        bucketed = cuts.add(bucketed, xs[i], f"b{i}")
    entries = [
        F.struct(F.lit(i).alias("i"), F.col(f"b{i}").alias("b"), F.col(x).alias("x")) for i, x in enumerate(xs)
    ]
    cells = bucketed.select(F.inline(F.array(*entries))).filter(F.col("b").between(0, NAN_BUCKET - 1))

    ends = (F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    per_bucket: dict[int, list] = {}
    for r in cells.groupBy("i", "b").agg(*ends).collect():  # columns x buckets rows at most
        per_bucket.setdefault(r["i"], []).append(r)
    values: dict[tuple[int, float], float] = {}
    wanted: dict[tuple[int, int], dict[int, list[float]]] = {}
    for i, found in per_bucket.items():
        n = sum(r["n"] for r in found)
        found.sort(key=lambda r: r["b"])
        for share in shares:
            rank = max(1, math.ceil(round(share * n, 9)))
            for r in found:
                if rank <= r["n"]:
                    break
                rank -= r["n"]
            if r["lo"] == r["hi"]:
                values[i, share] = r["lo"]
            else:
                wanted.setdefault((i, r["b"]), {}).setdefault(rank, []).append(share)
    if wanted:
        values |= _ranked_values(cells, wanted)
    return {c: [values[i, s] for s in shares] if i in per_bucket else [] for i, c in enumerate(columns)}


def _ranked_values(
    cells: DataFrame, wanted: Mapping[tuple[int, int], Mapping[int, list[float]]]
) -> dict[tuple[int, float], float]:
    """The values at the wanted ranks, from counts per value in the buckets that hold them."""
    chosen = reduce(lambda a, b: a | b, [(F.col("i") == i) & (F.col("b") == b) for i, b in wanted])
    inside = Window.partitionBy("i", "b").orderBy("x")
    ranked = cells.filter(chosen).groupBy("i", "b", "x").agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked.withColumn("upto", F.sum("n").over(inside))
    hits = reduce(
        lambda a, b: a | b,
        [
            (F.col("i") == i) & (F.col("b") == b) & (F.col("upto") >= r) & (F.col("upto") - F.col("n") < r)
            for (i, b), ranks in wanted.items()
            for r in ranks
        ],
    )
    values = {}
    for r in ranked.filter(hits).collect():
        for rank, shares in wanted[r["i"], r["b"]].items():
            if r["upto"] - r["n"] < rank <= r["upto"]:
                values |= {(r["i"], share): r["x"] for share in shares}
    return values
