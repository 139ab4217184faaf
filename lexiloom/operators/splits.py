"""Leak-free splits (K1-K5).

Every row has a uniform hash of ``seed:id``. A split is a set of cut points on
that hash, found once from two narrow columns; the same seed always gives the
same rows. Without classes the cuts are part of an expression. With classes they
are a small table of one row per class, joined by its measured size: as a rule it
is sent to the tasks, so the wide table is not shuffled, and any number of classes
works.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import materialise

SEED = 42
PREFIX = 3  # hex digits: 4,096 ranges per class
PAST_ALL = "g"  # above every hexadecimal hash

_HASH, _CLASS, _CUTS = "_split_hash", "_split_class", "_split_cuts"


def split_hash(key: str | Column, seed: int = SEED) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


@dataclass(frozen=True)
class HashCuts:
    """The hashes at which a new side starts: one list for all rows, or a table of one list per class."""

    key: str
    label: str | None
    seed: int
    cuts: list[str] | DataFrame

    def add(self, df: DataFrame, name: str) -> DataFrame:
        """Add the side: 0 below the first cut, 1 from it on, and so forth; null without class or key.

        The hash is a column of its own first, so it is computed once per row.
        """
        hashed = df.withColumn(_HASH, split_hash(self.key, self.seed))
        h = F.col(_HASH)
        if self.label is None:
            return hashed.withColumn(name, _cuts_below(h, self.cuts)).drop(_HASH)
        both = hashed.join(self.cuts, hashed[self.label] == self.cuts[_CLASS], "left")
        side = F.when(h.isNotNull(), F.size(F.filter(_CUTS, lambda c: c <= h)))
        return both.withColumn(name, F.when(F.col(_CUTS).isNotNull(), side)).drop(_HASH, _CLASS, _CUTS)


def fold_sizes(n: int, k: int) -> list[int]:
    """Sizes of k folds over n rows; they differ by one at most."""
    return [n // k + (1 if f < n % k else 0) for f in range(k)]


def fit_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = SEED) -> HashCuts:
    def starts(n: Column) -> list[Column]:
        return [f * F.floor(n / k) + F.least(F.lit(f), n % k) for f in range(1, k)]

    return _fit(df, key, label, seed, starts)


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Add ``fold``: per class, fold sizes differ by one at most. Rows without a label have none."""
    return fit_folds(df, key, label, k, seed).add(df, "fold")


def stratified_holdout(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add ``split``: ``ceil(share * n)`` rows of each class are ``val``, the others ``train``."""
    fitted = _fit(df, key, label, seed, lambda n: [_held_out(n, share)])
    return _named(fitted.add(df, "split"))


def random_holdout(df: DataFrame, key: str, share: float = 0.1, seed: int = SEED, exact: bool = False) -> DataFrame:
    """Add ``split`` without looking at other rows; ``exact`` holds out ``ceil(share * n)`` rows."""
    if exact:
        fitted = _fit(df, key, None, seed, lambda n: [_held_out(n, share)])
        return _named(fitted.add(df, "split"))
    # hashes are uniform hex strings of fixed length, so string order is number order
    limit = f"{round(min(share, 1.0) * 16**8):09x}"
    below = F.concat(F.lit("0"), F.substring(split_hash(key, seed), 1, 8)) < limit
    return df.withColumn("split", F.when(below, "val").when(F.col(key).isNotNull(), "train"))


def group_holdout(df: DataFrame, group: str, share: float = 0.1, seed: int = SEED) -> DataFrame:
    """Add ``split`` by group: ``ceil(share * groups)`` whole groups are ``val``.

    Rows without a group are dropped. Only distinct group keys are shuffled.
    """
    rows = df.filter(F.col(group).isNotNull())
    groups = rows.select(group).distinct()
    fitted = _fit(groups, group, None, seed, lambda n: [_held_out(n, share)])
    return _named(fitted.add(rows, "split"))


def first_per_train_group(df: DataFrame, group: str, key: str, share: float = 0.1, seed: int = SEED) -> DataFrame:
    """The first row of each train group and every row of the validation groups."""
    rows = group_holdout(df, group, share, seed)
    train = rows.filter(F.col("split") == "train")
    first = train.groupBy(group).agg(F.min_by(F.struct(*rows.columns), key).alias("_first")).select("_first.*")
    return first.unionByName(rows.filter(F.col("split") == "val"))


def _held_out(n: Column, share: float) -> Column:
    return F.ceil(F.round(F.lit(share) * n, 9))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("split", F.when(F.col("split") == 0, "val").when(F.col("split") == 1, "train"))


def _cuts_below(h: Column, cuts: list[str]) -> Column:
    zero = F.when(h.isNotNull(), F.lit(0))
    return reduce(lambda acc, c: acc + (h >= c).cast("int"), cuts, zero)


def _fit(df: DataFrame, key: str, label: str | None, seed: int, starts: Callable[[Column], list[Column]]) -> HashCuts:
    """Find the exact hash at each wanted rank.

    First pass: row counts per class and hash prefix, and how many rows of the class lie before each prefix.
    Second pass: only the prefixes that hold a cut are ranked. Both are tables; the driver sees them only
    where there are no classes, one hash for each cut.
    """
    cls = F.lit(0) if label is None else F.col(label)
    hashed = df.select(cls.alias("cls"), split_hash(key, seed).alias("h")).filter("cls is not null and h is not null")
    hashed = hashed.withColumn("p", F.substring("h", 1, PREFIX))

    whole = Window.partitionBy("cls")  # at most 16 ** PREFIX rows
    before = F.sum("m").over(whole.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    counts = hashed.groupBy("cls", "p").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.select("cls", "p", "m", F.coalesce(before, F.lit(0)).alias("before"), F.sum("m").over(whole).alias("n"))
    ranks = [r.cast("bigint") for r in starts(F.col("n"))]
    counts = counts.select("cls", "p", "m", "before", "n", F.posexplode(F.array(*ranks)).alias("i", "rank"))
    inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m"))
    last = F.col("before") + F.col("m") == F.col("n")
    spots = materialise(
        counts.where(inside | (last & (F.col("rank") >= F.col("n")))).select("cls", "p", "i", F.when(inside, F.col("rank") - F.col("before")).alias("r")),
        "split-spots",
    )
    chosen = spots.where("r is not null").select("cls", "p").distinct()
    ranked = hashed.join(chosen, ["cls", "p"], "left_semi")
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("cls", "p").orderBy("h")) - 1)
    found = ranked.join(spots.where("r is not null"), ["cls", "p", "r"]).select("cls", "i", "h")
    found = found.unionByName(spots.where("r is null").select("cls", "i", F.lit(PAST_ALL).alias("h")))
    cuts = found.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("c"))
    cuts = cuts.select(F.col("cls").alias(_CLASS), F.transform("c", lambda x: x["h"]).alias(_CUTS))
    if label is None:
        row = cuts.first()
        return HashCuts(key, None, seed, list(row[_CUTS]) if row else [])
    return HashCuts(key, label, seed, materialise(cuts, "split-cuts"))
