"""Mutual information by nearest neighbours (R3), without binning and without noise.

After Ross, "Mutual information between discrete and continuous data sets" (PLoS ONE 2014): the radius of a
row is the distance to its k-th nearest value of its own class, and what counts is how many rows of any class
lie within it. Rows of a class that occurs once are left out.

Scale: rows become counts per (feature, class, value) before any shuffle. Both steps are ranks in an order:
values of a class are cut into blocks by their place, with ``k`` values of the blocks around as a halo, and
the ends of all intervals are looked up among the values over ordered buckets. No feature or class is a group.

Defined results: null and NaN entries are left out of their feature alone, null labels everywhere; a feature
without a usable row has no score; values whose distance differs from the radius by less than rounding are on
it, and on it means outside, unless the radius is 0; the score is 0 at least.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.ordering import order_cuts
from lexiloom.session import materialise

BLOCK = 100_000
NEAR = 1e-12


def digamma(n: Column) -> Column:
    """Of numbers from 1 on: shifted up by ten, where the series has twelve digits."""
    y = n + 10.0
    series = F.ln(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6)
    return series - reduce(lambda a, b: a + b, [1 / (n + float(i)) for i in range(10)])


def neighbour_information(df: DataFrame, features: Sequence[str], label: str, k: int = 3, block: int = BLOCK) -> DataFrame:
    """``feature, mi`` in nats between the label and each feature."""
    rows = df.filter(F.col(label).isNotNull())
    numbers = rows.select(F.col(label).alias("cls"), *[(F.col(f"`{c}`").cast("double") + 0.0).alias(f"x{i}") for i, c in enumerate(features)])
    entries = [F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("x")) for i in range(len(features))]
    cells = numbers.select("cls", F.inline(F.array(*entries))).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    cells = cells.groupBy("i", "cls", "x").agg(F.count(F.lit(1)).alias("m"))
    sizes = cells.groupBy("i", "cls").agg(F.sum("m").alias("rows")).filter("rows > 1")
    cells = materialise(cells.join(sizes, ["i", "cls"]), "information-cells")

    cuts = order_cuts(numbers, [f"x{i}" for i in range(len(features))])

    def bucketed(table: DataFrame) -> DataFrame:
        """The order bucket of each ``x``, by the cuts of its own feature."""
        parts = [c.add(table.filter(F.col("i") == i), "x", "bucket") for i, c in enumerate(cuts)]
        return reduce(DataFrame.unionByName, parts)

    radii = materialise(_radii(_placed(bucketed(cells)), k, block), "information-radii")
    inside = _inside(cells, radii, bucketed)
    known = inside.join(radii, ["i", "cls", "x"])
    m = F.col("m").cast("double")
    total = F.sum(m)
    terms = digamma(F.col("kth").cast("double")) - digamma(F.col("rows").cast("double")) - digamma(F.col("inside").cast("double"))
    scores = known.groupBy("i").agg((digamma(total) + F.sum(m * terms) / total).alias("mi"))
    name = F.get(F.array(*[F.lit(c) for c in features]), F.col("i"))
    return scores.select(name.alias("feature"), F.greatest("mi", F.lit(0.0)).alias("mi"))


def _before(rows: DataFrame, groups: Sequence[str], amount: str) -> DataFrame:
    """Sum of ``amount`` over the earlier buckets of a group, a row for each bucket."""
    sums = rows.groupBy(*groups, "bucket").agg(F.sum(amount).alias("own"))
    earlier = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*groups, "bucket", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"))


def _placed(cells: DataFrame) -> DataFrame:
    """``place``: how many smaller values the class has."""
    inner = Window.partitionBy("i", "cls", "bucket").orderBy("x")
    counted = cells.withColumn("one", F.lit(1))
    local = counted.withColumn("at", F.row_number().over(inner) - 1)
    both = local.join(_before(counted, ["i", "cls"], "one"), ["i", "cls", "bucket"])
    return both.select("i", "cls", "x", "m", "rows", (F.col("before") + F.col("at")).alias("place"))


def _radii(cells: DataFrame, k: int, block: int) -> DataFrame:
    """``radius`` and ``kth``, the number of neighbours it stands for."""
    own, rest = F.floor(F.col("place") / block), F.col("place") % block
    halo = F.array_compact(F.array(own, F.when(rest < k, own - 1), F.when(rest >= block - k, own + 1)))
    spread = cells.select("*", own.alias("own"), F.explode(F.array_distinct(halo)).alias("block"))
    around = Window.partitionBy("i", "cls", "block").orderBy("place").rowsBetween(-k, k)
    near = spread.withColumn("near", F.collect_list(F.struct("x", "m")).over(around)).filter(F.col("block") == F.col("own"))
    kth = F.least(F.lit(k), F.col("rows") - 1)
    steps = F.transform(
        "near", lambda y: F.struct(F.abs(y["x"] - F.col("x")).alias("d"), (y["m"] - (y["x"] == F.col("x")).cast("int")).alias("m"))
    )
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(0.0).alias("d"))
    last = F.aggregate(
        F.sort_array(steps),
        start,
        lambda s, y: F.struct((s["seen"] + y["m"]).alias("seen"), F.when(s["seen"] < F.col("kth"), y["d"]).otherwise(s["d"]).alias("d")),
    )
    return near.withColumn("kth", kth).select("i", "cls", "x", "m", "rows", "kth", last["d"].alias("radius"))


def _inside(cells: DataFrame, radii: DataFrame, bucketed) -> DataFrame:
    """``inside``: rows of any class within the radius of a value, itself included."""
    values = cells.groupBy("i", "x").agg(F.sum("m").alias("n"))
    reach = F.col("radius") - NEAR * (F.abs("x") + F.col("radius"))
    ends = radii.select("i", "cls", F.col("x").alias("of"), F.when(F.col("radius") > 0, reach).otherwise(0.0).alias("reach"), (F.col("radius") > 0).alias("open"))
    # an end stands before equal values where it is below them: the lower one always, the upper one if it is open
    low = ends.select("i", "cls", "of", (F.col("of") - F.col("reach")).alias("x"), F.when(F.col("open"), 2).otherwise(0).alias("turn"), F.lit(-1).alias("sign"))
    high = ends.select("i", "cls", "of", (F.col("of") + F.col("reach")).alias("x"), F.when(F.col("open"), 0).otherwise(2).alias("turn"), F.lit(1).alias("sign"))
    values = values.select("i", "x", "n", F.lit(1).alias("turn"))
    events = bucketed(values.unionByName(low.unionByName(high).withColumn("n", F.lit(0).cast("bigint")), allowMissingColumns=True))
    inner = Window.partitionBy("i", "bucket").orderBy("x", "turn").rowsBetween(Window.unboundedPreceding, 0)
    ranked = events.withColumn("upto", F.sum("n").over(inner)).join(_before(events, ["i"], "n"), ["i", "bucket"])
    found = ranked.filter("sign is not null").groupBy("i", "cls", "of")
    count = F.sum(F.col("sign") * (F.col("upto") + F.col("before")))
    return found.agg(count.alias("inside")).withColumnRenamed("of", "x")
