"""Connected components of an edge table by alternating stars.

Each round hangs the larger neighbours of every node on its smallest one, then the
smaller ones. Rounds end when the edges no longer change; they are then one star
for each component, centred on its smallest node. A hub is only reduced by a
minimum (combined before the shuffle) and joined back, which adaptive execution
may split. Every round is written to the shared folder, so a lost executor never
costs more than a round, and nothing is collected.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))


def large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (a, b): every node but the smallest of its component, and that smallest node."""
    now = materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        now = materialise(small_star(large_star(now)), "edges")
        new = _state(now)
        if new == seen:
            break
        seen = new
    return now
