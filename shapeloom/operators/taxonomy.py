"""Roll-up of class sizes over a subclass hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, stored


def ancestors(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """child, parent of the transitive closure of edges, cycles included; each round doubles the length of paths.

    Rounds are written to the shared folder, and only the last one stays. The closure has a row for each class and ancestor.
    """
    closure = stored(edges.select("child", "parent").where("child <> parent").distinct(), "ancestors")
    n = closure.count()
    for _ in range(most_rounds):
        step = closure.alias("a").join(closure.alias("b"), F.col("a.parent") == F.col("b.child"))
        longer = step.select("a.child", "b.parent").where("child <> parent")
        before, closure = closure, stored(closure.union(longer).distinct(), "ancestors")
        drop(before)
        now = closure.count()
        if now == n:
            return closure
        n = now
    raise ValueError(f"paths are longer than {most_rounds} rounds reach")


def roll_up(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """c, own, total: the class's own count, and with all its descendants', each counted once."""
    below = ancestors(edges).join(counts.select(F.col("c").alias("child"), "n"), "child")
    sums = below.groupBy(F.col("parent").alias("c")).agg(F.sum("n").alias("below"))
    nodes = counts.select("c").union(edges.select("child")).union(edges.select("parent")).distinct()
    found = nodes.join(counts, "c", "left").join(sums, "c", "left")
    own = F.coalesce("n", F.lit(0))
    return found.select("c", own.alias("own"), (own + F.coalesce("below", F.lit(0))).alias("total"))


def roll_up_levels(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """c, total where each parent adds only its children's own counts."""
    below = edges.join(counts.select(F.col("c").alias("child"), "n"), "child").groupBy("parent").agg(F.sum("n").alias("below"))
    found = counts.join(below, F.col("c") == F.col("parent"), "full_outer")
    total = F.coalesce("n", F.lit(0)) + F.coalesce("below", F.lit(0))
    return found.select(F.coalesce("c", "parent").alias("c"), total.alias("total"))


def prune_small(edges: DataFrame, totals: DataFrame, least: int = 100) -> DataFrame:
    """Edges both of whose ends have more than least instances."""
    big = totals.where(F.col("total") > least).select("c")
    return edges.join(big.withColumnRenamed("c", "child"), "child", "left_semi").join(
        big.withColumnRenamed("c", "parent"), "parent", "left_semi"
    )


def dot(edges: DataFrame) -> DataFrame:
    """value: lines of a DOT graph's edges."""
    return edges.select(F.concat(F.lit('"'), "parent", F.lit('" -> "'), "child", F.lit('";')).alias("value"))
