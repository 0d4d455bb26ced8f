"""Statistics of shapes, and precision and recall between two sets of shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = -999


def counts(nodes: DataFrame, shapes: DataFrame, keys: list[str]) -> DataFrame:
    """COUNT_NS, COUNT_PS, COUNT_CC (direct classes), COUNT_LC (direct literals), COUNT_MCC (min counts) for each key."""
    of_nodes = nodes.groupBy(*keys).agg(F.count_distinct("name").alias("COUNT_NS"))
    of_shapes = shapes.groupBy(*keys).agg(
        F.count("*").alias("COUNT_PS"),
        F.count("class").alias("COUNT_CC"),
        F.count(F.when(F.col("node_kind") == "Literal", 1)).alias("COUNT_LC"),
        F.count("min_count").alias("COUNT_MCC"),
    )
    out = of_nodes.join(of_shapes, keys, "full_outer")
    return out.select(*keys, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in out.columns if c not in keys])


def spreads(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """AVG_, MIN_ and MAX_ of PS, CC, LC and MCC by node shape (c); node shapes without any of a kind do not count for it."""
    per = shapes.groupBy(*keys, "c").agg(
        F.count("*").alias("PS"),
        F.count("class").alias("CC"),
        F.count(F.when(F.col("node_kind") == "Literal", 1)).alias("LC"),
        F.count("min_count").alias("MCC"),
    )

    def some(c: str) -> Column:
        return F.when(F.col(c) > 0, F.col(c))

    out = []
    for c in ("PS", "CC", "LC", "MCC"):
        out.append(F.coalesce(F.avg(some(c)), F.lit(float(EMPTY))).alias(f"AVG_{c}"))
        out.append(F.coalesce(F.min(some(c)), F.lit(EMPTY)).cast("long").alias(f"MIN_{c}"))
        out.append(F.coalesce(F.max(some(c)), F.lit(EMPTY)).cast("long").alias(f"MAX_{c}"))
    return per.groupBy(*keys).agg(*out)


def nested_counts(members: DataFrame, keys: list[str]) -> DataFrame:
    """COUNT_CC_NESTED, COUNT_LC_NESTED: constraints within or lists."""
    return members.groupBy(*keys).agg(
        F.count("class").alias("COUNT_CC_NESTED"), F.count(F.when(F.col("node_kind") == "Literal", 1)).alias("COUNT_LC_NESTED")
    )


def long_form(found: DataFrame) -> DataFrame:
    """Confidence, Support, COUNT, TYPE: class constraints as NonLiteral, literal ones as Literal."""
    wide = found.select(
        F.col("conf_thr").alias("Confidence"), F.col("supp_thr").alias("Support"),
        F.col("COUNT_CC").alias("NonLiteral"), F.col("COUNT_LC").alias("Literal"),
    )
    return wide.unpivot(["Confidence", "Support"], ["NonLiteral", "Literal"], "TYPE", "COUNT")


def precision_recall(truth: DataFrame, found: DataFrame, prefix: str) -> DataFrame:
    """One row: {prefix}_truth, {prefix}_found, {prefix}_both, precision_{prefix}, recall_{prefix}. Both: key columns only."""
    on = truth.columns
    a = truth.distinct().withColumn("in_a", F.lit(1))
    b = found.select(*on).distinct().withColumn("in_b", F.lit(1))
    n = a.join(b, on, "full_outer").agg(
        F.count("in_a").alias("a"), F.count("in_b").alias("b"), F.count(F.col("in_a") + F.col("in_b")).alias("both")
    )
    return n.select(
        F.col("a").alias(f"{prefix}_truth"), F.col("b").alias(f"{prefix}_found"), F.col("both").alias(f"{prefix}_both"),
        F.round(F.try_divide(F.col("both"), F.col("b")), 2).alias(f"precision_{prefix}"),
        F.round(F.try_divide(F.col("both"), F.col("a")), 2).alias(f"recall_{prefix}"),
    )


def wrongly_pruned(truth: DataFrame, found: DataFrame) -> DataFrame:
    return truth.select("c", "p").subtract(found.select("c", "p"))


def unmatched(a: DataFrame, b: DataFrame, everything: DataFrame) -> DataFrame:
    """shape, in_a, in_b of each shape of everything."""
    a, b = (x.select("shape").distinct().withColumn(f"in_{k}", F.lit(True)) for x, k in ((a, "a"), (b, "b")))
    found = everything.select("shape").distinct().join(a, "shape", "left").join(b, "shape", "left")
    return found.select("shape", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_a", "in_b")])
