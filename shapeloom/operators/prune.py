"""Pruning by confidence and support; all pairs of thresholds in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TYPE
from ..functions.terms import is_valid_iri


def with_thresholds(df: DataFrame, thresholds: list[tuple[float, int]]) -> DataFrame:
    """Each row once for each pair: conf_thr, supp_thr."""
    pairs = F.array(*[F.struct(F.lit(float(c)).alias("conf_thr"), F.lit(int(s)).alias("supp_thr")) for c, s in thresholds])
    return df.select("*", F.inline(pairs))


def over_support(value: Column, threshold: Column) -> Column:
    """Above the threshold; 1 is met by equality."""
    return F.when(threshold == 1, value >= 1).otherwise(value > threshold)


def prune_nodes(counts: DataFrame, thresholds: list[tuple[float, int]]) -> DataFrame:
    """c, n, conf_thr, supp_thr of classes that stay."""
    found = with_thresholds(counts, thresholds)
    return found.where(over_support(F.col("n"), F.col("supp_thr")) & is_valid_iri(F.col("c")))


def rejected_classes(counts: DataFrame) -> DataFrame:
    """c, n of classes that no shape is made for, as their name is no IRI."""
    return counts.where(~F.coalesce(is_valid_iri(F.col("c")), F.lit(False)))


def relative_support(support: Column, reservoir: Column, n: Column) -> Column:
    """A threshold scaled to the share of the class that was sampled."""
    return support * F.least(F.lit(1.0), reservoir / n)


def prune_positive(stats: DataFrame, thresholds: list[tuple[float, int]], type_predicate: str = TYPE) -> DataFrame:
    """Rows of stats that stay; the type property always does. With a column reservoir, support is relative."""
    found = with_thresholds(stats, thresholds)
    bound = F.col("supp_thr").cast("double")
    if "reservoir" in stats.columns:
        bound = F.when(F.col("supp_thr") == 1, bound).otherwise(relative_support(bound, F.col("reservoir"), F.col("n")))
    enough = F.when(F.col("supp_thr") == 1, F.col("support") >= 1).otherwise(F.col("support") > bound)
    return found.where((F.col("p") == type_predicate) | ((F.col("confidence") > F.col("conf_thr")) & enough))


def prune_negative(stats: DataFrame, thresholds: list[tuple[float, int]], type_predicate: str = TYPE) -> DataFrame:
    """Rows that a negative shape is made of: neither trusted nor frequent. Never the type property."""
    found = with_thresholds(stats, thresholds)
    bound = F.col("supp_thr").cast("double")
    if "reservoir" in stats.columns:
        bound = F.when(F.col("supp_thr") == 1, bound).otherwise(relative_support(bound, F.col("reservoir"), F.col("n")))
    return found.where(
        (F.col("p") != type_predicate) & (F.col("confidence") <= F.col("conf_thr")) & (F.col("support") < bound)
    )


def only_classes(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the listed classes (column c)."""
    return df.join(classes.select("c").distinct(), "c", "left_semi")
