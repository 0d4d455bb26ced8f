"""Class counts and support kept up to date over a stream of triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TYPE
from ..functions.terms import UNDEFINED
from ..operators.profile import types


def stream_class_count(triples: DataFrame, type_predicate: str = TYPE) -> DataFrame:
    """c, n over a streaming DataFrame of triples; for the update or complete mode."""
    return triples.where(F.col("p") == type_predicate).groupBy(F.col("o").alias("c")).agg(F.count("*").alias("n"))


def stream_support(triples: DataFrame, known: DataFrame, type_predicate: str = TYPE, arrived: str | None = None, late: str = "1 day") -> DataFrame:
    """c, p, ot, support of a stream whose entities and objects have their types in known, a batch of triples.

    Repeats of (s, p, ot) are dropped by the stream's own state. With a column arrived (a timestamp) repeats are known for the time late,
    and the state is bounded by it; without one it grows with the stream. Types that arrive later than a triple do not reach back:
    known has to be refreshed between runs.
    """
    classes = types(known, type_predicate)
    of_object = classes.select(F.col("s").alias("_o"), F.col("c").alias("oc"))
    found = (triples if arrived is None else triples.withWatermark(arrived, late)).join(of_object, F.col("o") == F.col("_o"), "left")
    ot = F.when(F.col("o_kind") == "literal", F.col("o_datatype")).otherwise(F.coalesce("oc", F.lit(UNDEFINED)))
    found = found.select("s", "p", ot.alias("ot"), *([] if arrived is None else [arrived]))
    once = found.dropDuplicates(["s", "p", "ot"]) if arrived is None else found.dropDuplicatesWithinWatermark(["s", "p", "ot"])
    return once.join(classes, "s").groupBy("c", "p", "ot").agg(F.count("*").alias("support"))


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums of two tables of counts."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum(value).alias(value))


def keep_counts(counts_of, path: str, keys: list[str], value: str):
    """A function for foreachBatch: adds counts_of(batch) to the table at path, whose newest version is the folder of the highest number.

    A batch that is run again after a failure is written anew from the version before it, so it counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = counts_of(batch)
        if number > 0:
            new = merge_counts(batch.sparkSession.read.parquet(f"{path}/{number - 1}"), new, keys, value)
        new.write.mode("overwrite").parquet(f"{path}/{number}")

    return write
