"""Mixing sources to target weights by capped water-filling.

Targets share the wanted total by weight, but none exceeds max_epochs times its source's size; what that cuts is
reshared by weight among the others until none is above. With sources ordered by cap over weight the
water level has a closed form in running sums, so no loop is needed. A target is then met by whole
repetitions of all documents and a fractional one of documents in a seeded order: those before the mark are
taken once more, the one at the mark in part. The order is cut into bins by hash, so that running sums
over a source, also one that holds most rows, are made of sums of bins and sums within each bin.

A null text has size 0; a null source is a source of its own, ordered last. Sources of size 0 have target 0. Repeated rows
are rows of their own with equal places in the order; at the mark
they share what is left. If the total exceeds all caps, each source is at its cap.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import small, stored, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17
#: Rows of a bin of the order, about; the result does not depend on it.
BIN_ROWS = 50_000


def n_words(text: Column) -> Column:
    """Runs of other than white space; each is reduced to one mark, which is counted."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return (F.length(marks) - F.length(F.regexp_replace(marks, "x", ""))).cast("long")


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sources: source, source_size, weight. Adds target."""
    everything = W.partitionBy()  # one row for each source
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = sources.withColumn("cap", F.col("source_size") * float(max_epochs))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn(
        "total", F.sum("source_size").over(everything) * share
    )
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))).withColumn(
        "level",
        (F.col("total") - F.col("capped"))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))),
    )
    # the water level: that of the first source, by ratio, which it does not fill
    rank = F.row_number().over(W.orderBy("ratio", F.col("source").asc_nulls_last()))
    unfilled = F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))
    s = s.withColumn("rank", rank).withColumn("water", F.min(unfilled).over(everything)["level"])
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("water") * F.col("weight"))
    )
    return s.select("source", "source_size", "weight", target.alias("target"))


def weigh(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """source, source_size, weight: weights repeat over the sources by code point, null last."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    return totals.withColumn("weight", F.get(F.array(*map(F.lit, weights)), rank % len(weights)).cast("double"))


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _plan(sized: DataFrame) -> DataFrame:
    """One row for each source: source_size, target, epochs, and the mark: cut (place in the order), rest, ties, at_cut."""
    plan = water_fill(weigh(sized)).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    )
    plan = stored(
        plan.withColumn("want", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")),
        "mix-plan",
    )
    bits = max(12, (sized.count() // BIN_ROWS).bit_length())
    sized = sized.withColumn("bin", F.shiftright("o", 64 - bits))
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    before = F.coalesce(
        F.sum("n").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    bins = bins.withColumn("before", before).alias("b").join(
        plan.select(F.col("source").alias("_s"), "want"), F.col("source").eqNullSafe(F.col("_s"))
    )
    marked = bins.where("before <= want AND before + n > want").select("_s", F.col("bin").alias("_bin"), "before", "want")
    inside = F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_bin"))
    places = sized.join(marked, inside).groupBy("_s", "before", "want", "o").agg(
        F.sum("size").alias("n"), F.count("*").alias("ties")
    )
    upto = W.partitionBy("_s").orderBy("o").rowsBetween(W.unboundedPreceding, -1)  # within one bin
    places = places.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
    marks = places.where("before <= want AND before + n > want").select(
        "_s", F.col("o").alias("cut"), (F.col("want") - F.col("before")).alias("rest"), "ties", F.col("n").alias("at_cut")
    )
    return stored(plan.join(marks, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-marks")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, o) with their source's plan, which is broadcast if it is small."""
    return rows.join(small(plan.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _order(seed).alias("o"))
    return stored(rows, "mix-sizes")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted; of the document at the mark a part)."""
    sized = _sized(docs, seed)
    rows = _with_plan(sized, _plan(sized))
    extra = (
        F.when(F.col("cut").isNull() | (F.col("o") < F.col("cut")), F.least("size", "want"))
        .when(F.col("o") == F.col("cut"), F.floor(F.col("rest") / F.col("ties")))
        .otherwise(F.lit(0))
    )
    taken = (F.col("epochs") * F.col("size") + extra).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix_rows(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns.

    The document at the mark is taken whole if at least half of it is wanted. Documents without words are kept once.
    """
    plan = _plan(_sized(docs, seed))
    names = docs.columns
    rows = _with_plan(docs.withColumn("_o", _order(seed)).select(F.struct(*names).alias("d"), "source", F.col("_o").alias("o"),
                      (n_words(F.col("text")) == 0).alias("empty")), plan)
    once = (
        F.when(F.col("cut").isNull(), F.col("want") > 0)
        .when(F.col("o") == F.col("cut"), F.col("rest") * 2 >= F.col("at_cut"))
        .otherwise(F.col("o") < F.col("cut"))
    )
    times = F.when(F.col("empty"), F.lit(1)).otherwise((F.col("epochs") + once.cast("int")).cast("int"))
    return rows.select("d", F.explode(F.array_repeat(F.lit(0), times)).alias("_")).select("d.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


QUERIES = {"op3_mixing": op3_mixing}
ORACLES: dict[str, str] = {}
