"""Examples for people: nodes of a class, values of its properties, labels and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RDFS_LABEL
from ..functions.terms import raw_literal
from .sampling import reservoir, seeded

#: Examples of a class, and of a property in a class.
MOST = 5
NO_LABEL = " "


def example_nodes(classes: DataFrame, k: int = MOST, seed: int = 100) -> DataFrame:
    """c, s."""
    return reservoir(classes, k, seed).select("c", "s")


def example_values(triples: DataFrame, nodes: DataFrame, k: int = MOST, seed: int = 100) -> DataFrame:
    """c, p, actual, raw: distinct values of the example nodes' properties, at most k for each class and property."""
    raw = F.when(F.col("o_kind") == "literal", raw_literal(F.col("o"), F.col("o_datatype"), F.col("o_lang"))).otherwise(F.col("o"))
    found = triples.join(nodes, "s").select("c", "p", F.col("o").alias("actual"), raw.alias("raw"), "o_kind").distinct()
    rank = F.row_number().over(W.partitionBy("c", "p").orderBy(seeded(seed, "raw"), "raw"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def labels(triples: DataFrame, wanted: DataFrame, predicates: tuple[str, ...] = (RDFS_LABEL,)) -> DataFrame:
    """iri, label: the least label of each wanted iri."""
    found = triples.where(F.col("p").isin(*predicates)).join(wanted.select(F.col("iri").alias("s")).distinct(), "s", "left_semi")
    return found.groupBy(F.col("s").alias("iri")).agg(F.min("o").alias("label"))


def wanted_labels(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """iri: classes, properties, example nodes and values."""
    return (
        nodes.select(F.col("c").alias("iri"))
        .union(nodes.select("s"))
        .union(values.select("p"))
        .union(values.where("o_kind <> 'literal'").select("actual"))
        .distinct()
    )


def _labelled(df: DataFrame, column: str, known: DataFrame, out: str) -> DataFrame:
    k = known.select(F.col("iri").alias("_iri"), F.col("label").alias("_label"))
    shown = F.concat(F.col(column), F.lit("("), F.coalesce("_label", F.lit(NO_LABEL)), F.lit(")"))
    return df.join(k, F.col(column) == F.col("_iri"), "left").withColumn(out, shown).drop("_iri", "_label")


def property_kinds(triples: DataFrame) -> DataFrame:
    """p, is_literal: whether any value is a literal."""
    return triples.groupBy("p").agg(F.bool_or(F.col("o_kind") == "literal").alias("is_literal"))


def property_examples(values: DataFrame, known: DataFrame) -> DataFrame:
    """c, p, examples: literals as written, others as value(label); sorted."""
    shown = _labelled(values.where("o_kind <> 'literal'"), "raw", known, "shown").select("c", "p", "shown")
    lits = values.where("o_kind = 'literal'").select("c", "p", F.col("raw").alias("shown"))
    return lits.unionByName(shown).groupBy("c", "p").agg(F.array_sort(F.collect_set("shown")).alias("examples"))


def class_examples(nodes: DataFrame, triples: DataFrame, shapes: DataFrame, known: DataFrame) -> DataFrame:
    """c, s, sentence: node(label) is a class(label); has [at least m] [at most n] property(label); ...

    shapes: c, p, min_count, max_count of the properties that a pruning left. Properties come in order of p.
    """
    had = triples.join(nodes, "s").select("c", "s", "p").distinct()
    kept = had.join(shapes.select("c", "p", "min_count", "max_count"), ["c", "p"])
    part = F.concat(
        F.lit("has "),
        F.when(F.col("min_count") > 0, F.concat(F.lit("at least "), F.col("min_count").cast("string"), F.lit(" "))).otherwise(""),
        F.when(F.col("max_count").isNotNull(), F.concat(F.lit("at most "), F.col("max_count").cast("string"), F.lit(" "))).otherwise(""),
        F.col("shown_p"),
    )
    parts = _labelled(kept, "p", known, "shown_p").select("c", "s", "p", part.alias("part"))
    said = parts.groupBy("c", "s").agg(F.array_sort(F.collect_list(F.struct("p", "part"))).alias("parts"))
    heads = _labelled(_labelled(nodes, "s", known, "shown_s"), "c", known, "shown_c")
    sentence = F.concat_ws(
        "; ", F.concat("shown_s", F.lit(" is a "), "shown_c"), F.transform("parts", lambda x: x["part"])
    )
    return heads.join(said, ["c", "s"], "left").select("c", "s", sentence.alias("sentence"))


def with_examples(shapes: DataFrame, examples: DataFrame) -> DataFrame:
    """shapes with examples of their class and property."""
    return shapes.join(examples, ["c", "p"], "left")


def registry(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """kind (class, node, property, value), iri: all that examples mention."""
    def kind(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("kind"), F.col(column).alias("iri"))

    found = kind(nodes, "c", "class").union(kind(nodes, "s", "node")).union(kind(values, "p", "property"))
    return found.union(kind(values.where("o_kind <> 'literal'"), "actual", "value")).distinct()
