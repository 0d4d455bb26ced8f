"""Node and property shapes as typed tables, made from shape_stats (all rows or those that a pruning left).

A set of shapes is keyed by whatever columns keys names beyond class and property (such as the thresholds), so
the shapes of all prunings are made in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import TYPE
from ..functions.terms import LANG_STRING, SHAPES, UNDEFINED, XSD, XSD_STRING, is_valid_iri, local_name


def node_shapes(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """name, target_class, support (and keys). Classes with equal local names share a name."""
    name = F.concat(F.lit(SHAPES), local_name(F.col("c")), F.lit("Shape"))
    found = counts.where(is_valid_iri(F.col("c")))
    return found.select(name.alias("name"), F.col("c").alias("target_class"), F.col("n").alias("support"), *keys or [])


def _constraint(ot: str):
    """node_kind, datatype, class that an object type stands for."""
    x = F.col(ot)
    is_data = x.startswith("<")
    return [
        F.when(x.isNull() | is_data, "Literal").otherwise("IRI").alias("node_kind"),
        F.when(x.isNull(), F.lit(XSD_STRING)).when(is_data, x).alias("datatype"),
        F.when(~is_data & (x != UNDEFINED), x).alias("class"),
    ]


def is_known_datatype(datatype: str):
    """Of XSD, or that of language-tagged strings; others were once written as classes."""
    x = F.col(datatype)
    return x.startswith(f"<{XSD}") | (x == LANG_STRING)


def property_names(props: DataFrame, type_predicate: str = TYPE, suffix: str = "ShapeProperty", keys: list[str] | None = None):
    """props (c, p distinct) with name: local names, numbered in the order of p where they collide within a class."""
    base = F.when(F.col("p") == type_predicate, "instanceType").otherwise(local_name(F.col("p")))
    named = props.withColumn("base", base)
    k = F.row_number().over(W.partitionBy(*keys or [], "c", "base").orderBy("p")) - 1
    numbered = F.when(k == 0, F.col("base")).otherwise(F.concat("base", F.lit("_"), k.cast("string")))
    name = F.concat(F.lit(SHAPES), numbered, local_name(F.col("c")), F.lit(suffix))
    return named.withColumn("name", name).drop("base")


def property_shapes(
    stats: DataFrame, max_one: DataFrame | None = None, type_predicate: str = TYPE, keys: list[str] | None = None,
    polarity: str = "positive",
) -> DataFrame:
    """One row for each class and property: name, kind (in, single, or, none), the constraint, counts, support.

    or_list holds the members of properties with several types, sorted by type: ot, node_kind, datatype, class,
    support, confidence. min_count is 1 where a type is had by the whole class, or the only type is undefined.
    """
    keys = keys or []
    by = [*keys, "c", "p"]
    member = F.struct("ot", *_constraint("ot"), "support", "confidence")
    found = stats.where(is_valid_iri(F.col("c"))).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(F.col("ot").isNotNull(), member))).alias("members"),
        F.bool_or(F.col("support") == F.col("n")).alias("full"),
    )
    suffix = "ShapeProperty" if polarity == "positive" else "_PS_NotShape"
    found = property_names(found, type_predicate, suffix, keys)
    if max_one is not None:
        ones = max_one.select(F.col("p").alias("_p"), F.col("c").alias("_c"), F.lit(1).alias("max_count"))
        found = found.join(ones, (F.col("p") == F.col("_p")) & (F.col("c") == F.col("_c")), "left")
    else:
        found = found.withColumn("max_count", F.lit(None).cast("int"))
    is_type, k = F.col("p") == type_predicate, F.size("members")
    one = F.get("members", F.lit(0))
    single = ~is_type & (k == 1)
    kind = F.when(is_type, "in").when(k == 1, "single").when(k > 1, "or").otherwise("none")
    least = F.when(~is_type & (F.col("full") | (single & (one["ot"] == UNDEFINED))), 1)
    return found.select(
        *by, "name", F.lit(polarity).alias("polarity"), F.col("p").alias("path"), kind.alias("kind"),
        F.when(single, one["node_kind"]).alias("node_kind"),
        F.when(single, one["datatype"]).alias("datatype"),
        F.when(single, one["class"]).alias("class"),
        F.when(~is_type & (k > 0), least).alias("min_count"),
        F.when(~is_type & (k > 0), F.col("max_count")).alias("max_count"),
        F.when(is_type | single, one["support"]).alias("support"),
        F.when(is_type | single, one["confidence"]).alias("confidence"),
        F.when(is_type, F.array("c")).alias("sh_in"),
        F.when(~is_type & (k > 1), F.col("members")).alias("or_list"),
    )


def or_members(shapes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The members of or lists, a row each."""
    return shapes.where("or_list IS NOT NULL").select(*keys or [], "c", "p", "name", F.inline("or_list"))


def sh_node_links(shapes: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, class, node: the node shape of a property shape's class; of an or list, of its class with most support."""
    direct = shapes.where(F.col("class").isNotNull()).select("name", "class")
    best = (
        or_members(shapes)
        .where(F.col("class").isNotNull())
        .groupBy("name")
        .agg(F.max_by("class", F.struct("support", "class")).alias("class"))
    )
    wanted = direct.unionByName(best).distinct()
    target = nodes.groupBy(F.col("target_class").alias("class")).agg(F.min("name").alias("node"))
    return wanted.join(target, "class").select("name", "class", "node")


def min_cardinality_shapes(stats: DataFrame, thresholds: list[tuple[float, int]], type_predicate: str = TYPE) -> DataFrame:
    """conf_thr, supp_thr, c, p, n_types, min_count: 1 where some type is trusted and frequent enough."""
    from .prune import with_thresholds

    found = with_thresholds(stats.where(F.col("p") != type_predicate), thresholds)
    enough = (F.col("support") > F.col("supp_thr")) & (F.col("confidence") > F.col("conf_thr"))
    return found.groupBy("conf_thr", "supp_thr", "c", "p").agg(
        F.count("*").alias("n_types"), F.max(enough.cast("int")).alias("min_count")
    )


def low_support_high_confidence(stats: DataFrame, support: int = 100, confidence: float = 0.10) -> DataFrame:
    """Classes as object types that are rare but trusted."""
    is_class = ~F.col("ot").startswith("<") & (F.col("ot") != UNDEFINED)
    return stats.where(is_class & (F.col("support") < support) & (F.col("confidence") > confidence))


def union_shapes(*sets: DataFrame) -> DataFrame:
    """One set of shapes of several, such as positive and negative ones; equal rows once. Of equal names the later get a number."""
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    out = out.dropDuplicates([c for c in ("conf_thr", "supp_thr", "c", "p", "polarity", "name") if c in out.columns])
    by = [c for c in ("conf_thr", "supp_thr") if c in out.columns]
    k = F.row_number().over(W.partitionBy(*by, "name").orderBy(F.col("polarity").desc(), "c", "p")) - 1
    return out.withColumn("name", F.when(k == 0, F.col("name")).otherwise(F.concat("name", F.lit("_"), k.cast("string"))))


def with_sh_node(shapes: DataFrame, nodes: DataFrame) -> DataFrame:
    """shapes with node: the node shape of their class, or of the class with most support in their list."""
    links = sh_node_links(shapes, nodes).groupBy(F.col("name").alias("_name")).agg(F.min("node").alias("node"))
    return shapes.join(links, F.col("name") == F.col("_name"), "left").drop("_name")
