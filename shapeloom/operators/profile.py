"""The profile of a graph: classes, object types, support, confidence and cardinalities.

The central table is shape_table(): c, p, ot, support, least, most, made in one pass. Subjects and objects take part as
128 bits of hash, so no shuffle carries their IRIs. Triples are reduced to one row for each (subject, property, type), with partial sums
before the shuffle, so a hub subject has as many rows as the schema has types, before these meet the classes. Cardinalities come from
the same rows by a window that needs no shuffle of its own. Objects are looked up in a left join, which Spark splits where
an object is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import TYPE
from ..functions.terms import UNDEFINED, term_hash
from ..storage import stored

KEY = ["s1", "s2"]


def hashed_types(typed: DataFrame) -> DataFrame:
    """s1, s2, c, k: the classes of each entity, and how many triples say so. typed: s, o of type triples. To be stored."""
    return typed.select(*term_hash(F.col("s"), *KEY), F.col("o").alias("c")).groupBy(*KEY, "c").agg(F.count("*").alias("k"))


def typed_properties(literals: DataFrame, links: DataFrame, known: DataFrame, untyped: str | None = UNDEFINED) -> DataFrame:
    """s1, s2, p, ot, cnt: how often an entity has a property with an object of a type: its datatype, or each class of the IRI.

    literals: s, p, o_datatype; links: s, p, o. Either may have s1, s2 in place of s, and a weight k.
    known: stored hashed_types(). untyped: what an IRI without a class gets; None leaves it null.
    """

    def keyed(df: DataFrame, *more) -> DataFrame:
        key = KEY if "s1" in df.columns else term_hash(F.col("s"), *KEY)
        return df.select(*key, "p", *more, F.col("k") if "k" in df.columns else F.lit(1).cast("long").alias("k"))

    mine = keyed(literals, F.col("o_datatype").alias("ot"))
    of_object = known.select(F.col("s1").alias("_o1"), F.col("s2").alias("_o2"), F.col("c").alias("oc"))
    linked = keyed(links, *term_hash(F.col("o"), "o1", "o2")).join(
        of_object, (F.col("o1") == F.col("_o1")) & (F.col("o2") == F.col("_o2")), "left"
    )
    found = F.col("oc") if untyped is None else F.coalesce("oc", F.lit(untyped))
    both = mine.unionByName(linked.select(*KEY, "p", found.alias("ot"), "k"))
    return both.groupBy(*KEY, "p", "ot").agg(F.sum("k").alias("cnt"))


def type_links(known: DataFrame, type_predicate: str = TYPE) -> DataFrame:
    """The type triples as links, from stored hashed_types()."""
    return known.select(*KEY, F.lit(type_predicate).alias("p"), F.col("c").alias("o"), "k")


def entity_totals(props: DataFrame) -> DataFrame:
    """s1, s2, p, cnt: values of a property, one with two classes twice."""
    return props.groupBy(*KEY, "p").agg(F.sum("cnt").alias("cnt"))


def shape_table(props: DataFrame, classes: DataFrame) -> DataFrame:
    """c, p, ot, support (entities of the class that have the property with an object of the type), and the
    least and most values of the property among them. props: typed_properties(); classes: s1, s2, c, and entities where
    a row stands for so many entities that are alike."""
    many = F.sum("entities") if "entities" in classes.columns else F.count("*")
    total = F.sum("cnt").over(W.partitionBy(*KEY, "p"))
    dealt = props.select(*KEY, "p", "ot", "cnt").repartition(*KEY).withColumn("total", total)
    return dealt.join(classes.drop("k"), KEY).groupBy("c", "p", "ot").agg(
        many.alias("support"), F.min("total").alias("least"), F.max("total").alias("most")
    )


def class_sizes(known: DataFrame) -> DataFrame:
    """c, n: type triples of each class, repeats included."""
    return known.groupBy("c").agg(F.sum("k").alias("n"))


def max_one_of(table: DataFrame, strict: bool = False) -> DataFrame:
    """p, c of a shape_table() where some entity of the class has at most one value; strict: where all have."""
    k = F.max("most") if strict else F.min("least")
    return table.groupBy("p", "c").agg(k.alias("k")).where("k <= 1").select("p", "c")


def mixed_literal(support: DataFrame) -> DataFrame:
    """Rows of a support table where a property with any literal value in a class counts its literals only."""
    literal = F.col("ot").startswith("<")
    any_literal = support.groupBy("c", "p").agg(F.bool_or(literal).alias("_lit"))
    return support.join(any_literal, ["c", "p"]).where(~F.col("_lit") | literal).drop("_lit")


def types(triples: DataFrame, type_predicate: str = TYPE) -> DataFrame:
    """s, c: the classes of each entity, once each."""
    return triples.where(F.col("p") == type_predicate).select("s", F.col("o").alias("c")).distinct()


def class_count(triples: DataFrame, type_predicate: str = TYPE) -> DataFrame:
    """c, n: type triples of each class, repeats included."""
    found = triples.where(F.col("p") == type_predicate)
    return found.groupBy(F.col("o").alias("c")).agg(F.count("*").alias("n"))


def class_count_distinct(triples: DataFrame, type_predicate: str = TYPE) -> DataFrame:
    return types(triples, type_predicate).groupBy("c").agg(F.count("*").alias("n"))


def with_confidence(support: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds n and confidence = support / n."""
    return support.join(counts, "c").withColumn("confidence", F.col("support").cast("double") / F.col("n"))


def min_count_one(stats: DataFrame) -> DataFrame:
    """c, p where a type is had by as many entities as the class counts, or the one type is undefined."""
    found = stats.groupBy("c", "p").agg(
        F.bool_or(F.col("support") == F.col("n")).alias("full"), F.count("*").alias("k"), F.min("ot").alias("ot")
    )
    return found.where(F.col("full") | ((F.col("k") == 1) & (F.col("ot") == UNDEFINED))).select("c", "p")


def profile_table(triples: DataFrame, type_predicate: str = TYPE, untyped: str | None = UNDEFINED) -> DataFrame:
    """Stored: shape_table() of a graph with n and confidence."""
    known = stored(hashed_types(triples.where(F.col("p") == type_predicate)), "types")
    others = triples.where((F.col("o_kind") != "literal") & (F.col("p") != type_predicate)).select(*term_hash(F.col("s"), *KEY), "p", "o")
    links = others.withColumn("k", F.lit(1).cast("long")).unionByName(type_links(known, type_predicate))
    props = typed_properties(triples.where("o_kind = 'literal'"), links, known, untyped)
    return stored(with_confidence(shape_table(props, known), class_sizes(known)), "shape-table")


def class_properties(table: DataFrame) -> DataFrame:
    return table.select("c", "p").distinct()


def class_prop_types(table: DataFrame) -> DataFrame:
    """c, p, ots: the sorted object types of a property in a class; may be empty."""
    return table.groupBy("c", "p").agg(F.array_sort(F.collect_set("ot")).alias("ots"))


def recount(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Support of the given (c, p, ot); 0 where there is none."""
    found = table.select("c", "p", "ot", "support")
    return keys.join(found, ["c", "p", "ot"], "left").withColumn("support", F.coalesce("support", F.lit(0)))


def strict_cardinality(triples: DataFrame) -> DataFrame:
    """s1, s2, p, cnt: each triple once."""
    return triples.groupBy(*term_hash(F.col("s"), *KEY), "p").agg(F.count("*").alias("cnt"))


def strict_max_one(triples: DataFrame, known: DataFrame) -> DataFrame:
    """p, c where all entities of the class that have the property have one value."""
    found = strict_cardinality(triples).join(known.select(*KEY, "c"), KEY).groupBy("p", "c").agg(F.max("cnt").alias("k"))
    return found.where("k <= 1").select("p", "c")


def class_totals(counts: DataFrame) -> DataFrame:
    """One row: classes, and type triples in all."""
    return counts.agg(F.count("*").alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def predicate_frequency(triples: DataFrame, type_predicate: str = TYPE) -> DataFrame:
    return triples.where(F.col("p") != type_predicate).groupBy("p").agg(F.count("*").alias("n"))


def predicate_frequency_by_class(triples: DataFrame, classes: DataFrame, type_predicate: str = TYPE) -> DataFrame:
    """p, n: triples, each as often as its subject has classes."""
    k = classes.groupBy("s").agg(F.count("*").alias("k"))
    found = triples.where(F.col("p") != type_predicate).join(k, "s")
    return found.groupBy("p").agg(F.sum("k").alias("n"))


def type_set_members(classes: DataFrame) -> DataFrame:
    """s, type_set: each entity with its set of classes, joined by blanks; a group's members, however many."""
    return classes.groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("c")), " ").alias("type_set"))


def type_set_groups(classes: DataFrame) -> DataFrame:
    """type_set (classes joined by blanks), n: entities by their set of classes."""
    sets = type_set_members(classes)
    return sets.groupBy("type_set").agg(F.count("*").alias("n"))


