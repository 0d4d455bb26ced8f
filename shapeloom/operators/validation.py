"""Validation of data against shapes.

shapes: one row for each property of a node shape, with columns shape (name of the property's shape), target_class, path and any of
min_count, max_count, datatype, node_kind, class, sh_in (array of texts, or of value, kind and datatype), or_list (array of
node_kind, datatype, class), less_than, min_inclusive, max_inclusive, node (name of a node shape that values must meet), node_shape (the
name of the shape's own node shape). closed: node_shape, target_class, allowed (array).
Violations: source_shape, focus_node, result_path, value, component, message.

Only triples of the shapes' paths are read. Each focus node's shapes meet its values in one join, and all constraints on values are tested
in one pass over it; a constraint that no shape has costs nothing. Values with a datatype that is not well formed violate it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TYPE
from ..functions.terms import XSD
from ..storage import drop, small, stored

#: What a shape may say, with its type.
FIELDS = {
    "shape": "string", "node_shape": "string", "target_class": "string", "path": "string", "min_count": "int", "max_count": "int",
    "datatype": "string", "node_kind": "string", "class": "string", "sh_in": "array<struct<value:string,kind:string,datatype:string>>",
    "or_list": "array<struct<node_kind:string,datatype:string,class:string>>", "less_than": "string",
    "min_inclusive": "double", "max_inclusive": "double", "node": "string",
}
#: Fixed: whole numbers, with their least and greatest value, and the other numbers.
_WHOLE = {
    "integer": (None, None), "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1),
    "byte": (-128, 127), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0),
    "negativeInteger": (None, -1), "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1),
    "unsignedByte": (0, 255),
}
_NUMBERS = [f"<{XSD}{x}>" for x in (*_WHOLE, "decimal", "double", "float")]
_TIMES = [f"<{XSD}{x}>" for x in ("date", "dateTime")]
_ZONE = r"(?:Z|[+-]\d\d:\d\d)?"
#: How literals of other datatypes are written.
_FORMS = {
    "decimal": r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)$", "boolean": "^(?:true|false|0|1)$", "date": rf"^-?\d{{4,}}-\d\d-\d\d{_ZONE}$",
    "double": r"^(?:[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|[+-]?INF|NaN)$",
    "dateTime": rf"^-?\d{{4,}}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?{_ZONE}$",
}


def complete(shapes: DataFrame) -> DataFrame:
    """shapes with all FIELDS, null where it lacks them."""
    types = dict(shapes.dtypes)

    def field(c: str, kind: str) -> Column:
        if c == "sh_in" and types.get(c) == "array<string>":
            return F.transform(c, lambda x: F.struct(x.alias("value"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("datatype")))
        return F.col(c) if c in types else F.lit(None)

    return shapes.select(*[field(c, t).cast(t).alias(c) for c, t in FIELDS.items()])


def well_formed(value: Column, datatype: Column) -> Column:
    """Whether a literal's text is one of its datatype; datatypes that are not known here have no rules."""
    out = None
    for name, (low, high) in _WHOLE.items():
        number = value.try_cast("decimal(38,0)")
        good = value.rlike(r"^[+-]?\d+$")
        for bound, test in ((low, number.__ge__), (high, number.__le__)):
            if bound is not None:
                good = good & F.coalesce(test(F.lit(str(bound)).cast("decimal(38,0)")), F.lit(False))
        test = datatype == f"<{XSD}{name}>"
        out = F.when(test, good) if out is None else out.when(test, good)
    for name, form in (*_FORMS.items(), ("float", _FORMS["double"])):
        out = out.when(datatype == f"<{XSD}{name}>", value.rlike(form))
    return out.otherwise(True)


def _has_kind(kind: Column, of: Column) -> Column:
    return F.when(kind == "Literal", of == "literal").when(kind == "IRI", of == "iri").otherwise(of == "bnode")


def _false(test: Column) -> Column:
    return ~F.coalesce(test, F.lit(False))


def _less(a: Column, b: Column, kind_a: Column, kind_b: Column) -> Column:
    """Numbers by size, dates and times by time, other literals of one datatype as text; null where they do not compare."""
    numbers = kind_a.isin(_NUMBERS) & kind_b.isin(_NUMBERS)
    times = kind_a.isin(_TIMES) & kind_b.isin(_TIMES)
    return (
        F.when(numbers, a.try_cast("double") < b.try_cast("double"))
        .when(times, a.try_cast("timestamp") < b.try_cast("timestamp"))
        .when(kind_a == kind_b, a < b)
    )


def _wants(shapes: DataFrame, *columns: str) -> bool:
    """Whether some shape says one of these. Shapes are as many as the schema has."""
    row = shapes.agg(*[F.count(c).alias(c) for c in columns]).first()
    return any(row)


def _values(triples: DataFrame, shapes: DataFrame) -> DataFrame:
    """Distinct triples of the shapes' paths."""
    paths = shapes.select(F.col("path").alias("p")).union(shapes.select("less_than")).dropna().distinct()
    mine = triples.join(small(paths), "p", "left_semi")
    return mine.select(F.col("s").alias("_s"), F.col("p").alias("_p"), "o", "o_kind", "o_datatype", "o_lang").distinct()


def _targets(rules: DataFrame, triples: DataFrame, type_predicate: str) -> DataFrame:
    """s, target_class: the instances of the classes that rules target, once each. Other type triples are left out before the shuffle."""
    wanted = small(stored(rules.select(F.col("target_class").alias("o")).dropna().distinct(), "targets"))
    mine = triples.where(F.col("p") == type_predicate).join(wanted, "o", "left_semi")
    return mine.select("s", F.col("o").alias("target_class")).distinct()


def _asked_classes(shapes: DataFrame, classes: DataFrame) -> DataFrame:
    """Of classes (s, c), those with a c that some shape asks its values for."""
    members = shapes.select(F.explode("or_list").alias("m")).select("m.class")
    asked = shapes.select("class").union(members).dropna().distinct()
    return classes.join(small(stored(asked.withColumnRenamed("class", "c"), "asked-classes")), "c", "left_semi")


def _check(focus: DataFrame, shapes: DataFrame, triples: DataFrame, classes: DataFrame) -> DataFrame:
    """Violations of everything but closed and node. focus: shapes' FIELDS by focus node s."""
    values, parts = _values(triples, shapes), []
    here = (F.col("s") == F.col("_s")) & (F.col("path") == F.col("_p"))
    none = F.lit(None).cast("string")

    def report(component: Column, value: Column, message: Column) -> list[Column]:
        return [
            F.col("shape").alias("source_shape"), F.col("s").alias("focus_node"), F.col("path").alias("result_path"),
            value.alias("value"), component.alias("component"), message.alias("message"),
        ]

    if _wants(shapes, "min_count", "max_count"):
        n = values.groupBy("_s", "_p").agg(F.count("*").alias("_n"))
        mine = focus.where("min_count IS NOT NULL OR max_count IS NOT NULL").join(n, here, "left")
        k = F.coalesce("_n", F.lit(0))
        few = F.when(k < F.col("min_count"), F.struct(F.lit("minCount").alias("c"), F.concat(F.lit("fewer values than "), F.col("min_count").cast("string")).alias("m")))
        many = F.when(k > F.col("max_count"), F.struct(F.lit("maxCount").alias("c"), F.concat(F.lit("more values than "), F.col("max_count").cast("string")).alias("m")))
        found = mine.select("shape", "s", "path", F.explode(F.array_compact(F.array(few, many))).alias("x"))
        parts.append(found.select(*report(F.col("x.c"), none, F.col("x.m"))))
    o, kind, datatype = F.col("o"), F.col("o_kind"), F.col("o_datatype")
    bad: list[Column] = []

    def test(column: str, component: str, wrong: Column, message: Column) -> None:
        if _wants(shapes, column):
            bad.append(F.when(F.col(column).isNotNull() & wrong, F.struct(F.lit(component).alias("c"), message.alias("m"))))

    typed = _wants(shapes, "class", "or_list")
    own = F.col("_classes")
    test("datatype", "datatype", _false(datatype == F.col("datatype")) | ~well_formed(o, datatype), F.concat(F.lit("not of datatype "), "datatype"))
    test("node_kind", "nodeKind", ~_has_kind(F.col("node_kind"), kind), F.concat(F.lit("not of kind "), "node_kind"))
    test("sh_in", "in", ~F.exists("sh_in", lambda m: (m["value"] == o) & (m["kind"].isNull() | ((m["kind"] == kind) & m["datatype"].eqNullSafe(datatype)))), F.lit("not in the list"))
    number = F.when(datatype.isin(_NUMBERS), o.try_cast("double"))
    test("min_inclusive", "minInclusive", _false(number >= F.col("min_inclusive")), F.lit("too small"))
    test("max_inclusive", "maxInclusive", _false(number <= F.col("max_inclusive")), F.lit("too large"))
    test("class", "class", _false(F.array_contains(own, F.col("class"))), F.concat(F.lit("not an instance of "), F.col("class")))

    def member(m: Column) -> Column:
        return (
            (m["node_kind"].isNull() | _has_kind(m["node_kind"], kind))
            & (m["datatype"].isNull() | F.coalesce((m["datatype"] == datatype) & well_formed(o, datatype), F.lit(False)))
            & (m["class"].isNull() | F.coalesce(F.array_contains(own, m["class"]), F.lit(False)))
        )

    test("or_list", "or", ~F.exists("or_list", member), F.lit("meets none of the alternatives"))
    if bad:
        met = focus.join(values, here)
        if typed:
            of_value = _asked_classes(shapes, classes).groupBy(F.col("s").alias("_k")).agg(F.collect_set("c").alias("_classes"))
            met = met.join(of_value, (o == F.col("_k")) & (kind != "literal"), "left")
        found = met.select("shape", "s", "path", "o", F.explode(F.array_compact(F.array(*bad))).alias("x"))
        parts.append(found.select(*report(F.col("x.c"), o, F.col("x.m"))))
    if _wants(shapes, "less_than"):
        other = values.select(F.col("_s").alias("_s2"), F.col("_p").alias("_p2"), F.col("o").alias("o2"), F.col("o_datatype").alias("dt2"))
        pairs = focus.where("less_than IS NOT NULL").join(values, here).join(other, (F.col("s") == F.col("_s2")) & (F.col("less_than") == F.col("_p2")))
        wrong = pairs.where(_false(_less(o, F.col("o2"), datatype, F.col("dt2"))))
        parts.append(wrong.select(*report(F.lit("lessThan"), o, F.concat(F.lit("not less than "), "o2"))))
    if not parts:
        parts.append(focus.where(F.lit(False)).select(*report(none, none, none)))
    return reduce(DataFrame.unionByName, parts)


def _closed(focus: DataFrame, triples: DataFrame, type_predicate: str) -> DataFrame:
    """focus: shape, allowed by focus node s. Only triples of focus nodes are made distinct; few nodes are broadcast."""
    nodes = small(stored(focus.select("s").distinct(), "closed-nodes"))
    mine = triples.where(F.col("p") != type_predicate).select("s", F.col("p").alias("path"), "o").join(nodes, "s", "left_semi")
    found = focus.join(mine.distinct(), "s")
    wrong = found.where(~F.array_contains("allowed", F.col("path")))
    return wrong.select(
        F.col("shape").alias("source_shape"), F.col("s").alias("focus_node"), F.col("path").alias("result_path"),
        F.col("o").alias("value"), F.lit("closed").alias("component"), F.lit("a property that is not allowed").alias("message"),
    )


def closed_violations(closed: DataFrame, triples: DataFrame, classes: DataFrame, type_predicate: str = TYPE) -> DataFrame:
    wanted = F.broadcast(closed.select(F.col("target_class").alias("c")).distinct())
    mine = classes.join(wanted, "c", "left_semi").distinct().withColumnRenamed("c", "target_class")
    focus = closed.join(mine, "target_class").withColumnRenamed("node_shape", "shape")
    return _closed(focus, triples, type_predicate)


def _nested(focus: DataFrame, triples: DataFrame, shapes: DataFrame) -> DataFrame:
    """shape, s, path, value, node: the values that node shapes are asked of."""
    mine = focus.where("node IS NOT NULL").select("shape", "s", "path", "node")
    values = _values(triples, shapes).select("_s", "_p", F.col("o").alias("value")).distinct()
    return mine.join(values, (F.col("s") == F.col("_s")) & (F.col("path") == F.col("_p"))).drop("_s", "_p")


def node_violations(
    shapes: DataFrame, triples: DataFrame, type_predicate: str = TYPE, closed: DataFrame | None = None, depth: int = 32
) -> DataFrame:
    """Values of target classes that do not meet the node shape that node names, with all its constraints, closed and nested ones
    included.

    First all pairs (value, node shape) that are asked for, directly or through others, are found; then those that fail by
    themselves; then those that fail as a value of theirs does, until none is left. Shapes may refer to each other in circles. More than
    depth steps either way are an error.
    """
    from .profile import types

    classes = types(triples, type_predicate)
    rules = stored(complete(shapes), "rules")
    top = stored(_nested(rules.join(_targets(rules, triples, type_predicate), "target_class"), triples, rules), "node-top")
    inner = rules.drop("target_class").distinct().withColumnRenamed("node_shape", "_node")
    asked = stored(top.select(F.col("value").alias("s"), F.col("node").alias("_node")).distinct(), "node-asked")
    links, n = None, asked.count()
    for _ in range(depth):
        links = stored(_nested(inner.join(asked, "_node"), triples, rules).join(inner.select("shape", "_node"), "shape"), "node-links")
        more = asked.union(links.select(F.col("value").alias("s"), F.col("node").alias("_node"))).distinct()
        before, asked = asked, stored(more, "node-asked")
        drop(before)
        if (now := asked.count()) == n:
            break
        n = now
    else:
        raise ValueError(f"node shapes are nested more than {depth} deep")
    focus = inner.join(asked, "_node")
    found = _check(focus, rules, triples, classes).select("source_shape", F.col("focus_node").alias("s"))
    fails = found.join(inner.select(F.col("shape").alias("source_shape"), "_node"), "source_shape").select("s", "_node")
    if closed is not None:
        ask = closed.select(F.col("node_shape").alias("_node"), "allowed").distinct().join(asked, "_node").withColumn("shape", F.col("_node"))
        fails = fails.union(_closed(ask, triples, type_predicate).select(F.col("focus_node").alias("s"), F.col("source_shape").alias("_node")))
    fails = stored(fails.distinct(), "node-fails")
    n = fails.count()
    for _ in range(depth):
        via = links.join(fails.select(F.col("s").alias("value"), F.col("_node").alias("node")), ["value", "node"], "left_semi")
        before, fails = fails, stored(fails.union(via.select("s", "_node")).distinct(), "node-fails")
        drop(before)
        if (now := fails.count()) == n:
            break
        n = now
    else:
        raise ValueError(f"node shapes are nested more than {depth} deep")
    wrong = top.join(fails.select(F.col("s").alias("value"), F.col("_node").alias("node")), ["value", "node"], "left_semi")
    return wrong.select(
        F.col("shape").alias("source_shape"), F.col("s").alias("focus_node"), F.col("path").alias("result_path"), "value",
        F.lit("node").alias("component"), F.concat(F.lit("not a "), "node").alias("message"),
    )


def violations(shapes: DataFrame, triples: DataFrame, type_predicate: str = TYPE, closed: DataFrame | None = None) -> DataFrame:
    """All violations of all shapes, but those of not."""
    from .profile import types

    classes = types(triples, type_predicate)
    rules = stored(complete(shapes), "rules")
    focus = rules.where("target_class IS NOT NULL").join(_targets(rules, triples, type_predicate), "target_class")
    out = _check(focus, rules.where("target_class IS NOT NULL"), triples, classes)
    if closed is not None:
        out = out.unionByName(closed_violations(closed, triples, classes, type_predicate))
    if _wants(rules, "node"):
        out = out.unionByName(node_violations(rules, triples, type_predicate, closed))
    return out


def not_violations(negative: DataFrame, triples: DataFrame, type_predicate: str = TYPE) -> DataFrame:
    """Focus nodes that have a value of a type that a negative shape forbids. negative: shape, target_class, path, ot, support, confidence."""
    from ..functions.terms import UNDEFINED
    from .profile import types

    classes = types(triples, type_predicate)
    mine = triples.join(small(negative.select(F.col("path").alias("p")).distinct()), "p", "left_semi")
    of_object = classes.select(F.col("s").alias("_o"), F.col("c").alias("_c"))
    literal = F.col("o_kind") == "literal"
    had = mine.join(of_object, (F.col("o") == F.col("_o")) & ~literal, "left")
    had = had.select("s", F.col("p").alias("path"), F.when(literal, F.col("o_datatype")).otherwise(F.coalesce("_c", F.lit(UNDEFINED))).alias("ot"))
    negative = stored(negative, "negative")
    had = had.join(small(stored(negative.select("path", "ot").distinct(), "forbidden")), ["path", "ot"], "left_semi").select("s", "path", "ot")
    found = negative.join(_targets(negative, triples, type_predicate), "target_class").join(had.distinct(), ["s", "path", "ot"])
    return found.select(
        F.col("shape").alias("source_shape"), F.col("s").alias("focus_node"), F.col("path").alias("result_path"),
        F.lit("not").alias("component"), F.col("path").alias("property"), "support", "confidence", F.col("target_class").alias("class"),
    )
