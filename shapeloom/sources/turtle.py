"""Turtle: a reader, one file to a task, and a writer of shapes with a fixed order, whose texts are made by column functions."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import TYPE
from ..functions.terms import XSD, escape

SH = "http://www.w3.org/ns/shacl#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
SCHEMA = "s string, p string, o string, o_kind string, o_datatype string, o_lang string"
_TOKEN = re.compile(
    r"""\s*(?:\#[^\n]*\n\s*)*(?:(?P<iri><[^>]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3})|(?P<str>"(?:[^"\\\n]|\\.)*")
    |(?P<lang>@[A-Za-z0-9-]+)|(?P<dt>\^\^)|(?P<num>[+-]?(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>(?:_:)?[A-Za-z_][\w.-]*?(?::[\w%.-]*\w)?(?=[\s;,.()\[\]]|$)|[\w-]*:[\w%-]*)|(?P<mark>[;,.()\[\]]))""",
    re.X,
)


def _plain(m: re.Match) -> str:
    if m[3]:
        return {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(m[3], m[3])
    return chr(int(m[1] or m[2], 16))


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip() + "\n"
        while at < len(text) and text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                rest = re.sub(r"(?m)#.*$", "", text[at:]).strip()
                if not rest:
                    break
                raise ValueError(f"cannot read: {text[at : at + 40]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.i, self.prefixes, self.triples, self.fresh = 0, {}, [], count()

    def peek(self):
        return self.tokens[self.i] if self.i < len(self.tokens) else (None, None)

    def take(self, value=None):
        kind, got = self.peek()
        if value is not None and got != value:
            raise ValueError(f"expected {value}, found {got}")
        self.i += 1
        return kind, got

    def bnode(self) -> str:
        return f"_:b{next(self.fresh)}"

    def term(self):
        """(value, kind, datatype, lang)"""
        kind, x = self.take()
        if kind == "iri":
            return x[1:-1], "iri", None, None
        if kind == "num":
            plain = "integer" if re.fullmatch(r"[+-]?\d+", x) else "double" if "e" in x.lower() else "decimal"
            return x, "literal", f"<{XSD}{plain}>", None
        if kind in ("str", "long"):
            text = x[3:-3] if kind == "long" else x[1:-1]
            text = re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", _plain, text, flags=re.S)
            if self.peek()[0] == "lang":
                return text, "literal", f"<{RDF}langString>", self.take()[1][1:]
            if self.peek()[0] == "dt":
                self.take()
                return text, "literal", f"<{self.term()[0]}>", None
            return text, "literal", f"<{XSD}string>", None
        if x == "[":
            node = self.bnode()
            self.about(node)
            self.take("]")
            return node, "bnode", None, None
        if x == "(":
            members = []
            while self.peek()[1] != ")":
                members.append(self.term())
            self.take(")")
            nodes = [self.bnode() for _ in members]
            for k, m in enumerate(members):
                self.triples.append((nodes[k], f"{RDF}first", *m))
                rest = (nodes[k + 1], "bnode") if k + 1 < len(nodes) else (f"{RDF}nil", "iri")
                self.triples.append((nodes[k], f"{RDF}rest", *rest, None, None))
            return (nodes[0], "bnode", None, None) if nodes else (f"{RDF}nil", "iri", None, None)
        if x == "a":
            return TYPE, "iri", None, None
        if x in ("true", "false"):
            return x, "literal", f"<{XSD}boolean>", None
        if x.startswith("_:"):
            return x, "bnode", None, None
        prefix, _, name = x.partition(":")
        return self.prefixes[prefix] + name, "iri", None, None

    def about(self, subject: str) -> None:
        while self.peek()[1] not in (".", "]", None):
            if self.peek()[1] == ";":
                self.take()
                continue
            p = self.term()[0]
            while True:
                self.triples.append((subject, p, *self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()

    def read(self) -> list[tuple]:
        while self.i < len(self.tokens):
            kind, x = self.peek()
            if kind == "lang" and x in ("@prefix", "@base"):
                self.take()
                name = self.take()[1]
                self.prefixes[name.rstrip(":")] = self.take()[1][1:-1]
            else:
                subject = self.term()[0]
                self.about(subject)
            self.take(".")
        return self.triples


def parse(text: str) -> list[tuple]:
    """(s, p, o, o_kind, o_datatype, o_lang) of each triple."""
    return _Reader(text).read()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files. A file is parsed as a whole, in some task; blank nodes of different files differ."""

    def run(batches):
        for b in batches:
            for text in b.column("value").to_pylist():
                own = f"_:f{hashlib.md5(text.encode()).hexdigest()[:16]}"
                rows = [tuple(own + x[2:] if x and x.startswith("_:") and i in (0, 2) and (i == 0 or t[3] == "bnode") else x for i, x in enumerate(t)) for t in parse(text)]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["s", "p", "o", "o_kind", "o_datatype", "o_lang"])

    return spark.read.text(path, wholetext=True).mapInArrow(run, SCHEMA)


def shapes_of(spark: SparkSession, graph: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """The shapes of parsed Turtle as tables for validation: shapes (with node_shape) and closed."""
    by: dict = defaultdict(lambda: defaultdict(list))
    for s, p, o, *rest in graph:
        by[s][p].append((o, *rest))

    def one(node, name):
        found = by[node].get(SH + name)
        return found[0][0] if found else None

    def items(head):
        while head and head != f"{RDF}nil":
            yield by[head][f"{RDF}first"][0]
            head = by[head][f"{RDF}rest"][0][0]

    def terms(head):
        out = []
        while head and head != f"{RDF}nil":
            out.append(by[head][f"{RDF}first"][0][:3])
            head = by[head][f"{RDF}rest"][0][0]
        return out

    def bracket(x):
        return f"<{x}>" if x else None

    def kind(node):
        x = one(node, "nodeKind") or one(node, "NodeKind")
        return x.rpartition("#")[2] if x else None

    shapes, closed = [], []
    for node in [s for s, ps in list(by.items()) if (f"{SH}NodeShape", "iri", None, None) in ps.get(TYPE, [])]:
        targets = [t[0] for t in by[node].get(f"{SH}targetClass", [])] or [None]
        props = [x[0] for x in by[node].get(f"{SH}property", [])]
        for target in targets:
            for x in props:
                number = lambda n: float(one(x, n)) if one(x, n) is not None else None
                whole = lambda n: int(one(x, n)) if one(x, n) is not None else None
                alternatives = [
                    (kind(m[0]), bracket(one(m[0], "datatype")), one(m[0], "class")) for m in items(one(x, "or"))
                ]
                shapes.append((
                    x, node, target, one(x, "path"), whole("minCount"), whole("maxCount"), bracket(one(x, "datatype")), kind(x),
                    one(x, "class"), terms(one(x, "in")) or None, alternatives or None, one(x, "lessThan"),
                    number("minInclusive"), number("maxInclusive"), one(x, "node"),
                ))
            if one(node, "closed") == "true":
                allowed = [one(x, "path") for x in props] + [m[0] for m in items(one(node, "ignoredProperties"))]
                closed.append((node, target, allowed))
    kinds = (
        "shape string, node_shape string, target_class string, path string, min_count int, max_count int, datatype string, "
        "node_kind string, class string, sh_in array<struct<value:string,kind:string,datatype:string>>, or_list array<struct<node_kind:string,datatype:string,class:string>>, "
        "less_than string, min_inclusive double, max_inclusive double, node string"
    )
    return spark.createDataFrame(shapes, kinds), spark.createDataFrame(closed, "node_shape string, target_class string, allowed array<string>")


def blocks(nodes: DataFrame, shapes: DataFrame, keys: list[str] | None = None, annotate: bool = True) -> DataFrame:
    """name, block (and keys): the Turtle text of each shape, made by column functions; equal names of node shapes are one subject."""
    keys = keys or []

    def iri(x: Column) -> Column:
        return F.concat(F.lit("<"), x, F.lit(">"))

    def says(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name} "), value)  # null where the value is

    def notes(support: Column, confidence: Column) -> list[Column]:
        if not annotate:
            return []
        return [
            says("<http://shaclshapes.org/support>", support.cast("string")),
            says("<http://shaclshapes.org/confidence>", F.when(support.isNotNull() & confidence.isNotNull(), F.format_string("%e", confidence))),
        ]

    def constraint(kind: Column, datatype: Column, cls: Column) -> list[Column]:
        return [says("sh:nodeKind", F.concat(F.lit("sh:"), kind)), says("sh:datatype", datatype), says("sh:class", iri(cls))]

    def member(m: Column) -> Column:
        parts = [*constraint(m["node_kind"], m["datatype"], m["class"]), *notes(m["support"], m["confidence"])]
        return F.concat(F.lit("[ "), F.concat_ws(" ; ", *parts), F.lit(" ]"))

    def listed(items: Column) -> Column:
        return F.concat(F.lit("( "), F.array_join(items, " "), F.lit(" )"))

    def block(name: Column, lines: list[Column]) -> Column:
        return F.concat(iri(name), F.lit("\n    "), F.concat_ws(" ;\n    ", *lines), F.lit(" ."))

    c = F.col
    optional = [says("sh:node", iri(c("node")))] if "node" in shapes.columns else []
    if "examples" in shapes.columns:
        quoted = F.array_join(F.transform("examples", lambda x: F.concat(F.lit('"'), escape(x), F.lit('"'))), ", ")
        optional.append(says("<http://shaclshapes.org/example>", F.when(F.size("examples") > 0, quoted)))
    positive, members = c("polarity") == "positive", says("sh:or", listed(F.transform("or_list", member)))
    kinds = constraint(c("node_kind"), c("datatype"), c("class"))
    refused = F.concat(F.lit("[ "), F.concat_ws(" ; ", *kinds, members), F.lit(" ]"))
    lines = [
        F.lit("a sh:PropertyShape"), says("sh:path", iri(c("path"))), says("sh:in", listed(F.transform("sh_in", iri))),
        *[F.when(positive, x) for x in kinds],
        says("sh:minCount", c("min_count").cast("string")), says("sh:maxCount", c("max_count").cast("string")),
        F.when(positive, members), says("sh:not", F.when(~positive, refused)), *optional, *notes(c("support"), c("confidence")),
    ]
    of_shapes = shapes.select(*keys, "name", block(c("name"), lines).alias("block"))
    mine = shapes.groupBy(*keys, "c").agg(F.array_sort(F.collect_list("name")).alias("_names"))
    same = [F.col(f"n.{k}") == F.col(f"m.{k}") for k in keys]
    joined = nodes.alias("n").join(mine.alias("m"), [*same, F.col("n.target_class") == F.col("m.c")], "left")
    total = joined.groupBy(*[f"n.{k}" for k in keys], "n.name").agg(
        F.array_sort(F.collect_set("n.target_class")).alias("targets"),
        F.array_sort(F.flatten(F.collect_list("_names"))).alias("names"),
        (F.sum("n.support") if "support" in nodes.columns and annotate else F.lit(None).cast("long")).alias("support"),
    )
    lines = [
        F.lit("a sh:NodeShape"), says("sh:targetClass", F.array_join(F.transform("targets", iri), ", ")),
        says("sh:property", F.when(F.size("names") > 0, F.array_join(F.transform("names", iri), ", "))),
        says("<http://shaclshapes.org/support>", c("support").cast("string")),
    ]
    return of_shapes.unionByName(total.select(*keys, "name", block(c("name"), lines).alias("block")))


HEAD = f"@prefix sh: <{SH}> .\n@prefix xsd: <{XSD}> .\n"


def write_file(found: DataFrame, path: str) -> None:
    """The blocks of one set of shapes as text, sorted by name over all part files; the first line of each file is its prefixes."""
    ordered = found.select("name", "block").repartitionByRange("name").sortWithinPartitions("name")
    first = F.row_number().over(W.partitionBy(F.spark_partition_id()).orderBy("name")) == 1
    text = F.when(first, F.concat(F.lit(HEAD), F.lit("\n"), F.col("block"))).otherwise(F.col("block"))
    ordered.select(F.concat(text, F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def text_of(found: DataFrame) -> str:
    """The same as one text, for a set of shapes that is known to be small."""
    return "\n\n".join([HEAD.rstrip("\n"), *[r["block"] for r in found.orderBy("name").select("block").toLocalIterator()]]) + "\n"
