"""Queries of graph patterns over triples, in a part of SPARQL: SELECT, ASK and CONSTRUCT with triple patterns, FILTER, OPTIONAL, VALUES,
COUNT, GROUP BY, ORDER BY and LIMIT. A template may hold names such as :Class that bind() replaces.

Each pattern is a filtered scan; patterns are joined on the variables that they share, so Catalyst orders and prunes them as it does
any join. A pattern that shares no variable with those before it is refused, as is all other syntax. A variable is a column of structs
v (text), k (iri, bnode, literal), d (datatype), l (language); one that nothing else names is not made.

The graph is a DataFrame of triples or one that makes them as asked (sources.triples.Tables): scan() gets the terms of a pattern, spaces()
are parts without a common subject, in each of which patterns about one subject are matched apart, and states() tells the rows that state a
fact of their subject. Where repeated solutions make no difference (DISTINCT, COUNT(DISTINCT), ASK, CONSTRUCT), a fact about a variable
(?s a :Class) that another pattern has as its subject takes part as a semi-join with the latter, and in none where its row states the fact.
Distinct values are counted by 128 bits of hash. Distinct subjects by object of one predicate are counted by masks of the objects that a row
of a table states (_by_sets).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import TYPE
from ..functions.terms import term_hash
from ..storage import stored

_TOKEN = re.compile(
    r"""\s*(?:(?P<iri><[^>\s]*>)|(?P<var>\?\w+)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<num>-?\d+(?:\.\d+)?)|(?P<op>&&|!=|<=|>=|[{}().=<>;,*])|(?P<name>[A-Za-z_][\w-]*:[\w.-]*\w|[A-Za-z_]\w*:?|:\w+))"""
)
KIND = "struct<v:string,k:string,d:string,l:string>"
#: The most words of masks of objects, and the most sets of objects, that distinct subjects are counted by.
WORDS, SETS = 4, 100_000


@dataclass
class Query:
    form: str
    select: list = field(default_factory=list)  # (variable, None) or (name, (variable, distinct))
    distinct: bool = False
    template: list = field(default_factory=list)
    where: list = field(default_factory=list)
    filters: list = field(default_factory=list)
    optional: list = field(default_factory=list)
    values: dict = field(default_factory=dict)
    group: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None


def bind(template: str, **names: str) -> str:
    """The template with each :Name replaced by the IRI given for it."""
    return re.sub(r"(?<![\w<]):(\w+)", lambda m: f"<{names[m[1]]}>" if m[1] in names else m[0], template)


class _Parser:
    def __init__(self, text: str):
        self.tokens, at, text = [], 0, re.sub(r"(?m)^\s*#.*$", "", text).strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read: {text[at : at + 40]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
            while at < len(text) and text[at].isspace():
                at += 1
        self.i, self.prefixes = 0, {}

    def peek(self) -> str:
        return self.tokens[self.i][1] if self.i < len(self.tokens) else ""

    def word(self, *words: str) -> bool:
        if self.peek().upper() in words:
            self.i += 1
            return True
        return False

    def take(self, value: str | None = None) -> str:
        if value is not None and self.peek().upper() != value:
            raise ValueError(f"expected {value}, found {self.peek()!r}")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def term(self):
        """("var", name) or ("term", kind, text)"""
        kind, x = self.tokens[self.i]
        self.i += 1
        if kind == "var":
            return ("var", x[1:])
        if kind == "iri":
            return ("term", "iri", x[1:-1])
        if kind == "str":
            return ("term", "literal", re.sub(r"\\(.)", r"\1", x[1:-1]))
        if kind == "num":
            return ("term", "literal", x)
        if x == "a":
            return ("term", "iri", TYPE)
        prefix, _, name = x.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"unknown name: {x}")
        return ("term", "iri", self.prefixes[prefix] + name)

    def triples(self) -> list[tuple]:
        out, s = [], self.term()
        while True:
            p = self.term()
            while True:
                out.append((s, p, self.term()))
                if not self.word(","):
                    break
            if not self.word(";"):
                return out

    def test(self):
        """One comparison: (function or None, variable, operator, value) or ("isLiteral", variable, None, None)."""
        function = None
        if self.peek().lower() in ("isliteral", "isiri", "datatype", "lang"):
            function = self.take().lower()
            self.take("(")
        kind, name = self.term()[:2]
        if kind != "var":
            raise ValueError("a filter starts with a variable")
        if function:
            self.take(")")
        if function in ("isliteral", "isiri"):
            return (function, name, None, None)
        return (function, name, self.take(), self.term())

    def group(self, q: Query, where: list, filters: list) -> None:
        self.take("{")
        while not self.word("}"):
            if self.word("FILTER"):
                self.take("(")
                filters.append(self.test())
                while self.word("&&"):
                    filters.append(self.test())
                self.take(")")
            elif self.word("OPTIONAL"):
                inner, tests = [], []
                self.group(q, inner, tests)
                q.optional.append((inner, tests))
            elif self.word("VALUES"):
                name, items = self.term()[1], []
                self.take("{")
                while not self.word("}"):
                    items.append(self.term()[2])
                q.values[name] = items
            else:
                where += self.triples()
            self.word(".")

    def query(self) -> Query:
        while self.word("PREFIX"):
            name = self.take().rstrip(":")
            self.prefixes[name] = self.take()[1:-1]
        q = Query(self.take().upper())
        if q.form == "SELECT":
            q.distinct = self.word("DISTINCT")
            while self.peek().upper() not in ("WHERE", "{"):
                if self.word("("):
                    self.take("COUNT")
                    self.take("(")
                    one = self.word("DISTINCT")
                    of = None if self.word("*") else self.term()[1]
                    self.take(")")
                    self.take("AS")
                    q.select.append((self.term()[1], (of, one)))
                    self.take(")")
                elif not self.word("*"):
                    q.select.append((self.term()[1], None))
        elif q.form == "CONSTRUCT":
            self.group(Query(""), q.template, [])
        elif q.form != "ASK":
            raise ValueError(f"unknown form: {q.form}")
        self.word("WHERE")
        self.group(q, q.where, q.filters)
        if self.word("GROUP"):
            self.take("BY")
            while self.peek().startswith("?"):
                q.group.append(self.term()[1])
        if self.word("ORDER"):
            self.take("BY")
            while self.peek().startswith("?") or self.peek().upper() in ("DESC", "ASC"):
                down = self.peek().upper() == "DESC"
                bracket = self.word("DESC", "ASC") and self.word("(")
                q.order.append((self.term()[1], down))
                if bracket:
                    self.take(")")
        if self.word("LIMIT"):
            q.limit = int(self.take())
        if self.i < len(self.tokens):
            raise ValueError(f"cannot read: {self.peek()!r}")
        return q


class _Rows:
    """A graph that is one DataFrame of triples."""

    def __init__(self, triples: DataFrame):
        self.spark, self.triples = triples.sparkSession, triples

    def scan(self, **_) -> DataFrame:
        return self.triples

    def spaces(self) -> list:
        return [self]

    def states(self, p: str, o: str) -> tuple:
        return None, self


def _graph(triples):
    return _Rows(triples) if isinstance(triples, DataFrame) else triples


def _names(patterns: list) -> list[str]:
    return [term[1] for x in patterns for term in x if term[0] == "var"]


def _used(q: Query) -> set[str]:
    """Variables that take part in joins, tests or the result."""
    every = _names(q.where) + [x for patterns, _ in q.optional for x in _names(patterns)]
    if q.form == "SELECT" and not q.select:
        return set(every)
    tests = q.filters + [x for _, tests in q.optional for x in tests]
    asked = [of[0] if of else name for name, of in q.select] + q.group + [x for x, _ in q.order] + [x[1] for x in tests]
    return {x for x in every if every.count(x) > 1} | set(asked) | set(_names(q.template)) | set(q.values)


def _once(q: Query) -> bool:
    """Whether repeated solutions make no difference."""
    counts = [of for _, of in q.select if of]
    if q.form != "SELECT":
        return True
    return all(one and of for of, one in counts) if counts or q.group else q.distinct


def _scan(graph, pattern: tuple, q: Query, used: set[str], tests: list) -> DataFrame | None:
    """A column for each used variable of one pattern, None if the graph cannot have any."""
    s, p, o = pattern
    among = [s[2]] if s[0] == "term" else q.values.get(s[1])
    without = [x[3][2] for x in tests if x[:3] == (None, p[1], "!=") and x[3][:2] == ("term", "iri")] if p[0] == "var" else []
    fields = [c for c, x in (("s", s), ("p", p), ("o", o), ("o_kind", o)) if x[0] == "term" or x[1] in used]
    fields += ["o_datatype", "o_lang"] if o[0] == "var" and o[1] in used else []
    found = graph.scan(
        among=among, p=p[2] if p[0] == "term" else None, o=o[2] if o[0] == "term" else None, without=tuple(without), fields=fields or ["p"]
    )
    if found is None:
        return None
    kind = {"s": F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri"), "p": F.lit("iri"), "o": F.col("o_kind")}
    none, columns = F.lit(None).cast("string"), {}
    for place, term in zip("spo", pattern, strict=True):
        if term[0] == "term":
            found = found.where(F.col(place) == term[2])
            if place == "o":
                found = found.where((F.col("o_kind") == "literal") == F.lit(term[1] == "literal"))
            continue
        if term[1] not in used:
            continue
        more = (F.col("o_datatype"), F.col("o_lang")) if place == "o" else (none, none)
        column = F.struct(F.col(place).alias("v"), kind[place].alias("k"), more[0].alias("d"), more[1].alias("l")).cast(KIND)
        columns.setdefault(term[1], []).append(column)
    for same in columns.values():
        found = reduce(lambda df, x: df.where(x == same[0]), same[1:], found)
    found = found.select(*[x[0].alias(name) for name, x in columns.items()])
    return reduce(lambda df, name: df.where(F.col(name)["v"].isin(q.values[name])), [x for x in found.columns if x in q.values], found)


def _test(x: tuple) -> Column:
    function, name, op, value = x
    of = F.col(name)
    if function == "isliteral":
        return of["k"] == "literal"
    if function == "isiri":
        return of["k"] == "iri"
    if value[0] == "var":
        raise ValueError("a filter compares with a term")
    text = value[2]
    left = F.translate(of["d"], "<>", "") if function == "datatype" else of["l"] if function == "lang" else of["v"]
    if op in ("=", "!="):
        same = left == text
        if function is None:
            same = same & ((of["k"] == "literal") == F.lit(value[1] == "literal"))
        return same if op == "=" else ~same
    number = left.try_cast("double")
    return {"<": number.__lt__, ">": number.__gt__, "<=": number.__le__, ">=": number.__ge__}[op](float(text))


def _join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    on = [c for c in right.columns if c in left.columns]
    if not on:
        raise ValueError("a pattern shares no variable with those before it")
    renamed = right.select(*[F.col(c).alias(f"_{c}" if c in on else c) for c in right.columns])
    return left.join(renamed, [F.col(c) == F.col(f"_{c}") for c in on], how).drop(*[f"_{c}" for c in on])


def _union(parts: list) -> DataFrame | None:
    parts = [x for x in parts if x is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _bindings(triples, q: Query) -> DataFrame:
    """A column for each used variable."""
    graph, used, once = _graph(triples), _used(q), _once(q)

    def scan(graph, pattern: tuple, tests: list, facts: list) -> DataFrame | None:
        """Of subjects that have all facts."""
        if not facts:
            return _scan(graph, pattern, q, used, tests)
        fact, rest = facts[0], facts[1:]
        sure, others = graph.states(fact[1][2], fact[2][2]) if fact[2][1] == "iri" else (None, graph)
        parts = [scan(sure, pattern, tests, rest)] if sure else []
        if others and (had := _scan(graph, fact, q, used, [])) is not None:
            found = scan(others, pattern, tests, rest)
            parts.append(None if found is None else _join(found, had, "left_semi"))
        return _union(parts)

    def all_of(graph, patterns: list, tests: list) -> DataFrame | None:
        todo = [(x, []) for x in patterns]
        if once:
            for fact in [x for x in patterns if x[0][0] == "var" and x[1][0] == x[2][0] == "term"]:
                i = next(i for i, (x, _) in enumerate(todo) if x == fact)
                about = next((facts for j, (x, facts) in enumerate(todo) if j != i and x[0] == fact[0]), None)
                if about is not None:
                    about += [fact, *todo.pop(i)[1]]
        found = None
        while todo:  # the next pattern is the first that shares a variable
            known = set(found.columns) if found is not None else set()
            i = next((i for i, (x, _) in enumerate(todo) if known & set(_names([x]))), 0)
            pattern, facts = todo.pop(i)
            got = scan(graph, pattern, tests, facts)
            if got is None:
                return None
            found = got if found is None else _join(found, got)
        return reduce(lambda df, x: df.where(_test(x)), tests, found)

    def empty(patterns: list) -> DataFrame:
        names = [x for x in dict.fromkeys(_names(patterns)) if x in used]
        return graph.spark.createDataFrame([], ", ".join(f"`{x}` {KIND}" for x in names))

    def solutions(graph) -> DataFrame | None:
        found = all_of(graph, q.where, q.filters)
        for patterns, tests in q.optional if found is not None else []:
            more = all_of(graph, patterns, tests)
            found = _join(found, empty(patterns) if more is None else more, "left")
        return found

    every = [*q.where, *[x for patterns, _ in q.optional for x in patterns]]
    star = len({x[0] for x in every}) == 1 and every[0][0][0] == "var"
    found = _union([solutions(x) for x in graph.spaces()]) if star else solutions(graph)
    return empty(every) if found is None else found


def ask(triples, text: str) -> bool:
    """Whether the pattern is met."""
    return _bindings(triples, _Parser(text).query()).limit(1).count() > 0


def construct(triples, text: str) -> DataFrame:
    """The distinct triples that the template makes of each solution."""
    q = _Parser(text).query()
    found, rows = _bindings(triples, q), []
    for s, p, o in q.template:
        def column(term) -> Column:
            if term[0] == "var":
                return F.col(term[1])
            return F.struct(F.lit(term[2]).alias("v"), F.lit(term[1]).alias("k"), F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("l"))

        a, b, c = column(s), column(p), column(o)
        rows.append(F.struct(
            a["v"].alias("s"), b["v"].alias("p"), c["v"].alias("o"), c["k"].alias("o_kind"), c["d"].alias("o_datatype"), c["l"].alias("o_lang")
        ))
    return found.select(F.inline(F.array(*rows))).distinct()


def _count(of: str | None, one: bool) -> Column:
    if of is None or not one:
        return F.count("*" if of is None else F.col(of))
    x = F.col(of)
    whole = F.struct(x["v"], x["k"], F.coalesce(x["d"], F.lit("")), F.coalesce(x["l"], F.lit("")))
    return F.count_distinct(*[F.when(x.isNotNull(), h) for h in term_hash(whole, "a", "b")])


def _by_sets(graph, p: str, group: str, name: str) -> DataFrame | None:
    """group, name: the objects of p and their distinct subjects, None where the general way is to be taken: with more than 63 * WORDS
    objects or SETS sets of them.

    A row of a table takes part as its subject's hash and a mask of the objects that it states, so it stays one row in the shuffle however
    many they are, and takes fixed width. Masks of a subject are merged, subjects counted by mask, and masks taken apart at the end.
    """
    parts, bit = ["o", "o_kind", "o_datatype", "o_lang"], lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (i % 63).cast("int"))
    rows = graph.scan(p=p, fields=["s", *parts], packed=True)
    if rows is None:
        return None
    sets = stored(graph.scan(p=p, fields=parts, packed=True).limit(SETS + 1), "object-sets")
    if sets.count() > SETS or sets.groupBy("h").count().where("count > 1").take(1):
        return None
    x = F.col("x")
    column = F.struct(x["o"].alias("v"), x["o_kind"].alias("k"), x["o_datatype"].alias("d"), x["o_lang"].alias("l")).cast(KIND)
    members = sets.select("h", F.explode("of").alias("x")).where("x IS NOT NULL").select("h", column.alias(group))
    objects = stored(members.select(group).distinct(), "objects")
    n_words = -(-objects.count() // 63)
    if n_words > WORDS:
        return None
    objects = objects.withColumn("i", F.row_number().over(W.orderBy(group)) - 1)
    words = [f"m{j}" for j in range(max(n_words, 1))]
    of_word = [F.coalesce(F.bit_or(F.when(F.floor(F.col("i") / 63) == j, bit(F.col("i")))), F.lit(0)).alias(m) for j, m in enumerate(words)]
    masks = stored(members.join(objects, group).groupBy("h").agg(*of_word), "object-masks")
    key = ["s1", "s2"]
    dealt = rows.select(*term_hash(F.col("s"), *key), "h").join(F.broadcast(masks), "h").drop("h").repartition(*key)
    counted = dealt.groupBy(*key).agg(*[F.bit_or(m).alias(m) for m in words]).groupBy(*words).agg(F.count("*").alias("n"))
    word = reduce(lambda found, j: F.when(F.floor(F.col("i") / 63) == j, F.col(words[j])).otherwise(found), range(len(words)), F.lit(0).cast("long"))
    found = counted.crossJoin(F.broadcast(objects)).where(word.bitwiseAND(bit(F.col("i"))) != 0)
    return found.groupBy(group).agg(F.sum("n").alias(name))


def select(triples, text: str) -> DataFrame:
    """A column of texts for each variable, of longs for each count."""
    q = _Parser(text).query()
    counts = [(name, of) for name, of in q.select if of]
    found, plain = None, not (q.filters or q.optional or q.values) and len(q.where) == 1 and len(counts) == len(q.group) == 1
    if plain and not isinstance(triples, DataFrame):
        s, p, o = q.where[0]
        if p[0] == "term" and s[0] == o[0] == "var" and s != o and q.group[0] == o[1] and counts[0][1] == (s[1], True):
            found = _by_sets(triples, p[2], o[1], counts[0][0])
    summed = found is not None
    found = found if summed else _bindings(triples, q)
    if (counts or q.group) and not summed:
        made = []
        for name, (of, one) in counts:
            made.append(_count(of, one).alias(name))
        found = found.groupBy(*q.group).agg(*made) if made else found.select(*q.group).distinct()
    names = q.select or [(c, None) for c in found.columns]
    found = found.select(*[F.col(n) if of else F.col(n)["v"].alias(n) for n, of in names])
    found = found.distinct() if q.distinct else found
    if q.order:
        found = found.orderBy(*[F.col(n).desc() if down else F.col(n).asc() for n, down in q.order])
    return found if q.limit is None else found.limit(q.limit)


def entity(triples: DataFrame, wanted: DataFrame) -> DataFrame:
    """All triples of the wanted subjects (s), in one join however many there are."""
    return triples.join(wanted.select("s").distinct(), "s", "left_semi")
