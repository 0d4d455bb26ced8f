"""Quality rules: decision lists learned by sequential covering from labelled statistics.

Statistics come from whole texts by built-in functions. Learning looks at the labelled rows only
through a cube of their counts: each statistic is cut at quantiles of all rows, of the bad and of the good ones, tails
included. The cube is a stored table of its occupied cells; only sums by cut reach the driver, as many as there are cuts
however many rows are labelled. The learned list is a Spark CASE expression.

Null and empty texts have no words: all statistics are zero and the base rule fails them. Repeated rows are
judged each for itself. Null labels and labels of unknown documents are left out; without labels
the list is empty and keeps all that the base rule keeps. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import BLANKS, blank_words, let, stored, table

#: Where the values stand that tests compare with, among the rows of each label and among all.
SHARES = [0.0, 0.01, 0.02, 0.05, *[i / 16 for i in range(1, 16)], 0.9, 0.95, 0.98, 0.99, 1.0]
SYMBOLS = "#*$%&|<>"
_POS_BITS = 24


def _trigram_hashes(words: Column, n: Column) -> Column:
    all_of = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.slice(all_of, F.lit(1), F.greatest(n - 2, F.lit(0)))


def _repeated_starts(h: Column) -> Column:
    """Positions (from 0) of the hashes that occur at least twice.

    Hashes are sorted with their positions in the low bits, as plain longs. Where two different
    hashes share the high bits the array is sorted as structs instead, so nothing rests on those bits.
    """
    mask = (1 << _POS_BITS) - 1

    def fast(s: Column) -> Column:
        def full(x: Column) -> Column:
            return F.get(h, x.bitwiseAND(F.lit(mask)).cast("int"))

        def same(x: Column, other: Column) -> Column:
            return F.coalesce(F.shiftright(x, _POS_BITS) == F.shiftright(other, _POS_BITS), F.lit(False))

        def before(j: Column) -> Column:
            return F.when(j > 0, F.get(s, j - 1))

        clash = F.exists(
            F.filter(s, lambda x, j: same(x, before(j)) & (full(x) != full(before(j)))), lambda x: F.lit(True)
        )
        found = F.transform(
            F.filter(s, lambda x, j: same(x, before(j)) | same(x, F.get(s, j + 1))),
            lambda x: x.bitwiseAND(F.lit(mask)).cast("int"),
        )
        return F.when((F.size(h) > mask) | clash, exact()).otherwise(found)

    def exact() -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda s: F.transform(
                F.filter(
                    s,
                    lambda x, j: F.coalesce(
                        (F.when(j > 0, F.get(s, j - 1))["h"] == x["h"]), F.lit(False)
                    )
                    | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            ),
        )

    packed = F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, _POS_BITS), _POS_BITS).bitwiseOR(i.cast("long")))
    return let(F.sort_array(packed), fast)


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text has at least twice, the first one included."""

    def covered(starts: Column) -> Column:
        return F.size(
            F.array_distinct(
                F.concat(starts, F.transform(starts, lambda i: i + 1), F.transform(starts, lambda i: i + 2))
            )
        )

    return let(let(_trigram_hashes(words, F.size(words)), _repeated_starts), covered).cast("long")


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    words = let(
        blank_words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), n_repeat_words(w).alias("r")),
    )
    stats = docs.select(
        "doc_id",
        words.alias("w"),
        F.length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return stats.select(
        "doc_id", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("w.r").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


#: What rules may test, by name.
FEATURES = {
    "n_words": F.col,
    "chars_per_word": lambda _: _ratio("word_chars", "n_words"),
    "symbols_per_word": lambda _: _ratio("n_symbols", "n_words"),
    "dup_lines": lambda _: F.col("n_dup_lines"),
    "repeat_share": lambda _: _ratio("n_repeat_words", "n_words"),
}


def _feature(name: str) -> Column:
    return FEATURES[name](name).cast("double")


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool  # feature > cut, else feature <= cut
    cut: float

    def column(self) -> Column:
        x = _feature(self.feature)
        return x > self.cut if self.above else x <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


def _cuts(labelled: DataFrame) -> list[list[float]]:
    """For each feature the values that tests compare with: quantiles of all rows, of the bad and of the good ones.

    A quantile of one label comes with the next smaller double, so that a test can take the value in or leave it out.
    """
    kinds = [F.lit(True), F.col("good") == 0, F.col("good") != 0]
    wanted = [
        F.percentile_approx(F.when(kind, _feature(f)), SHARES, 10_000).alias(f"q{i}_{k}")
        for i, f in enumerate(FEATURES)
        for k, kind in enumerate(kinds)
    ]
    row = labelled.agg(*wanted).first()
    out = []
    for i in range(len(FEATURES)):
        found = {x for k in range(len(kinds)) for x in row[f"q{i}_{k}"] or []}
        of_label = {x for k in (1, 2) for x in row[f"q{i}_{k}"] or []}
        out.append(sorted(found | {math.nextafter(x, -math.inf) for x in of_label}))
    return out


def _cells(labelled: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """Stored: a row for each occupied cell, b0.. (cuts below the row's value, by feature), half (0 grow, 1 prune), bad, n."""
    def below(x: Column, of: list[float]) -> Column:
        at = F.filter(F.array(*[F.lit(c) for c in of]), lambda c: c < x) if of else F.array()
        return F.size(at)

    bins = [below(_feature(f), cuts[i]).alias(f"b{i}") for i, f in enumerate(FEATURES)]
    half = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 2).cast("int").alias("half")
    cells = (
        labelled.select(*bins, half, (F.col("good") == 0).cast("long").alias("bad"))
        .groupBy(*[f"b{i}" for i in range(len(FEATURES))], "half")
        .agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
    )
    return stored(cells, "quality-cells")


def _sums(cells: DataFrame, cuts: list[list[float]]) -> dict[tuple[int, bool, int], tuple[int, int, int, int]]:
    """For each test (feature, above, cut) the bad and good rows of the cells that pass it: in half 0, then in half 1."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"b{i}").alias("b")) for i in range(len(FEATURES))]))
    rows = (
        cells.select(each.alias("x"), "half", "bad", "n")
        .groupBy("x.i", "x.b", "half")
        .agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
        .collect()  # bounded by the cuts
    )
    at = [[[0, 0, 0, 0] for _ in range(len(c) + 1)] for c in cuts]
    for r in rows:
        at[r["i"]][r["b"]][2 * r["half"]] += r["bad"]
        at[r["i"]][r["b"]][2 * r["half"] + 1] += r["n"] - r["bad"]
    out = {}
    for i, of_bin in enumerate(at):
        all_of = [sum(x) for x in zip(*of_bin, strict=True)]
        low = [0, 0, 0, 0]
        for k in range(len(cuts[i])):
            low = [x + y for x, y in zip(low, of_bin[k], strict=True)]
            out[i, False, k] = tuple(low)
            out[i, True, k] = tuple(x - y for x, y in zip(all_of, low, strict=True))
    return out


def learn(labelled: DataFrame, max_rules: int = 8, max_tests: int = 3, precision: float = 0.9) -> list[list[Test]]:
    """Conjunctions that mark a row as bad, in the order learned. labelled: statistics and good (0 or 1).

    Each rule grows greedily by precision (Laplace) on two thirds of the rows, loses its last tests while that
    does not lower its precision on the other third, and is taken if both stay over the bound given.
    Of cuts that do equally well the one farthest from the bad rows is taken. Covered rows are then removed.
    """
    cuts = _cuts(labelled)
    if not any(cuts):
        return []
    left, names = _cells(labelled, cuts), list(FEATURES)

    def holds(t: tuple[int, bool, int]) -> Column:
        return F.col(f"b{t[0]}") > t[2] if t[1] else F.col(f"b{t[0]}") <= t[2]

    def share(bad: int, good: int) -> float:
        return (bad + 1) / (bad + good + 2)

    rules = []
    while len(rules) < max_rules:
        rule, here, best = [], left, (0.0, 0)
        grown: list[tuple[float, float]] = []  # precision in both halves after each test
        while len(rule) < max_tests:
            sums = _sums(here, cuts)
            top = max(
                (t for t, x in sums.items() if x[0] >= 5 and t not in rule),
                default=None,
                key=lambda t: (round(share(*sums[t][:2]), 6), sums[t][0], t[0], t[1], -t[2] if t[1] else t[2]),
            )
            if top is None or (share(*sums[top][:2]), sums[top][0]) <= best:
                break
            x = sums[top]
            best, rule = (share(*x[:2]), x[0]), [*rule, top]
            grown.append((share(*x[:2]), share(*x[2:])))
            here = here.where(holds(top))
        while len(rule) > 1 and grown[len(rule) - 2][1] >= grown[len(rule) - 1][1]:
            rule = rule[:-1]
        if not rule or min(grown[len(rule) - 1]) < precision:
            break
        rules.append([Test(names[i], above, cuts[i][k]) for i, above, k in rule])
        left = left.where(~functools.reduce(Column.__and__, map(holds, rule)))
    return rules


def with_margins(labelled: DataFrame, rules: list[list[Test]]) -> list[list[Test]]:
    """The rules with each cut moved half the way to the bad rows that the rule covers, leaving out the 2 % nearest.

    Cuts stand at quantiles, often right at the good ones; a good row just beyond them should stay.
    """
    if not rules:
        return rules
    edges = []
    for i, rule in enumerate(rules):
        covered = F.col("good") == 0
        for t in rule:
            covered = covered & t.column()
        for j, t in enumerate(rule):
            share = 0.02 if t.above else 0.98
            edges.append(F.percentile_approx(F.when(covered, _feature(t.feature)), share, 1000).alias(f"e{i}_{j}"))
    row = labelled.agg(*edges).first()
    out = []
    for i, rule in enumerate(rules):
        ends = [row[f"e{i}_{j}"] for j in range(len(rule))]
        out.append([
            Test(t.feature, t.above, t.cut if e is None else (t.cut + e) / 2) for t, e in zip(rule, ends, strict=True)
        ])
    return out


def keep_expression(rules: list[list[Test]]) -> Column:
    """The ordered list as one CASE expression over statistics: false at the first rule that fits."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of each document, base_failed and kept."""
    stats = stored(text_stats(docs), "quality-stats")
    good = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("good")).where("good IS NOT NULL")
    labelled = stored(stats.where(~base_failed()).join(good, F.col("doc_id") == F.col("_id")), "quality-labelled")
    rules = with_margins(labelled, learn(labelled))
    return stats.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & keep_expression(rules)
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES: dict[str, str] = {}
