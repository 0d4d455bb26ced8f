"""Samples of entities. Reservoirs are taken as the first k of each class by a seeded hash (md5, so that any engine agrees).

That has the size law of a reservoir without its dependence on the order of lines. A window with row_number() <= k is
cut to k rows before the shuffle in each task, so a class of any size costs little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import small, stored
from . import profile as P


def seeded(seed: int, *parts: str) -> Column:
    return F.md5(F.encode(F.concat(F.lit(f"{seed}|"), *[F.col(p) for p in parts]), "UTF-8"))


def bernoulli(classes: DataFrame, pct: int, seed: int = 100) -> DataFrame:
    """Type pairs (s, c), each taken with probability pct / 100."""
    draw = F.conv(F.substring(seeded(seed, "s", "c"), 1, 8), 16, 10).cast("long") % 100
    return classes.where(draw < pct)


def capacity(counts: DataFrame, largest: int, pct: float, compat: bool = False) -> DataFrame:
    """c, cap. Default: pct percent of the class, at least 1 and at most largest.

    compat: the capacity that starts at 1 and, as members arrive, becomes pct times the fill while that is under largest
    and the fill is at most pct percent of what has arrived. Arrivals that only wait for that share are skipped, so the steps
    are bounded by largest, however many members the class has.
    """
    if not compat:
        share = F.ceil(F.col("n") * pct / 100)
        return counts.select("c", F.greatest(F.lit(1), F.least(F.lit(largest), share)).cast("int").alias("cap"))
    kind = "struct<k:bigint,fill:bigint,cap:bigint>"

    def state(k: Column, fill: Column, cap: Column) -> Column:
        return F.struct(k.alias("k"), fill.alias("fill"), cap.alias("cap")).cast(kind)

    def step(x: Column, _: Column) -> Column:
        fill, k = x["fill"] + 1, x["k"] + 1
        grows = (fill * pct < largest) & (fill * 100.0 / k <= pct)
        arrival = state(k, fill, F.when(grows, F.floor(fill * pct)).otherwise(x["cap"]))
        ready = F.greatest(k, F.ceil(x["fill"] * 100.0 / pct).cast("long"))  # when a full one may grow
        waited = F.when(
            (x["fill"] * pct < largest) & (ready <= F.col("n")), state(ready, x["fill"], F.floor(x["fill"] * pct))
        ).otherwise(state(F.col("n").cast("long"), x["fill"], x["cap"]))
        return F.when(x["k"] >= F.col("n"), x).when(x["fill"] < x["cap"], arrival).otherwise(waited)

    start = state(F.lit(0), F.lit(0), F.lit(1))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(2 * largest + 2)), start, step)
    return counts.select("c", end["cap"].cast("int").alias("cap"))


def likely(rows: DataFrame, k: int, seed: int = 100) -> DataFrame:
    """Stored: rows (s, c, scope; to be read twice) among which are the first k of each class and scope by the seeded hash.

    Those whose hash is under a limit that about 4 k + 200 of the class and scope should pass; where fewer than k do, all.
    """
    cells = rows.groupBy("c", "scope").agg(F.count("*").alias("m"))
    limit = F.floor((1 << 28) * (4.0 * k + 200) / F.col("m"))
    cells = stored(cells.withColumn("under", F.when(F.col("m") > 4 * k + 200, F.lpad(F.lower(F.hex(limit)), 7, "0"))), "cells")
    under = F.col("under").isNull() | (F.substring(seeded(seed, "s"), 1, 7) < F.col("under"))
    found = stored(rows.join(small(cells), ["c", "scope"]).where(under).select(*rows.columns), "likely")
    got = found.groupBy("c", "scope").agg(F.count("*").alias("got"))
    few = cells.join(got, ["c", "scope"], "left").where(F.col("under").isNotNull() & (F.coalesce("got", F.lit(0)) < k))
    few = stored(few.select("c", "scope"), "few")
    if not few.take(1):
        return found
    return found.join(few, ["c", "scope"], "left_anti").unionByName(rows.join(few, ["c", "scope"], "left_semi"))


def reservoir(classes: DataFrame, k: int | DataFrame, seed: int = 100, neighbours: bool = False) -> DataFrame:
    """c, s, slot: at most k entities of each class (k: a number, or c and cap). neighbours: those with more classes first.

    classes: s, c once each. If it has scope (the classes of s), it is read twice, and only likely() rows are ranked.
    """
    rows = classes
    if "scope" in rows.columns:
        most = k if isinstance(k, int) else k.agg(F.max("cap")).first()[0] or 0
        rows = likely(rows, most, seed)
    order = [seeded(seed, "s"), F.col("s")]
    if neighbours:
        if "scope" not in rows.columns:
            scope = classes.groupBy(F.col("s").alias("_s")).agg(F.count("*").alias("scope"))
            rows = rows.join(scope, F.col("s") == F.col("_s"))
        order = [F.col("scope").desc(), *order]
    slot = F.row_number().over(W.partitionBy("c").orderBy(*order))
    ranked = rows.withColumn("slot", slot)
    if isinstance(k, int):
        return ranked.where(F.col("slot") <= k).select("c", "s", "slot")
    most = k.agg(F.max("cap")).first()[0] or 0
    return ranked.where(F.col("slot") <= most).join(k, "c").where("slot <= cap").select("c", "s", "slot")


def sample_entities(classes: DataFrame, counts: DataFrame, strategy: str, largest: int, pct: float, seed: int, compat: bool = False):
    """c, s, slot by strategy: standard, neighbour or dynamic."""
    if strategy == "standard":
        return reservoir(classes, largest, seed)
    if strategy == "neighbour":
        return reservoir(classes, largest, seed, neighbours=True)
    if strategy == "dynamic":
        return reservoir(classes, capacity(counts, largest, pct, compat), seed, neighbours=True)
    raise ValueError(f"unknown strategy: {strategy}")


def sampled_triples(triples: DataFrame, sample: DataFrame) -> DataFrame:
    return triples.join(sample.select("s").distinct(), "s", "left_semi")


def sampled_stats(
    literals: DataFrame, links: DataFrame, sample: DataFrame, known: DataFrame, type_predicate: str, untyped: str | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Stored: shape_table over sampled entities: confidence is support over the class's sample; n stays the whole class.

    literals, links: without type triples; sample: stored c, s; known: stored hashed_types(). A property all of whose objects are untyped
    stays with a null ot, unless untyped names a type. counts: c, n; with it, known needs only the objects of links.
    """
    own = stored(sample.select(*P.term_hash(F.col("s"), *P.KEY), "c").distinct(), "sample-types")
    entities = small(stored(own.select(*P.KEY).distinct(), "sample-entities"))

    def mine(df: DataFrame, *columns: str) -> DataFrame:
        return df.select(*P.term_hash(F.col("s"), *P.KEY), "p", *columns).join(entities, P.KEY, "left_semi")

    props = P.typed_properties(mine(literals, "o_datatype"), mine(links, "o"), known, untyped)
    sizes = own.groupBy("c").agg(F.count("*").alias("reservoir"))
    found = P.shape_table(props, own).join(sizes, "c").join(P.class_sizes(known) if counts is None else counts, "c")
    return stored(found.withColumn("confidence", F.col("support").cast("double") / F.col("reservoir")), "sampled-table")
