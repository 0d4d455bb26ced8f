"""URL filters: prefix rules, and exact membership in a list by a cascade of Bloom filters.

Level 1 encodes the listed keys, level 2 those other keys of the corpus that level 1 falsely has,
level 3 the listed keys that level 2 falsely has, and so on until none is left. A key of the
universe is then judged exactly by the first level without it: listed if that level is an even one. Filters are
arrays of 64-bit words that each task gets as a scalar subquery, so judging needs no join and no shuffle.

The size of a filter follows from the number of its keys and is known before it is built.
Keys are cut into segments by hash until each segment's filters stay under MAX_FILTER_BYTES. Rows and keys are then written once, a
folder for each segment, and each segment is judged from its own folder, so all rows are still read once.

Null urls and those without :// have an empty host and path and the key ''. Repeated urls get equal verdicts. An
empty list allows everything that no rule blocks; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import UPPER, stored, table

MAX_FILTER_BYTES = 32 << 20
#: Rules: (verdict, host, path). A rule fits its host and all subdomains if the path starts with the rule's.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; '' if there is none."""
    host = F.regexp_extract(url, "^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; '' without ://."""
    return F.coalesce(F.regexp_extract(url, "^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        test = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        made = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(test, made) if out is None else out.when(test, made)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


@dataclass(frozen=True)
class Level:
    bits: DataFrame  # one row, words: array<bigint>
    n_bits: int
    seeds: tuple[int, ...]

    def has(self, key: Column, name: str = "key") -> Column:
        """Whether the filter has the value of a column; name is that column's name."""
        words, out = self.bits.scalar(), F.lit(True)
        for s in self.seeds:
            at = _bit(key, s, self.n_bits)
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            mask = F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({s}, `{name}`), {self.n_bits}) % 64 AS INT))")
            out = out & (word.bitwiseAND(mask) != 0)
        return out


def _bit(key: Column, seed: int, n_bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(n_bits).cast("long"))


def bloom(keys: DataFrame, n: int, p: float, level: int, name: str) -> Level:
    """A filter of the n distinct values of keys.key, false for other keys with probability p."""
    k = max(1, round(-math.log2(p)))
    n_words = max(1, math.ceil(max(n, 1) * k / math.log(2) / 64))
    seeds = tuple(range(1000 * level, 1000 * level + k))
    at = keys.select(F.explode(F.array(*[_bit(F.col("key"), s, n_words * 64) for s in seeds])).alias("at"))
    some = at.select(
        F.shiftright("at", 6).alias("i"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("b")
    ).groupBy("i").agg(F.bit_or("b").alias("b"))
    spark = keys.sparkSession
    dense = spark.range(n_words).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("b")).unionByName(some)
    dense = dense.groupBy("i").agg(F.bit_or("b").alias("b"))
    row = dense.agg(F.array_sort(F.collect_list(F.struct("i", "b"))).alias("w"))
    return Level(stored(row.select(F.col("w.b").alias("words")), name), n_words * 64, seeds)


def cascade(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """Levels that together tell exactly which keys of the universe are listed. Both: key, distinct."""
    inside, n_in, n_all = listed, listed.count(), universe.count()
    if not n_in:
        return []
    outside = stored(universe.join(listed, "key", "left_anti"), "cascade-keys")
    p, levels = max(2**-8, min(0.5, math.sqrt(0.5) * n_in / max(1, n_all - n_in))), []
    while n_in:
        level = bloom(inside, n_in, p, len(levels) + 1, "cascade-level")
        levels.append(level)
        wrong = stored(outside.where(level.has(F.col("key"))), "cascade-keys")
        inside, outside, n_in, p = wrong, inside, wrong.count(), 1 / 8
    return levels


def contains(levels: list[Level], key: str = "key") -> Column:
    """Whether a key of the universe is listed: it fails first at an even level, or passes an odd number of all."""
    if key != "key":
        raise ValueError("the column must be named key")
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(~levels[i].has(F.col("key")), F.lit(i % 2 == 1)).otherwise(out)
    return out


def judge(rows: DataFrame, listed: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """rows (with key) and listed_key boolean, exact for every key that rows has. listed: key."""
    universe = stored(rows.select("key").distinct(), "url-universe")
    known = stored(listed.select("key").where("key IS NOT NULL").distinct().join(universe, "key", "left_semi"), "url-list")
    segments = max(1, math.ceil(2 * known.count() / max_bytes))  # under 16 bits a key, all levels together
    if segments == 1:
        return rows.withColumn("listed_key", contains(cascade(universe, known)))
    of = F.pmod(F.hash("key"), F.lit(segments)).alias("_segment")
    rows, universe, known = (stored(x.select("*", of), "url-segments", ["_segment"]) for x in (rows, universe, known))
    out = None
    for s in range(segments):
        mine = F.col("_segment") == s
        levels = cascade(universe.where(mine).select("key"), known.where(mine).select("key"))
        part = rows.where(mine).drop("_segment").withColumn("listed_key", contains(levels))
        out = part if out is None else out.unionByName(part)
    return out


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict. listed: key, host and path joined."""
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = judge(parts.withColumn("key", F.concat("host", "path")), listed)
    return rows.withColumn("m", match_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("m.rule").alias("rule"),
        F.coalesce(F.col("m.verdict"), F.when(F.col("listed_key"), "block").otherwise("allow")).alias("verdict"),
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: the addresses that some page carries with a ref parameter in its query."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    refs = pages.where(F.col("url").rlike("[?&]ref="))
    listed = refs.select(F.concat(url_host(F.col("url")), url_path(F.col("url"))).alias("key")).distinct()
    return filter_urls(pages, listed)


QUERIES = {"op5_url_filters": op5_url_filters}
ORACLES = {
    "op5_url_filters": r"""
WITH cut AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '^(?s).*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s).*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
listed AS (SELECT DISTINCT host || path AS key FROM cut WHERE regexp_matches(url, '[?&]ref=')),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule
  FROM cut)
SELECT page_id, host, path, rule,
       CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
}
