"""Benchmark decontamination over a distributed positional inverted index.

build_index() stores the postings (h, term, doc, pos) of all tokens of the corpus as Parquet, sorted in each segment by the
term's hash h, a radix sort of numbers; a segment is what one task has read, so building needs no shuffle, and an index built at a path of
its own serves any number of test sets (open_index). Phrases are found from their rarest terms: each window of a test item
has its RAREST rarest terms as anchors; their lists, looked up by h and each shifted back by the term's offset, are intersected by grouping on
(document, item, shift). The windows left are then compared word by word with the document, which also tells terms of equal
hash apart. near() finds documents in which all terms of an item stand near their places; it looks up hash and term.

The tests' terms, anchors and windows are broadcast if their measured size allows it, else shuffled. Texts are shuffled
only for documents that have candidates, which a Bloom filter of a size known beforehand tells.

Rows are told apart by the hash of doc_id (of any type, null too) and text, and each is compared for itself, by its own text; exact
repeats of a row share their candidates. Null and empty texts have no words and no hits. An empty item has no window and is never
found. A null item_id counts as ''. Repeated windows and items with equal texts are all reported. Without documents there are no rows, without
tests no hits. Other columns are ignored by find_phrases() and kept by drop_contaminated().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import ascii_lower, let, small, stored, table
from .url_filters import MAX_FILTER_BYTES, bloom

WINDOW = 10
RAREST = 2
#: Between words, before A-Z are lowered: ASCII but for digits and letters.
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")


def lower_words(text: Column) -> Column:
    return raw_words(ascii_lower(text))


def row_key() -> Column:
    """What the index and candidates call a row, for columns doc_id and text."""
    return F.xxhash64("doc_id", "text")


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Stored postings h, term, doc, pos of docs (doc, text), at path or among the intermediate tables."""
    tokens = docs.select("doc", F.posexplode(lower_words(F.col("text"))).alias("pos", "term"))
    tokens = tokens.select(F.xxhash64("term").alias("h"), "term", "doc", "pos").sortWithinPartitions("h")
    if path is None:
        return stored(tokens, "postings")
    tokens.write.parquet(path)
    return open_index(docs.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("h long, term string, doc long, pos int").parquet(path)


def test_words(tests: DataFrame) -> DataFrame:
    """Stored: item (a number for each row), item_id (as a string), words."""
    found = tests.select(
        F.monotonically_increasing_id().alias("item"),
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        lower_words(F.col("text")).alias("words"),
    )
    return stored(found.where(F.size("words") > 0), "test-items")


def _places(items: DataFrame) -> DataFrame:
    places = items.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("off", "term"))
    return places.withColumn("h", F.xxhash64("term"))


def term_counts(index: DataFrame, items: DataFrame) -> DataFrame:
    """Stored: h, n_found: postings of each hash of the items' terms."""
    terms = stored(_places(items).select("h").distinct(), "test-terms")
    return stored(index.select("h").join(small(terms), "h").groupBy("h").agg(F.count("*").alias("n_found")), "test-term-counts")


def _windows(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """Stored: item, start, need (offsets in the item of the window's rarest terms), item_id, said (its words).

    Windows with a term that the index lacks are out. A place lies in at most window windows.
    """
    last = F.greatest(F.col("n") - window, F.lit(0))
    places = _places(items).join(small(counts), "h", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    starts = F.sequence(F.least(F.greatest(F.col("off") - window + 1, F.lit(0)), last), F.least("off", last))
    of_window = places.select("item", F.explode(starts).alias("start"), F.struct("n_found", "off").alias("x"))
    ranked = of_window.groupBy("item", "start").agg(F.sort_array(F.collect_list("x")).alias("x"))
    found = ranked.where(F.col("x")[0]["n_found"] > 0).select(
        "item", "start", F.transform(F.slice("x", 1, RAREST), lambda x: x["off"]).alias("need")
    )
    whole = items.select(F.col("item").alias("_item"), "item_id", "words")
    found = found.join(whole, F.col("item") == F.col("_item"))
    said = F.slice("words", F.col("start") + 1, F.lit(window))
    return stored(found.select("item", "start", F.sort_array("need").alias("need"), "item_id", said.alias("said")), "test-windows")


def candidates(index: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stored: doc, maybe (array of at, item_id, said), of the documents that may hold a window of the tests."""
    items = test_words(tests)
    windows = _windows(items, term_counts(index, items), window)
    anchors = windows.select("item", F.explode("need").alias("off")).distinct()
    of_item = _places(items).select(F.col("item").alias("_item"), F.col("off").alias("_off"), "h")
    anchors = stored(
        anchors.join(of_item, (F.col("item") == F.col("_item")) & (F.col("off") == F.col("_off"))).select("h", "item", "off"),
        "test-anchors",
    )
    shifted = index.join(small(anchors), "h").select("doc", "item", (F.col("pos") - F.col("off")).alias("shift"), "off")
    met = shifted.groupBy("doc", "item", "shift").agg(F.collect_set("off").alias("got"))
    # a window's offsets come in order: look it up by the first, then ask for the last
    met = met.select("doc", "item", "shift", "got", F.explode("got").alias("_first"))
    wanted = small(windows.select(
        F.col("item").alias("_item"), "start", F.col("need")[0].alias("_off"), F.element_at("need", -1).alias("_last"), "item_id", "said"
    ))
    both = (F.col("item") == F.col("_item")) & (F.col("_first") == F.col("_off"))
    found = met.join(wanted, both).where(F.array_contains("got", F.col("_last")))
    at = F.struct((F.col("shift") + F.col("start")).alias("at"), "item_id", "said")
    return stored(found.where("shift + start >= 0").groupBy("doc").agg(F.collect_list(at).alias("maybe")), "phrase-candidates")


def _hits(text: Column) -> Column:
    """The candidates of the column maybe that the text holds, as array of (at, length, item_id); null without candidates."""

    def same(words: Column) -> Column:
        held = F.filter("maybe", lambda c: F.slice(words, c["at"] + 1, F.size(c["said"])) == c["said"])
        return F.transform(held, lambda c: F.struct(c["at"], F.size(c["said"]).alias("length"), c["item_id"]))

    return F.when(F.col("maybe").isNotNull(), let(lower_words(text), same))


def find_phrases(docs: DataFrame, tests: DataFrame, window: int = WINDOW, index: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, hits: array of (at, length, item_id), one for each occurrence of a window of an item.

    index: that of docs by row_key(), if it is there already.
    """
    base = docs.select("doc_id", row_key().alias("doc"), "text")
    found = candidates(index or build_index(base), tests, window)
    n_found = found.count()
    rows = base.select("doc_id", "doc", F.size(raw_words(F.col("text"))).cast("long").alias("n_words"), "text")
    if 2 * n_found <= MAX_FILTER_BYTES:  # 12 bits a key
        level = bloom(found.select(F.col("doc").alias("key")), n_found, 2**-8, 1, "candidate-docs")
        rows = rows.withColumn("text", F.when(level.has(F.col("doc"), "doc"), F.col("text")))
    joined = rows.join(found.withColumnRenamed("doc", "_doc"), F.col("doc") == F.col("_doc"), "left")
    return joined.select("doc_id", "n_words", _hits(F.col("text")).alias("hits"))


def near(index: DataFrame, tests: DataFrame, slack: int) -> DataFrame:
    """doc, item_id, at: where each term of an item stands within slack words of its place in the phrase, which starts at at.

    The rarest term of the item gives the places; the others are looked up within slack of theirs. doc is the index's name of a row.
    """
    items = test_words(tests)
    counts = term_counts(index, items)
    places = stored(_places(items).join(small(counts), "h"), "near-places")
    rarest = places.groupBy("item").agg(F.min(F.struct("n_found", "off", "h", "term", "item_id", "n")).alias("x"), F.count("*").alias("k"))
    rarest = stored(rarest.where("k = x.n").select("item", "x.h", "x.term", "x.off", "x.item_id", "x.n"), "near-rarest")
    first = index.join(small(rarest), ["h", "term"]).select("doc", "item", "item_id", "n", (F.col("pos") - F.col("off")).alias("at"))
    width = 2 * slack + 1
    wanted = first.join(small(places.select(F.col("item").alias("_item"), "term", "off")), F.col("item") == F.col("_item"))
    wanted = wanted.withColumn("place", F.col("at") + F.col("off"))
    cells = F.array_distinct(F.array(*[F.floor((F.col("place") + d) / width) for d in (-slack, slack)]))
    wanted = wanted.withColumn("cell", F.explode(cells))
    there = index.join(small(counts.select("h")), "h", "left_semi").select(
        F.col("term").alias("_t"), F.col("doc").alias("_d"), "pos", F.floor(F.col("pos") / width).alias("_c")
    )
    hit = (
        (F.col("term") == F.col("_t")) & (F.col("doc") == F.col("_d")) & (F.col("cell") == F.col("_c"))
        & (F.abs(F.col("pos") - F.col("place")) <= slack)
    )
    got = wanted.join(there, hit).groupBy("doc", "item", "item_id", "n", "at").agg(F.count_distinct("off").alias("k"))
    return got.where("k = n").select("doc", "item_id", "at")


def contaminated(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (their ids, sorted and joined by commas)."""
    hits = find_phrases(docs, tests)
    spots = F.array_distinct(
        F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1)))
    )
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    some = F.col("hits").isNotNull()
    return hits.select(
        "doc_id",
        "n_words",
        F.when(some, F.size(spots)).otherwise(0).cast("long").alias("n_hit"),
        F.when(some, F.size(items)).otherwise(0).cast("long").alias("n_items"),
        F.when(some, F.array_join(items, ",")).otherwise("").alias("items"),
    )


def drop_contaminated(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The rows of docs without any occurrence of a window of the tests, with their columns.

    Each row is judged by its own text, also if it has no doc_id or shares it. Only rows that may be contaminated are shuffled.
    """
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("doc"))
    found = candidates(build_index(rows.select("doc", "row.text")), tests)
    n = found.count()
    if not n:
        return docs
    clean = None
    if 2 * n <= MAX_FILTER_BYTES:  # 12 bits a key
        level = bloom(found.select(F.col("doc").alias("key")), n, 2**-8, 1, "candidate-docs")
        maybe = level.has(F.col("doc"), "doc")
        rows, clean = rows.where(maybe), rows.where(~maybe).select("row.*")
    judged = rows.join(found.withColumnRenamed("doc", "_doc"), F.col("doc") == F.col("_doc"), "left")
    left = judged.where(F.coalesce(F.size(_hits(F.col("row.text"))), F.lit(0)) <= 0).select("row.*")
    return left if clean is None else clean.unionByName(left)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode("items", "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES = {
    "op2_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, n FROM grams JOIN win USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
