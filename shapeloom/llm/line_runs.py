"""Line dedup over levelled sorted runs of line hashes.

A LineRuns store holds the keys seen so far as runs: tables bucketed and sorted by hash, so that a merge reads them as they are, without
an exchange or a sort on their side. Each new batch drops the lines whose key some run has (a merge anti-join), then adds a run of its own
new keys at level 0; when a level has FANOUT runs they are compacted into one run of the next level, so a store of n
batches has O(log n) runs.

drop_repeated() applies it to a corpus: keys found in enough documents are counted first, by partial sums, then
batches run from the largest doc_id down, so the largest document that holds a key is the one that is seen first. Lines look up the
counted keys; hot keys, each with more than a 1024th of all such lines, are broadcast, so their lines are not brought to one task.

A key is a line without white space at both ends and with A-Z in lower case; it is held as 128 bits of hash. Null and
empty texts are one empty line. doc_id may be of any type that has an order; null is the smallest. Rows that repeat a doc_id are one
document: they count once, and the largest doc_id keeps its lines in all its rows. Documents of one line, repeated lines
within a document and very long lines need no special case. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, remove
from ._util import ascii_lower, spread_join, stored, table

FANOUT = 3
BATCHES = 4
#: Documents, at most, by which the batches are cut; the result does not depend on the cuts.
CUT_SAMPLE = 1000
HASH = ["h1", "h2"]
_TRIM = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_TRIM)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """While this holds, plans rely on the order of a bucket's rows where the bucket is one file, as those of runs are."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class LineRuns:
    """The store. levels[i] lists the runs of level i, each a table of h1, h2 in as many buckets as a shuffle has partitions."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.paths = spark, fanout, [[]], {}
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _write(self, keys: DataFrame, level: int) -> str:
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        writer = keys.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
        self.paths[name] = new_path(self.spark, name)
        writer.option("path", self.paths[name]).format("parquet").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (distinct h1, h2) whose hash no run has. To be planned under _sorted_buckets()."""
        for run in self.runs():
            keys = keys.join(run.hint("merge"), HASH, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> DataFrame:
        """Takes in a batch of distinct keys (h1, h2 and other columns); returns those not seen before."""
        with _sorted_buckets(self.spark):
            fresh = stored(self.unseen(keys), "line-fresh")
        self.levels[0].append(self._write(fresh.select(*HASH), 0))
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                # as plain files: a union of buckets would be written without the exchange that makes one file of each; runs share no key
                merged = self.spark.read.schema("h1 long, h2 long").parquet(*[self.paths[name] for name in level])
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._write(merged, i + 1))
                self.levels[i] = []
                self._remove(level)
        return fresh

    def _remove(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Removes all runs."""
        for level in self.levels:
            self._remove(level)
        self.levels = [[]]


def _batches(lines: DataFrame, n: int) -> list[Column]:
    """Conditions that cut doc_id into n ranges of about equal documents, the largest first; null is the smallest."""
    some = lines.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(CUT_SAMPLE)
    ids = [r[0] for r in some.orderBy("doc_id").collect()]
    cuts, doc = [], F.col("doc_id")
    for i in range(1, n):
        cut = ids[i * len(ids) // n] if ids else None
        if cut is not None and cut not in cuts:
            cuts.append(cut)
    kind, out, low = lines.schema["doc_id"].dataType, [], None
    for high in [*(F.lit(c).cast(kind) for c in cuts), None]:
        test = F.lit(True) if low is None else F.coalesce(doc > low, F.lit(False))
        out.append(test if high is None else test & F.coalesce(doc <= high, F.lit(True)))
        low = high
    return out[::-1]


def drop_repeated(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, n_batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without the dropped lines)."""
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = base.select(
        "doc_id",
        F.xxhash64("text").alias("t"),
        F.posexplode(F.transform(F.split("text", "\n"), line_key)).alias("i", "key"),
    ).where(F.length("key") >= min_chars)
    lines = stored(lines.select("doc_id", "t", "i", *_hashes(F.col("key"))), "lines")
    # distinct documents of a key: one row for each key and document, then partial sums
    often = lines.select("doc_id", *HASH).distinct().groupBy(*HASH).agg(F.count("*").alias("n"))
    often = stored(often.where(F.col("n") >= min_docs).select(*HASH), "line-often")
    lines = stored(spread_join(lines, often, HASH), "line-candidates")
    store, dropped, doc = LineRuns(spark), None, F.struct("doc_id").alias("doc")  # a struct: null is a value like others
    for batch in _batches(lines, n_batches):
        mine = lines.where(batch)
        # stored, as the anti-joins would else be moved before the sums, where a hot key has many rows
        first = store.add(stored(mine.groupBy(*HASH).agg(F.max(doc).alias("doc")), "line-batch"))
        part = mine.withColumn("doc", doc).join(first, [*HASH, "doc"], "left_anti")
        dropped = part if dropped is None else dropped.unionByName(part)
    store.close()
    at = dropped.groupBy(F.col("doc").alias("_d"), F.col("t").alias("_t")).agg(F.collect_set("i").alias("at"))
    joined = base.withColumn("t", F.xxhash64("text")).join(at, (doc == F.col("_d")) & (F.col("t") == F.col("_t")), "left")
    kept = F.when(F.col("at").isNull(), F.col("text")).otherwise(_without("text", "at"))
    return joined.select(
        "doc_id",
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.size("at")).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )


def _without(text: str, at: str) -> Column:
    return F.get(
        F.transform(
            F.array(F.split(text, "\n")),
            lambda x: F.array_join(
                F.transform(
                    F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(at)), lambda i: F.get(x, i)
                ),
                "\n",
            ),
        ),
        F.lit(0),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES = {
    "op10_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.last AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
