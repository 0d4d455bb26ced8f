"""Near duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Fingerprints link if at most RADIUS = 3 of their 64 bits differ. If each of two fingerprints emits all its variants
within one bit, two that differ in at most 2 bits share a variant. For the third bit, the 64
bits are cut into three blocks, and variants are emitted three times, each time with one block left out: of three differing
bits at least one lies in some block, and without it at most 2 remain. So a fingerprint emits
3 + 2 * 64 variants instead of the 2081 of a ball of two bits, and with 42 bits or more in a
variant, chance meetings stay rare. Variants are shuffled; those that meet are verified on all 64 bits.

A group of any size in one variant gives a spanning tree, not its pairs: a search takes the
linked ones out of those not yet reached. Trees are joined by alternating large-star and small-star steps, whose
edges are written to the shared folder each round. Only distinct fingerprints take part, so exact copies cost nothing.

A text without words (null, empty) has fingerprint 0, linked like any other. Null doc_ids are not the least of a
group; a group of only those has a null component. Repeated rows are copies. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import drop, lean, ship, stored, table, texts_of
from .url_filters import MAX_FILTER_BYTES, bloom

ship(__name__)

RADIUS = 3
SEED = 42
#: First bit and number of bits of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's 3-word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - 2)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[starts[i] : ends[min(i + 2, len(words) - 1)] - 1], SEED) for i in range(n)), dtype="<u8", count=n
    )
    ones = np.zeros(64, dtype="i8")
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view("u1").reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each row, and the columns more."""
    columns = ["doc_id", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for texts in texts_of(b.column("text")) for t in texts], dtype="u8")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(fp.view("i8"))], names=[*columns, "fp"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, "text").mapInArrow(lean(run), f"{kinds}, fp long")


def _variants(fp: np.ndarray) -> np.ndarray:
    """A row of variants for each fingerprint; the block left out holds the block's number."""
    out = []
    for k, (first, n) in enumerate(BLOCKS):
        mask = np.uint64(((1 << n) - 1) << first)
        kept = (fp & ~mask) | (np.uint64(k + 1) << np.uint64(first))
        flips = [0] + [1 << i for i in range(64) if not first <= i < first + n]
        out.append(kept[:, None] ^ np.array(flips, dtype="u8"))
    return np.concatenate(out, axis=1)


def _longs(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view("i8")) for x in columns.values()], names=list(columns))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column("fp").to_numpy().view("u8")
        for at in range(0, len(fps), 1000):
            part = fps[at : at + 1000]
            v = _variants(part)
            yield _longs(v=v.ravel(), fp=np.repeat(part, v.shape[1]))


def tree(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between distinct fingerprints."""
    left, edges = fps, []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= RADIUS
            if near.any():
                found = left[near]
                todo += list(found)
                edges += [(int(x), int(y)) for y in found]
                left = left[~near]
    return edges


def _edges(v: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """Edges within the variants of rows sorted by variant."""
    new = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    sizes = np.diff(np.append(new, len(v)))
    pairs = new[sizes == 2]
    a, b = fp[pairs], fp[pairs + 1]
    near = np.bitwise_count(a ^ b) <= RADIUS
    edges = {(int(min(x, y)), int(max(x, y))) for x, y in zip(a[near], b[near], strict=True)}
    for s, n in zip(new[sizes > 2], sizes[sizes > 2], strict=True):
        edges.update((min(e), max(e)) for e in tree(np.sort(fp[s : s + n])))
    e = np.array(sorted(edges), dtype="u8").reshape(-1, 2)
    return _longs(a=e[:, 0], b=e[:, 1])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by variant; the last variant of a batch may go on in the next ones, and is held until it ends."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        v, fp = b.column("v").to_numpy(), b.column("fp").to_numpy().view("u8")
        if not len(v):
            continue
        cut = int(np.searchsorted(v, v[-1], side="left"))
        if cut or (held and held[-1][0][-1] != v[0]):
            held.append((v[:cut], fp[:cut]))
            yield _edges(*map(np.concatenate, zip(*held, strict=True)))
            held = []
        held.append((v[cut:], fp[cut:]))
    if held:
        yield _edges(*map(np.concatenate, zip(*held, strict=True)))


def links(fps: DataFrame) -> DataFrame:
    """Edges a, b between distinct fingerprints fp, enough to connect all that are linked directly or through others."""
    met = fps.select("fp").mapInArrow(lean(_emit), "v long, fp long").repartition("v").sortWithinPartitions("v")
    return met.mapInArrow(lean(_meet), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node that it reaches) of all nodes of the edges a, b."""
    now = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links"
    )
    state = None
    while True:
        new_state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new_state == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = new_state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )  # each a over its b
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        before, now = now, stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        drop(before)


def _groups(marked: DataFrame, first: Column) -> DataFrame:
    """_fp, least: for each fingerprint the least first of its group. first: an aggregate, the least of the rows of one fingerprint."""
    fps = stored(marked.groupBy("fp").agg(first.alias("first")), "fingerprint-first")
    roots = stored(components(links(fps)), "fingerprint-roots")
    grouped = fps.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "first")
    of_root = grouped.groupBy("root").agg(F.min("first").alias("least"))
    of_fp = grouped.join(of_root, "root").select(F.col("fp").alias("_fp"), "least")
    alone = fps.join(roots, F.col("fp") == F.col("node"), "left_anti")
    return of_fp.unionByName(alone.select(F.col("fp").alias("_fp"), F.col("first").alias("least")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id of the group) of each row."""
    marked = stored(fingerprints(docs), "fingerprints")
    of_fp = _groups(marked, F.min("doc_id")).withColumnRenamed("least", "component_id")
    return marked.join(of_fp, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group, with the columns of docs: that of the least doc_id, rows without one last.

    Rows are told apart by doc_id and the hash of their text, so rows without doc_id, or that share it, are judged each by its
    own text. Of rows that repeat both, one stays.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("h"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "h"))
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    marked = stored(fingerprints(hashed, "h"), "fingerprints")
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h")
    of_fp = _groups(marked, F.min(own))
    ours = F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.h") == F.col("h"))
    judged = marked.groupBy("doc_id", "h", "fp").agg(F.count("*").alias("n"))
    judged = judged.join(of_fp, F.col("fp") == F.col("_fp")).select("doc_id", "h", ours.alias("first"), "n")
    # all rows that are not the one of their group, and those of it that are repeated
    odd = stored(
        judged.where("NOT first OR n > 1").select(
            F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.xxhash64("doc_id", "h").alias("_key"), "first"
        ),
        "near-duplicates-odd",
    )
    n = odd.count()
    if not n:
        return docs
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    clean = None
    if 2 * n <= MAX_FILTER_BYTES:  # 12 bits a row
        level = bloom(odd.select(F.col("_key").alias("key")).distinct(), n, 2**-8, 1, "odd-rows")
        maybe = level.has(F.col("key"))
        rows, clean = rows.where(maybe), rows.where(~maybe).select("row.*")
    left = rows.join(odd.select("_id", "_h"), same, "left_anti").select("row.*")
    left = left if clean is None else clean.unionByName(left)
    repeated = odd.where("first")
    if repeated.limit(1).count():
        once = rows.join(repeated.select("_id", "_h"), same, "left_semi").dropDuplicates(["doc_id", "h"])
        left = left.unionByName(once.select("row.*"))
    return left


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.format_string("%016x", "fp").alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict[str, str] = {}
