"""Sharding by Karmarkar-Karp differencing, for groups of equal texts that must stay together.

Differencing combines, again and again, the two partial partitions of largest spread in opposite order. It runs in tiers, from
heavy groups to light ones: up to TASK_GROUPS groups are differenced on the driver. Of more, those that are large beside a
task's share are a smaller set, which goes first, in the same way; the others are dealt by hash to tasks of about TASK_GROUPS each, and every
task differences its groups together with its part of the load that the heavier ones leave on the shards, so the light ones level
it. So every group is differenced for itself at any size of the corpus, and no task or driver holds more than a bounded number.
A group that is larger than a shard's share makes its shard the largest, as in any partition that keeps groups together.

Rows then look up their group's shard, and get gapless slots by counts of (shard, part), so that no task holds
a whole shard; rows of a hot group are dealt over all parts.

A null text has no bytes and groups with the empty one. Repeated rows, and rows with a null doc_id, are rows of their own of their
text's group. An empty table gives no rows. With fewer groups than shards some shards stay empty. Columns besides doc_id
and text are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import HOT_SHARE, lean, ship, stored, table

ship(__name__)

SHARDS = 16
#: Groups that a task (about) or the driver (at most) differences.
TASK_GROUPS = 20_000
#: Rows of a part of a shard, about, and the least number of parts.
PART_ROWS, LEAST_PARTS = 20_000, 64


def combine(partials: list[list[int]]) -> list[list[int]]:
    """For each partial partition (its subsets' sums) the subset of the whole that each of its subsets goes to.

    Largest differencing: the two of largest spread are merged, the largest subset of one with the smallest of the other.
    """
    if not partials:
        return []
    k = len(partials[0])
    heap, nodes = [], []  # a node: the two it is made of and, for each of its subsets, the place of the first one's
    for i, sums in enumerate(partials):
        order = sorted(range(k), key=lambda j, sums=sums: (-sums[j], j))
        ranked = [sums[j] for j in order]
        nodes.append(order)
        heap.append((ranked[-1] - ranked[0], i, ranked))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b), strict=True)]
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        ranked = [sums[x] for x in order]
        heapq.heappush(heap, (ranked[-1] - ranked[0], len(nodes), ranked))
        nodes.append((i, j, order))
    out: list[list[int]] = [[]] * len(partials)
    todo = [(heap[0][1], list(range(k)))]
    while todo:  # to[s]: where the node's subset s goes
        i, to = todo.pop()
        if i < len(partials):
            out[i] = [0] * k
            for s, j in enumerate(nodes[i]):
                out[i][j] = to[s]
            continue
        a, b, order = nodes[i]
        first, second = [0] * k, [0] * k
        for s, x in enumerate(order):
            first[x] = second[k - 1 - x] = to[s]
        todo += [(a, first), (b, second)]
    return out


def karmarkar_karp(sizes: dict, k: int) -> dict:
    """The shard (0 to k - 1) of each item: k-way largest differencing. sizes: item to size."""
    order = sorted(sizes, key=lambda x: (-sizes[x], str(x)))
    found = combine([[sizes[x], *[0] * (k - 1)] for x in order])
    return {x: to[0] for x, to in zip(order, found, strict=True)}


def _difference_groups(load: list[int]):
    """g, size -> g, shard of one task's groups. load: what its shards have already."""
    k = len(load)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [b for b in batches if b.num_rows]
        if not mine:
            return
        rows = pa.Table.from_batches(mine)
        items = sorted(zip(rows["size"].to_pylist(), rows["g"].to_pylist(), strict=True), reverse=True)
        to_load, *found = combine([load, *([size, *[0] * (k - 1)] for size, _ in items)])
        shard = {to: s for s, to in enumerate(to_load)}  # the shard whose load has gone to a subset
        of = pa.table({"g": pa.array([g for _, g in items], pa.int64()), "shard": pa.array([shard[to[0]] for to in found], pa.int32())})
        yield from of.to_batches(max_chunksize=10_000)

    return run


def shard_groups(groups: DataFrame, shards: int, task_groups: int = TASK_GROUPS) -> DataFrame:
    """g, shard of stored groups (g, size, each g once)."""
    spark = groups.sparkSession
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n <= task_groups:
        of = karmarkar_karp({r["g"]: r["size"] for r in groups.select("g", "size").collect()}, shards)  # at most task_groups
        return spark.createDataFrame(list(of.items()), "g long, shard int")
    pieces = -(-n // task_groups)
    limit = total / (pieces * shards * max(1, min(8, n // (2 * pieces * shards))))  # fewer than n / 2 are larger
    heavy = stored(groups.where(F.col("size") > limit).select("g", "size"), "shard-heavy")
    of_heavy = stored(shard_groups(heavy, shards, task_groups), "shard-of-heavy")
    load = [0] * shards
    for r in of_heavy.join(heavy, "g").groupBy("shard").agg(F.sum("size").alias("size")).collect():  # a row for each shard
        load[r["shard"]] = r["size"] // pieces
    light = groups.where(F.col("size") <= limit).select("g", "size").repartition(pieces, "g")
    return light.mapInArrow(lean(_difference_groups(load)), "g long, shard int").unionByName(of_heavy)


def assign_shards(docs: DataFrame, shards: int = SHARDS, task_groups: int = TASK_GROUPS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. Equal texts share a shard; sizes of shards are near equal."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("g"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    groups = stored(rows.groupBy("g").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "shard-groups")
    n = groups.agg(F.sum("n")).first()[0] or 0
    of = stored(shard_groups(groups.select("g", "size"), shards, task_groups), "shard-of")
    hot = F.broadcast(stored(groups.where(F.col("n") > max(1000, HOT_SHARE * n)).select("g"), "shard-hot"))  # fewer than 1 / HOT_SHARE
    hot_rows = rows.join(hot, "g", "left_semi").join(F.broadcast(of.join(hot, "g", "left_semi")), "g")
    cool_rows = rows.join(hot, "g", "left_anti").join(of, "g")
    parts = max(LEAST_PARTS, -(-n // (shards * PART_ROWS)))
    by = F.lit(parts)
    dealt = cool_rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "g"), by)).unionByName(
        hot_rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "g", "row"), by))
    )
    dealt = stored(dealt, "shard-dealt")
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "g", "row")))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(
        F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    counts = counts.select("shard", "part", before.alias("before"))
    return ranked.join(counts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op6_sharding": op6_sharding}
ORACLES: dict[str, str] = {}
