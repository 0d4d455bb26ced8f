"""Chat formatting over a prefix tree of conversations.

Conversations that share their first turns share the nodes of those turns: a node is a turn after a given beginning, named by
a hash of that beginning. Each node's text is emitted once, the tree depth-first. For that the distinct conversations are sorted by
their paths of names, by ranges over all machines; a node belongs to the first conversation through it, and stands behind those of
the conversations before and the nodes above it. So no task holds a whole tree however many conversations share its root, and work grows
with the turns, not with the square of a conversation's length.

A node has its place in the emitted text (start, length), the position id of its first character (the length of what
stands before it in a conversation), and attn: the intervals [start, stop) of its ancestors and of itself, adjoining ones
merged, which are what its characters may attend to (within itself up to the character). As a first child adjoins its parent, a node
has one interval more than its path has turns that are not first children, at most. Loss is on assistant texts. Units are code points;
a tokenizer may be run over each node's text.

The template: `<s>[INST] text [/INST]` for a user, ` text </s>` for an assistant, `<<role>>text<</>>` for other roles.
Backslash, <, >, [ and ] within texts and roles get a backslash, so no control string survives in a text, and
unescaping gives it back, whatever the length.

Null texts and roles are empty. Turns of a conversation are ordered by turn (null first), then role and text; repeated rows are
turns of their own. Rows without conv_id are one conversation. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import spread_join, stored, table

USER, ASSISTANT, OTHER = ("<s>[INST] ", " [/INST]"), (" ", " </s>"), ("<<", ">>", "<</>>")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, "([\\\\<>\\[\\]])", "\\\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def format_turn(role: Column, text: Column) -> Column:
    body = escape(text)
    return (
        F.when(role == "user", F.concat(F.lit(USER[0]), body, F.lit(USER[1])))
        .when(role == "assistant", F.concat(F.lit(ASSISTANT[0]), body, F.lit(ASSISTANT[1])))
        .otherwise(F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]), body, F.lit(OTHER[2])))
    )


def parse_turn(shown: Column) -> Column:
    """struct(role, text) of a formatted turn."""
    head = F.regexp_extract(shown, "(?s)^<<((?:[^\\\\>]++|\\\\.)*+)>>", 1)

    def inner(before: int, after: int) -> Column:
        return F.substring(shown, F.lit(before + 1), F.length(shown) - before - after)

    def made(role: Column, body: Column) -> Column:
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    other = F.substring(
        shown, F.length(head) + 5, F.length(shown) - F.length(head) - len("".join(OTHER))
    )
    return (
        F.when(shown.startswith(USER[0]), made(F.lit("user"), inner(len(USER[0]), len(USER[1]))))
        .when(shown.startswith(ASSISTANT[0]), made(F.lit("assistant"), inner(len(ASSISTANT[0]), len(ASSISTANT[1]))))
        .otherwise(made(unescape(head), other))
    )


def paths(rows: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) in order, names: the name of each turn's node."""
    text = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = F.array_sort(F.collect_list(text))
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))
    chained = F.aggregate(
        "turns",
        F.array().cast("array<string>"),
        lambda acc, t: F.concat(
            acc,
            F.array(
                F.md5(
                    F.encode(
                        F.concat(
                            F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")), F.lit(":"),
                            F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"],
                        ),
                        "UTF-8",
                    )
                )
            ),
        ),
    )
    return grouped.withColumn("names", chained)


def emit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The emitted nodes: name, parent, depth, start, length, position, attn, shown, loss_from, loss_to (within shown);
    and the conversations: conv_id, leaf (the name of its last turn's node), starts (of its turns' nodes, in order)."""
    found = stored(paths(rows).withColumn("leaf", F.element_at("names", -1)), "chat-paths")
    # distinct conversations in the order of their paths; the rank grows by part, and within a part
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tips = found.groupBy("leaf").agg(F.first("names").alias("names"), F.first("turns").alias("turns"))
    tips = tips.withColumn("path", F.array_join("names", "")).repartitionByRange(n, "path").sortWithinPartitions("path")
    tips = stored(tips.withColumn("rank", F.monotonically_increasing_id()).drop("path"), "chat-tips")
    turn = F.transform(
        "names",
        lambda x, i: F.struct(
            i.alias("depth"), x.alias("name"), F.when(i > 0, F.get("names", i - 1)).alias("parent"), F.get("turns", i).alias("t")
        ),
    )
    steps = stored(tips.select("rank", "leaf", F.explode(turn).alias("x")).select("rank", "leaf", "x.*"), "chat-steps")
    same = [F.first(c).alias(c) for c in ("depth", "parent", "t")]  # all equal
    nodes = steps.groupBy("name").agg(F.min("rank").alias("rank"), *same)
    shown = format_turn(F.col("t.role"), F.col("t.text"))
    nodes = nodes.select("name", "parent", "depth", "rank", F.col("t.role").alias("role"), shown.alias("shown"))
    nodes = stored(nodes.withColumn("length", F.length("shown").cast("long")), "chat-nodes")
    # places: what stands before the part, and within it
    part, upto = F.shiftright("rank", 33), (W.unboundedPreceding, -1)
    sized = nodes.select("name", "rank", "depth", "length", part.alias("part"))
    parts = sized.groupBy("part").agg(F.sum("length").alias("n"))  # one row for each part
    parts = parts.select(
        F.col("part").alias("_part"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(*upto)), F.lit(0)).alias("before")
    )
    ahead = F.coalesce(F.sum("length").over(W.partitionBy("part").orderBy("rank", "depth").rowsBetween(*upto)), F.lit(0))
    placed = sized.withColumn("ahead", ahead).join(F.broadcast(parts), F.col("part") == F.col("_part"))
    start = F.col("before") + F.col("ahead")
    placed = stored(
        placed.select("name", F.col("rank").alias("owner"), start.alias("start"), (start + F.col("length")).alias("stop")), "chat-placed"
    )
    # each distinct conversation's way: the places of its turns in order
    ways = spread_join(steps.select("rank", "leaf", "depth", "name"), placed, ["name"]).groupBy("rank", "leaf").agg(
        F.array_sort(F.collect_list(F.struct("depth", "start", "stop", "owner"))).alias("way")
    )
    shared = F.filter("way", lambda x: x["owner"] != F.col("rank"))  # owned by conversations before: the first ones
    span = "array<struct<start:bigint,stop:bigint>>"

    def merged(acc: Column, x: Column) -> Column:
        last = F.element_at(F.when(F.size(acc) > 0, acc), -1)
        alone = F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), x["stop"].alias("stop"))))
        return F.when(F.coalesce(last["stop"] == x["start"], F.lit(False)), longer).otherwise(F.concat(acc, alone)).cast(span)

    head = F.aggregate(shared, F.array().cast(span), merged)
    own = F.get("way", F.size(shared))["start"]
    ways = stored(
        ways.select("rank", "leaf", F.transform("way", lambda x: x["start"]).alias("starts"), head.alias("head"), own.alias("own")), "chat-ways"
    )
    heads = ways.select(F.col("rank").alias("_rank"), "head", "own")
    out = nodes.join(placed.select(F.col("name").alias("_name"), "start", "stop"), F.col("name") == F.col("_name"))
    out = out.join(heads, F.col("rank") == F.col("_rank"))
    attn = merged(F.col("head"), F.struct(F.col("own").alias("start"), F.col("stop").alias("stop")))
    before = F.aggregate("attn", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"]) - F.col("length")
    loss = F.col("role") == "assistant"
    out = out.withColumn("attn", attn).select(
        "name", "parent", "depth", "start", "length", before.alias("position"), "attn", "shown",
        F.when(loss, F.lit(len(ASSISTANT[0])).cast("long")).otherwise(0).alias("loss_from"),
        F.when(loss, F.col("length") - len(ASSISTANT[1])).otherwise(0).alias("loss_to"),
    )
    conversations = spread_join(found.select("conv_id", "leaf"), ways.select("leaf", "starts"), ["leaf"])
    return stored(out, "chat-emitted"), stored(conversations.select("conv_id", "leaf", "starts"), "chat-conversations")


def read_back(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (role, text, shown, loss), from the emitted nodes. Each distinct conversation is read once."""
    once = conversations.groupBy("leaf").agg(F.first("starts").alias("starts"))
    at = stored(once.select("leaf", F.posexplode("starts").alias("i", "start")), "chat-reads")
    said = spread_join(at, nodes.select("start", "shown", "loss_from", "loss_to"), ["start"])
    loss = F.substring("shown", F.col("loss_from").cast("int") + 1, (F.col("loss_to") - F.col("loss_from")).cast("int"))
    turn = F.struct(
        "i", parse_turn(F.col("shown")).alias("t"), "shown",
        F.when(F.col("loss_to") > F.col("loss_from"), unescape(loss)).otherwise("").alias("loss"),
    )
    whole = stored(said.groupBy("leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns")), "chat-read")
    return spread_join(conversations.select("conv_id", "leaf"), whole, ["leaf"]).select("conv_id", "turns")


def op9_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    found = read_back(*emit(rows.unionByName(more)))

    def joined(part) -> Column:
        return F.array_join(F.transform("turns", part), "")

    said = joined(lambda x: F.concat(x["t"]["role"], F.lit("\n"), x["t"]["text"], F.lit("\n")))
    loss = joined(lambda x: x["loss"])
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.length(joined(lambda x: x["shown"])).cast("long").alias("formatted_chars"),
    )


QUERIES = {"op9_chat_tree": op9_chat_tree}
ORACLES = {
    "op9_chat_tree": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 9 + length(regexp_replace(role, '([\\<>\[\]])', '\\\1', 'g')) END
           + length(text) + length(regexp_replace(text, '[^\\<>\[\]]', '', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id""",
}
