"""Chat formatting of reply trees.

Every message answers another or starts a tree.  Iterative self-joins, each twice as far as the one before,
list the messages on the way from each leaf to its root; the ways of a tree are ranked by score, and each
chosen one is formatted as a conversation with byte spans of the text to learn from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.llm.common import stored
from cellweft.session import work_folder

ASSISTANT = "assistant"
#: A turn is OPEN role CLOSE text END.  Texts and roles have no angle bracket once they are escaped.
OPEN, CLOSE, END = "<turn ", ">\n", "</turn>\n"
#: Each backslash of an escaped text starts one of these, so they can be undone one after the other.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def linear_tree(turns: DataFrame) -> DataFrame:
    """Messages in turn order as a tree with one branch: each answers the one before.

    Equal turns of a conversation are ordered by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nodes = turns.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return nodes.select(
        F.col("conv_id").alias("tree"),
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )


def _same(a: DataFrame, x: str, b: DataFrame, y: str) -> Column:
    return a["tree"].eqNullSafe(b["tree_"]) & (a[x] == b[y])


def branches(nodes: DataFrame) -> DataFrame:
    """tree, leaf, node, up: each message on the way from a leaf to its root, up steps above the leaf.

    A parent that does not exist makes its child a root.  Ways that run in a circle have no root and give no
    rows.  A node that stands twice in a tree must have been made one before.
    """
    links = nodes.select("tree", "node", "parent")
    known = links.select(F.col("tree").alias("tree_"), F.col("node").alias("node_"))
    real = links.filter("parent is not null")
    jump = real.join(known, _same(real, "parent", known, "node_"), "left_semi")
    jump = stored(jump.select("tree", "node", F.col("parent").alias("to")), "jump")
    answered = jump.select(F.col("tree").alias("tree_"), F.col("to").alias("node_"))
    way = links.join(answered, _same(links, "node", answered, "node_"), "left_anti")
    way = stored(way.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "way")
    roots = links.join(jump.withColumnRenamed("tree", "tree_").withColumnRenamed("node", "node_"), (links["tree"].eqNullSafe(F.col("tree_"))) & (links["node"] == F.col("node_")), "left_anti")
    roots = roots.select(F.col("tree").alias("tree_"), F.col("node").alias("root"))
    step, most = 1, links.count()
    while step <= most and not jump.isEmpty():
        far = jump.select(F.col("tree").alias("tree_"), F.col("node").alias("node_"), F.col("to").alias("to_"))
        further = way.join(far, _same(way, "node", far, "node_")).select("tree", "leaf", F.col("to_").alias("node"), (F.col("up") + step).alias("up"))
        way = stored(way.unionByName(further), f"way{step}")
        jump = stored(jump.join(far, _same(jump, "to", far, "node_")).select("tree", "node", F.col("to_").alias("to")), f"jump{step}")
        step *= 2
    ended = way.join(roots, _same(way, "node", roots, "root"), "left_semi").select(F.col("tree").alias("tree_"), F.col("leaf").alias("leaf_"))
    return way.join(ended, _same(way, "leaf", ended, "leaf_"), "left_semi")


def ranked(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """The messages of the best branches of each tree, with the branch's rank, from 1.

    A branch scores the mean of its messages; equal scores go by the leaf.  best=None keeps all branches.
    """
    way = branches(nodes)
    scores = nodes.select(F.col("tree").alias("tree_"), F.col("node").alias("node_"), "score", "role", "text")
    full = way.join(scores, _same(way, "node", scores, "node_")).drop("tree_", "node_")
    totals = full.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"), F.max("up").alias("top"))
    totals = totals.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")))
    if best is not None:
        totals = totals.filter(F.col("rank") <= best)
    totals = totals.withColumnsRenamed({"tree": "tree_", "leaf": "leaf_"})
    return full.join(totals, _same(full, "leaf", totals, "leaf_")).select("tree", "rank", (F.col("top") - F.col("up")).alias("depth"), "role", "text")


def formatted(messages: DataFrame) -> DataFrame:
    """tree, rank, formatted, loss: one row per branch; loss holds byte spans of the assistant's texts.

    A null text or role is empty; an empty assistant text has an empty span.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE))
    turns = messages.select("tree", "rank", "depth", (role == ASSISTANT).alias("learn"), head.alias("head"), escape(text).alias("body"))
    turns = turns.withColumn("bytes", F.octet_length("head").cast("long") + F.octet_length("body") + len(END))
    before = Window.partitionBy("tree", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.octet_length("head")
    turns = turns.withColumn("start", start).select(
        "tree",
        "rank",
        F.struct(
            "depth",
            F.concat("head", "body", F.lit(END)).alias("turn"),
            F.when(F.col("learn"), F.struct("start", (F.col("start") + F.octet_length("body")).alias("end"))).alias("span"),
        ).alias("t"),
    )
    rows = turns.groupBy("tree", "rank").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return rows.select("tree", "rank", F.array_join("t.turn", "").alias("formatted"), F.filter("t.span", lambda s: s.isNotNull()).alias("loss"))


STORED = "tree long, rank int, formatted binary, loss array<struct<start: bigint, end: bigint>>"


def read_back(spark, path: str) -> DataFrame:
    """What the written conversations say: turns from the formatted text, learnt text from the spans."""
    rows = spark.read.schema(STORED).parquet(path)  # bytes, as the spans count bytes
    opened = OPEN.removeprefix("<")
    pieces = F.filter(F.split(F.col("formatted").cast("string"), "<", -1), lambda p: p.startswith(opened))
    parts = F.transform(pieces, lambda p: F.struct(F.substring_index(p, CLOSE, 1).alias("role"), F.substr(p, F.char_length(F.substring_index(p, CLOSE, 1)) + len(CLOSE) + 1).alias("text")))
    said = F.transform(
        parts, lambda p: F.concat(unescape(F.substr(p["role"], F.lit(len(opened) + 1))), F.lit("\n"), unescape(p["text"]), F.lit("\n"))
    )
    learnt = F.transform(
        "loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string"))
    )
    read = rows.select("tree", "rank", F.char_length(F.col("formatted").cast("string")).cast("long").alias("formatted_chars"), said.alias("said"), F.array_join(learnt, "").alias("learnt"))
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(F.array_join("said", "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "rank",
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Digests of all conversations as they stand in the written output; see linear_tree and formatted.

    A null conv_id is a conversation of its own.  A conversation ends up in one row, so its text must fit a
    task; nothing else is gathered.  An empty table gives no rows; other columns are not read.
    """
    nodes = stored(linear_tree(turns), "nodes")
    path = f"{work_folder(turns.sparkSession)}/conversations"
    formatted(ranked(nodes, 1)).write.parquet(path)
    return read_back(turns.sparkSession, path)
