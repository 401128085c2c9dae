"""Reply trees: root-to-leaf paths by iterative self-joins, formatted as conversations.

Every round doubles the length of all jumps towards the root by joining them with
themselves, and the (leaf, ancestor) pairs found so far with the jumps; rounds grow with
the logarithm of the depth, rows with the total length of the paths. A round writes only the
pairs it adds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm.exchange import stored

START, ROLE_END, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of this and other common templates.
CONTROL = "([<\\[])(?=\\|im_(?:start|sep|end)\\|>|/?s>|/?INST\\])"


def escaped(text: Column) -> Column:
    """No control string is left: backslashes are doubled, one is put behind a control's first sign."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame) -> DataFrame:
    """``id``, ``leaf``, ``distance``: every message on the way from each leaf to its root.

    ``messages`` has ``id`` and ``parent`` (unique ids; a parent that is not there or null
    makes a root). Messages on or below a cycle have no root and give no path.
    """
    spark = messages.sparkSession
    ids = messages.select("id")
    jumps = stored(messages.select("id", "parent").join(ids.withColumnRenamed("id", "up"), F.col("parent") == F.col("up"), "left").select("id", "up"), "jumps")
    leaves = ids.join(jumps.filter("up IS NOT NULL").select(F.col("up").alias("id")), "id", "left_anti")
    pairs = stored(leaves.select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("distance")), "paths")
    step, count = 1, jumps.count()
    live = jumps.filter("up IS NOT NULL")
    while step < 2 * count and not live.isEmpty():
        further = pairs.join(live, "id").select("leaf", F.col("up").alias("id"), (F.col("distance") + step).alias("distance"))
        pairs = pairs.unionByName(stored(further, "paths"))
        ahead = live.select(F.col("id").alias("up"), F.col("up").alias("next"))
        live = stored(live.join(ahead, "up").select("id", F.col("next").alias("up")), "jumps")
        step *= 2
    if step < 2 * count:
        return pairs
    looped = live.select("id").distinct()  # jumps longer than all messages: a cycle
    return pairs.join(looped.withColumnRenamed("id", "leaf"), "leaf", "left_anti")


def format_trees(messages: DataFrame, keep: int = 1, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The ``keep`` best paths of each tree, each as one formatted conversation.

    ``messages``: tree, node, parent, role, text, score. A path's score is the mean of its
    messages' scores (null: 0); ties go to the smaller leaf. Result: tree, leaf, rank, score,
    formatted, loss (spans of code points of the learned roles' escaped texts). Null roles
    and texts are empty; a null tree is a tree; of repeated (tree, node) the least row
    counts. A conversation is one string by nature, so its turns meet in one task.
    """
    rows = messages.select(
        F.struct("tree", "node").alias("id"), F.struct("tree", "parent").alias("_p"), "tree",
        F.col("parent").isNotNull().alias("_has"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = rows.groupBy("id").agg(F.min(F.struct(F.when(F.col("_has"), F.struct(F.col("_p.tree"), F.col("_p.parent").alias("node"))).alias("parent"), "role", "text", "score")).alias("m")) \
        .select("id", "m.*")
    rows = stored(rows, "messages")
    found = paths(rows)
    best = found.join(rows.select("id", "score"), "id").groupBy("leaf").agg(F.avg("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    best = best.withColumn("tree", F.col("leaf.tree")).withColumn("rank", rank).filter(F.col("rank") <= keep)
    turns = found.join(best, "leaf").join(rows.select("id", "role", "text"), "id")
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(ROLE_END))
    turns = turns.select("leaf", "tree", "rank", "score", (-F.col("distance")).alias("at"), F.col("role").isin(*learned).alias("learned"),
                         head.alias("head"), escaped(F.col("text")).alias("body"))
    length = F.length("head") + F.length("body") + len(END)
    before = F.sum(length).over(Window.partitionBy("leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumn("start", F.coalesce(before, F.lit(0)) + F.length("head"))
    return turns.groupBy("leaf").agg(
        F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.first("score").alias("score"),
        F.sort_array(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(END)).alias("turn")))).alias("_turns"),
        F.sort_array(F.collect_list(F.when(F.col("learned"), F.struct("start", F.length("body").cast("long").alias("length"))))).alias("loss")) \
        .select("tree", F.col("leaf.node").alias("leaf"), "rank", "score",
                F.concat_ws("", F.col("_turns.turn")).alias("formatted"), "loss")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.filter(F.split(formatted, re.escape(END)), lambda t: t != "")

    def parsed(turn: Column) -> Column:
        at = F.instr(turn, ROLE_END)
        role = turn.substr(F.lit(len(START) + 1), at - len(START) - 1)
        text = turn.substr(at + len(ROLE_END), F.length(turn))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(turns, parsed)


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(loss, lambda s: unescaped(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: each row replies to the one before (by turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order)
    return conversations.select(
        F.col("conv_id").alias("tree"), node.alias("node"), F.when(node > 1, node - 1).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"))
