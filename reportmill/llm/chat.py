"""Chat formatting of reply trees with built-in functions only.

Messages point to their parents. Ancestors at distance 1, 2, 4, ... come from iterative self-joins by pointer doubling; a
second round of joins, from far to near, gives each leaf every ancestor exactly once, so a path of any depth takes a
logarithm of its length in joins and as many rows as it has messages. A tree's paths are ranked by the sum of their
messages' scores (ties: smaller leaf), and each chosen path is one conversation.

Template, a turn: ``<|turn|>role<|text|>text<|end|>`` and a line feed. Inside roles and texts a control string (``<|``, ``<s>``,
``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``) gets a backslash after its first character, one that already has
backslashes there one more; taking one away undoes that. The loss mask is an array of code-point ranges, those of the
assistant's texts.

Null roles and texts are empty. Messages without a tree are one tree of their own. A parent that is not there makes a root. Repeated rows of conversations are turns of
their own; ties within a turn are ordered by role and text. Messages in a circle belong to no path. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, stored, table

#: What follows the first character of a control string.
_TAILS = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
_OPEN, _MIDDLE, _END = "<|turn|>", "<|text|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_TAILS}", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_TAILS}", "$1$2")


def _joinable(tree: str) -> Column:
    """The tree as an array, which is not null where the tree is, so that joins keep messages without one."""
    return F.array(tree)


def paths(messages: DataFrame) -> DataFrame:
    """tree, leaf, node, distance (from the leaf) for messages(tree, node, parent), nodes unique in their tree."""
    nodes = checkpointed(messages.select(_joinable("tree").alias("tree"), "node", "parent"))
    known = nodes.select("tree", F.col("node").alias("parent"))
    first = checkpointed(nodes.filter(F.col("parent").isNotNull()).join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up")))
    jumps, limit = [first], nodes.count()
    while not jumps[-1].isEmpty() and 1 << (len(jumps) - 1) <= limit:
        last = jumps[-1]
        jumps.append(checkpointed(last.join(last.select("tree", F.col("node").alias("up"), F.col("up").alias("top")), ["tree", "up"]).select("tree", "node", F.col("top").alias("up"))))
    leaves = nodes.join(first.select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti")
    out = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance"))
    for k in reversed(range(len(jumps) - 1)):
        further = out.join(jumps[k], ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("distance") + (1 << k)).alias("distance"))
        out = checkpointed(out.unionByName(further))
    return out.withColumn("tree", F.col("tree")[0])


def format_turns(turns: Column) -> tuple[Column, Column]:
    """Of array<struct<role, text>>: the formatted string, and the loss mask as array<struct<start, length>>."""
    parts = F.transform(turns, lambda t: F.struct(F.concat(F.lit(_OPEN), escaped(t["role"]), F.lit(_MIDDLE)).alias("head"), escaped(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")))
    whole = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["text"], F.lit(_END))), "")
    empty = F.array().cast("array<struct<start:int,length:int>>")
    mask = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["text"]) + len(_END)).alias("at"),
            F.when(p["loss"], F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["text"]).alias("length"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return whole, mask


def parsed(formatted: Column) -> Column:
    """The turns of a formatted string, unescaped."""
    each = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda t: t != "")
    return F.transform(each, lambda t: F.struct(unescaped(F.substring_index(F.substring(t, len(_OPEN) + 1, 1 << 30), _MIDDLE, 1)).alias("role"), unescaped(F.substring_index(t, _MIDDLE, -1)).alias("text")))


def chosen_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """tree, leaf, score, rank, formatted, mask of the best paths of each tree (all without a number).

    messages(tree, node, parent, role, text, score); a path is one row in the end, so it has to fit in one.
    """
    own = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    of_tree = lambda df: df.withColumn("tree", _joinable("tree"))
    on_path = of_tree(paths(own)).join(of_tree(own.drop("parent")), ["tree", "node"]).withColumn("tree", F.col("tree")[0])
    by_leaf = on_path.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("place"), "role", "text"))).alias("turns"))
    whole, mask = format_turns(F.col("turns"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    ranked = by_leaf.withColumn("rank", rank)
    return (ranked if best is None else ranked.filter(F.col("rank") <= best)).select("tree", "leaf", "score", "rank", whole.alias("formatted"), mask.alias("mask"))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees of one branch: each turn answers the one before."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    node = F.row_number().over(order).cast("long")
    return conversations.withColumn("node", node).select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{tried}'), (-7L, 1L, 'assistant', '{tried}') AS t(conv_id, turn, role, text)")
    every = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    out = stored(chosen_paths(conversation_messages(every)), "chats")
    turns = parsed(F.col("formatted"))
    loss = F.array_join(F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))), "")
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
