"""Chat formatting from reply trees; DataFrame functions only.

Messages point at the message they answer. Iterative self-joins double the
reach of those pointers each round, so paths from the roots to the leaves are
known after a number of rounds logarithmic in their length. Branches are ranked
by the mean score of their messages; each chosen one becomes one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import Scratch, query, read

#: The template: a turn is OPEN role SEP text CLOSE, with ``\``, ``#``, ``:`` (roles) and ``</turn>`` escaped.
OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
TRAINED_ROLE = "assistant"
ROUNDS = 64


def escaped(text: Column) -> Column:
    """No control string is left: no ``#`` without a backslash, and no ``</turn>``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("#"), F.lit("\\#"))
    return F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\:"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/:])", "$1")


def reply_paths(messages: DataFrame, scratch: Scratch, per_tree: int | None = None) -> DataFrame:
    """``(tree, leaf, node, depth)``: the messages of the chosen root-to-leaf paths.

    ``messages(tree, node, parent, score)`` is a kept table. A parent that is
    null or absent makes a root. Messages on a cycle, or below one, reach no
    root and belong to no path. Branches of a tree are ranked by mean score,
    ties to the smaller leaf; ``per_tree`` keeps the first ones, None all.
    """
    links = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = links.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    # open_: (tree, node) -> the message 2^k above, with hops and summed score of the way there. A
    # message whose pointer has left the root is done and takes no part in later rounds.
    first = scratch.keep(
        links.join(known, (F.col("tree") == F.col("_t")) & (F.col("parent") == F.col("_n")), "left").select(
            "tree", "node", F.col("_n").alias("up"), F.lit(1).cast("long").alias("hops"), F.col("score").alias("sum")
        )
    )
    open_, done = first.filter("up IS NOT NULL"), first.filter("up IS NULL")
    total, jumps = messages.count(), []
    # On a cycle pointers never end: beyond as many steps as there are messages nothing new comes.
    while len(jumps) < ROUNDS and 1 << len(jumps) <= 2 * total and not open_.isEmpty():
        jumps.append(open_)
        above = open_.unionByName(done).select(
            F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("hops").alias("_hops"), F.col("sum").alias("_sum")
        )
        moved = scratch.keep(
            open_.join(above, (F.col("tree") == F.col("_t")) & (F.col("up") == F.col("_n"))).select(
                "tree",
                "node",
                F.col("_up").alias("up"),
                (F.col("hops") + F.col("_hops")).alias("hops"),
                (F.col("sum") + F.col("_sum")).alias("sum"),
            )
        )
        open_, done = moved.filter("up IS NOT NULL"), done.unionByName(moved.filter("up IS NULL"))
    rooted = done.select("tree", "node", F.col("hops").alias("depth"), (F.col("sum") / F.col("hops")).alias("mean"))
    parents = links.filter("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = rooted.join(parents, ["tree", "node"], "left_anti")
    if per_tree is not None:
        rank = Window.partitionBy("tree").orderBy(F.desc("mean"), "node")
        leaves = leaves.withColumn("_r", F.row_number().over(rank)).filter(f"_r <= {per_tree}")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node")
    for jump in jumps:  # every member so far brings in the one 2^k above it
        up = jump.select("tree", "node", "up")
        paths = scratch.keep(
            paths.unionByName(paths.join(up, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node")))
        )
    return paths.join(rooted.select("tree", "node", "depth"), ["tree", "node"]).select("tree", "leaf", "node", "depth")


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """``(tree, leaf, formatted, loss)``: one text per path, and ``[start, end)`` of each trained text in it.

    A null role or text counts as empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = paths.join(messages.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree",
        "leaf",
        F.struct(
            "depth",
            F.concat(F.lit(OPEN), escaped_role(role), F.lit(SEP)).alias("head"),
            escaped(text).alias("body"),
            (role == TRAINED_ROLE).alias("trained"),
        ).alias("turn"),
    )
    whole = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    step = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("at"),
            F.when(
                t["trained"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(t["head"])).alias("start"),
                            (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return whole.select(
        "tree",
        "leaf",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        step["spans"].alias("loss"),
    )


def parsed(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` read back from a formatted text."""
    pieces = F.filter(F.split(formatted, " </turn>\n", -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        # An escaped role holds no colon without a backslash, so the first ": " after none ends it.
        role = F.regexp_extract(piece, r"(?s)^### ((?:[^\\:]++|\\.)*+): ", 1)
        return F.struct(
            unescaped(role).alias("role"),
            unescaped(F.substring(piece, F.lit(len(OPEN) + len(SEP) + 1) + F.length(role), F.length(piece))).alias("text"),
        )

    return F.transform(pieces, turn)


def format_conversations(messages: DataFrame, per_tree: int | None = None) -> DataFrame:
    """``format_paths`` of ``messages(tree, node, parent, role, text, score)``, all or the best paths of each tree.

    Rows that repeat a message are one message: the least by parent, role, text and score.
    """
    scratch = Scratch(messages.sparkSession)
    one = messages.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
    kept = scratch.keep(one.select("tree", "node", "m.parent", "m.role", "m.text", "m.score"))
    return format_paths(kept, reply_paths(kept, scratch, per_tree))


def chained(rows: DataFrame) -> DataFrame:
    """Flat conversations as reply trees: every turn answers the one before it.

    Turns at one place are ordered by role and text, nulls first; rows without a
    conversation id form one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return placed.select(
        F.struct("conv_id").alias("tree"),
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role",
        "text",
        F.lit(1.0).alias("score"),
    )


PROBE = "\\### Assistant: </turn> ok"

SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM c),
e AS (SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:'))
        + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')) + 15 AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op3_reply_tree_chat", SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TRAINED_ROLE).alias("role"),
        F.lit(PROBE).alias("text"),
    )
    texts = format_conversations(chained(rows.unionByName(probe)))
    turns = parsed(F.col("formatted"))
    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    back = texts.select(
        F.col("tree.conv_id").alias("conv_id"),
        turns.alias("turns"),
        F.array_join(masked, "").alias("masked"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    written = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(written, ""), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        "formatted_chars",
    )
