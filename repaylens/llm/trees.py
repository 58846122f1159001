"""Reply trees as training conversations.

Messages point to the one they answer. Paths from root to leaf come from self-joins:
jump tables hold every node's ancestor at distance 1, 2, 4 and so on, and the paths
double with each join, so joins grow with the logarithm of the depth and rows with the
size of the result. Branches of a tree are ranked by the sum of their messages' scores;
each chosen one is formatted as a conversation.

Template: ``<|turn|>role\\ntext<|end|>\\n`` for each turn. A control string inside a text
gets a backslash after its first character, one more than it had; reading takes it away.

Defined results: a null text or role is empty; messages of a tree that agree in all
fields are turns of their own; a null tree id is a tree of its own; empty texts are
turns; other columns are ignored; an empty table gives no rows. A reply to a missing
message starts a tree of its own; a cycle of replies is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repaylens.llm.common import stored, table

# Control strings of the template and of common chat templates, after
# their first character.
CONTROL = r"(?=\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|/?s>|/?INST\])"
OPEN = r"([<\[])"
#: No path is longer; replies that go on beyond it form a cycle.
LONGEST = 1 << 32


def escaped(text: Column) -> Column:
    """``text`` without control strings."""
    return F.regexp_replace(text, OPEN + r"(\\*)" + CONTROL, r"$1$2\\")


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``."""
    return F.regexp_replace(text, OPEN + r"(\\*)\\" + CONTROL, r"$1$2")


def escaped_role(role: Column) -> Column:
    """A role on one line."""
    lines = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escaped(lines)


def unescaped_role(role: Column) -> Column:
    held = F.replace(unescaped(role), F.lit("\\\\"), F.lit("\0"))
    return F.replace(F.replace(held, F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))


def paths(messages: DataFrame) -> DataFrame:
    """``(tree, leaf, node, up)`` of ``messages(tree, node, parent)``: every leaf's path, ``up`` steps from it."""
    known = messages.select("tree", "node")
    links = (
        messages.where("parent IS NOT NULL")
        .select("tree", "node", "parent")
        .alias("m")
        .join(known.alias("k"), F.expr("m.tree <=> k.tree AND m.parent = k.node"), "left_semi")
    )
    jumps = stored(links.select("tree", "node", F.col("parent").alias("above")))
    leaves = known.alias("k").join(
        jumps.alias("j"), F.expr("k.tree <=> j.tree AND k.node = j.above"), "left_anti"
    )
    rows = stored(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    reach = 1
    while not jumps.isEmpty():
        if reach > LONGEST:
            raise ValueError("replies form a cycle")
        further = rows.alias("r").join(jumps.alias("j"), F.expr("r.tree <=> j.tree AND r.node = j.node")).select(
            "r.tree", "r.leaf", F.col("j.above").alias("node"), (F.col("up") + reach).alias("up")
        )
        rows = stored(rows.unionByName(further))
        jumps = stored(
            jumps.alias("a")
            .join(jumps.alias("b"), F.expr("a.tree <=> b.tree AND a.above = b.node"))
            .select("a.tree", "a.node", "b.above")
        )
        reach *= 2
    return rows


def conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """One row per chosen branch: ``(tree, leaf, rank, score, formatted, loss)``.

    ``messages`` has tree, node, parent, role, text and score. ``best`` keeps that many
    branches of a tree, None keeps all. ``loss`` lists the spans of assistant texts in
    ``formatted`` as (start, length), in code points from 0.
    """
    way = paths(messages)
    scored = way.alias("w").join(
        messages.alias("m"), F.expr("w.tree <=> m.tree AND w.node = m.node")
    ).select("w.tree", "w.leaf", "w.up", "m.role", "m.text", "m.score")
    branches = scored.groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    ranked = branches.withColumn(
        "rank", F.expr("row_number() OVER (PARTITION BY tree ORDER BY score DESC NULLS LAST, leaf)")
    )
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    role = F.coalesce("role", F.lit(""))
    turn_head = F.concat(F.lit("<|turn|>"), escaped_role(role), F.lit("\n"))
    turns = scored.select(
        "tree", "leaf", "up", (role == "assistant").alias("learn"),
        turn_head.alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"),
    ).withColumn("size", F.length("head") + F.length("body") + F.length(F.lit("<|end|>\n")))
    start = F.expr(
        "coalesce(sum(size) OVER (PARTITION BY tree, leaf ORDER BY up DESC"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head)"
    )
    formatted = (
        turns.withColumn("start", start)
        .groupBy("tree", "leaf")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "learn", "head", "body", "start"))).alias("t"))
        .select(
            "tree", "leaf",
            F.expr("array_join(transform(t, x -> concat(x.head, x.body, '<|end|>\n')), '')").alias("formatted"),
            F.expr("transform(filter(t, x -> x.learn), x -> struct(x.start AS start, length(x.body) AS length))").alias("loss"),
        )
    )
    return ranked.alias("b").join(formatted.alias("f"), F.expr("b.tree <=> f.tree AND b.leaf = f.leaf")).select(
        "b.tree", "b.leaf", "b.rank", "b.score", "f.formatted", "f.loss"
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.regexp_replace(p, r"^<\|turn\|>", ""))
    return F.transform(
        turns,
        lambda p: F.struct(
            unescaped_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescaped(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
        ),
    )


def as_replies(turns: DataFrame) -> DataFrame:
    """A table of turns as trees in which each turn answers the one before."""
    numbered = turns.select(
        F.col("conv_id").alias("tree"), "role", "text",
        F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)").cast("long").alias("node"),
    )
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    say = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", say), (-7, 1, "assistant", say)], "conv_id long, turn long, role string, text string"
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = conversations(stored(as_replies(given))).withColumn("turns", read_turns(F.col("formatted")))
    spoken = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = F.array_join(
        F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), ""
    )
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        digest(spoken).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        digest(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
