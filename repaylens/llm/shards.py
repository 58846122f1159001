"""Shards by a weighted hash tree of regions, racks and shards.

A row descends the tree. At each node every child draws ``-ln(u) / weight``, where ``u``
is a hash of the row's key and the child's name, and the smallest draw wins. A child's
share is its weight's. Draws of one child do not depend on its siblings: if a weight
grows, rows move only into that child's subtree; if it falls, only out of it.

New shards come as regions of their own, so no weight inside an older subtree changes
and rows move only into the new shard: the law is ``key``. For that a tree remembers how
many shards it was built with; those that came later are its grown regions.

Built-in functions only. Defined results: null text has no bytes; a null key is a key
of its own; rows that repeat a key share its shard and have slots of their own; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repaylens.llm.common import stored, table

#: Rows that are numbered by one sort.
SLOT_ROWS = 200_000


@dataclass(frozen=True)
class Node:
    """A part of the tree; ``shard`` is set on leaves only."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def topology(shards: int, built: int = 24, racks: int = 3, per_rack: int = 4) -> Node:
    """A tree of ``shards`` leaves: the first ``built`` in full regions, each later one a region of its own.

    Trees of one ``built`` keep the law while ``shards`` grows from there on, whatever it is.
    """
    regions: list[Node] = []
    size = racks * per_rack
    for start in range(0, min(shards, built), size):
        name = f"region-{start // size}"
        leaves = range(start, min(start + size, shards, built))
        stacks = []
        for r in range(0, len(leaves), per_rack):
            rack = f"{name}/rack-{r // per_rack}"
            own = tuple(Node(f"{rack}/shard-{s}", 1.0, shard=s) for s in leaves[r : r + per_rack])
            stacks.append(Node(rack, float(len(own)), own))
        regions.append(Node(name, sum(n.weight for n in stacks), tuple(stacks)))
    for s in range(built, shards):
        leaf = Node(f"grown-{s}/rack-0/shard-{s}", 1.0, shard=s)
        regions.append(Node(f"grown-{s}", 1.0, (Node(f"grown-{s}/rack-0", 1.0, (leaf,)),)))
    return Node("root", sum(n.weight for n in regions), tuple(regions))


def shard_of(key: Column, tree: Node) -> Column:
    """The number of the leaf that ``key`` descends to."""
    if tree.shard is not None:
        return F.lit(tree.shard)
    if len(tree.children) == 1:
        return shard_of(key, tree.children[0])
    draws = [_draw(key, child) for child in tree.children]
    least = F.least(*draws)
    out = shard_of(key, tree.children[-1])
    for draw, child in reversed(list(zip(draws[:-1], tree.children[:-1]))):
        out = F.when(draw == least, shard_of(key, child)).otherwise(out)
    return out


def _draw(key: Column, node: Node) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11).cast("double")
    return -F.log((bits + 0.5) / float(1 << 53)) / node.weight


def with_slots(rows: DataFrame, order: list[str], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """A gapless ``slot`` from 0 within each shard.

    Rows are numbered within buckets of a shard and moved on by the rows of the buckets
    before, so no task holds a whole shard.
    """
    buckets = max(1, math.ceil(rows.count() / slot_rows)) * 16
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit("slot"), *order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = counts.selectExpr(
        "shard", "bucket",
        "coalesce(sum(n) OVER (PARTITION BY shard ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start",
    )
    within = F.expr(f"row_number() OVER (PARTITION BY shard, bucket ORDER BY {', '.join(order)})")
    return (
        dealt.withColumn("within", within)
        .join(starts, ["shard", "bucket"])
        .withColumn("slot", F.col("start") + F.col("within") - 1)
        .drop("bucket", "within", "start")
    )


def shard(
    docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text", built: int | None = None
) -> DataFrame:
    """Every row's shard and slot, and its shard if there were one more.

    ``built`` is the number of shards that the tree was built with; by default all, up to 24.
    """
    built = min(shards, 24) if built is None else built
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id).alias("doc_id"),
        (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    placed = stored(
        rows.select(
            "*",
            F.lit("key").alias("law"),
            shard_of(F.col("doc_id"), topology(shards, built)).alias("shard"),
            shard_of(F.col("doc_id"), topology(shards + 1, built)).alias("grown_shard"),
        )
    )
    return with_slots(placed, ["doc_id", "size", "text_crc32"]).select(
        F.col("doc_id").alias(id), "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 24)
