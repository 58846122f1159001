"""Helpers that several operators use: reading, stored tables, salting, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repaylens.session import remove_path, shared_path
from repaylens.sources.files import stored_at

#: Members of a group that meet in one task when a group is salted.
SALT_ROWS = 256
#: Narrow rows that make a file of a table whose size is known beforehand.
FILE_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage: what reads it survives lost executors without recomputation. The
    shuffles behind it are removed; ``release`` removes the table itself. Where the caller
    knows that there are at most ``rows``, few rows go to few files.
    """
    out, path = stored_at(df if rows is None else df.coalesce(1 + rows // FILE_ROWS))
    out.stored_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove what ``stored`` wrote, once nothing reads it any more; other frames are left alone."""
    for df in tables:
        path = df.__dict__.pop("stored_path", None)
        if path is not None:
            remove_path(df.sparkSession, path)


def salts(rows: Column, per_salt: int = SALT_ROWS) -> Column:
    """Numbers 0 to n-1, n growing with the rows of a group: one copy of the group's side for each."""
    return F.sequence(F.lit(0), F.floor((rows - 1) / per_salt).cast("int"))


def salt(rows: Column, *by: Column, per_salt: int = SALT_ROWS) -> Column:
    """The one of ``salts(rows)`` that a member of a group falls into."""
    count = F.floor((rows - 1) / per_salt).cast("int") + 1
    return F.pmod(F.xxhash64(F.lit("salt"), *by), count).cast("int")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id of ``links(a, b)``: the smallest id that links reach.

    Alternates two rounds until nothing changes: every node links its larger neighbours
    to the smallest node it knows, then its smaller ones. The result is stored. Rounds grow with the logarithm
    of the longest chain. Aggregates combine on the map side; the smallest neighbours are
    stored before the join, so that Spark may split a node with very many links. Only a
    count and a sum a round reach the driver.
    """
    edges = stored(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = _print_of(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n = before[0]  # no table of a round has more than twice as many rows
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * n)
        large = stored(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n
        )
        release(edges, least)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), n)
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(least.select("u", F.col("m").alias("v")).unionByName(rest).distinct(), 2 * n)
        release(large, least)
        after = _print_of(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = stored(
        edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
            edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
        ),
        2 * before[0],
    )
    release(edges)
    return out


def _print_of(edges: DataFrame) -> tuple:
    """A number that changes when the set of edges does."""
    return tuple(
        edges.select(F.xxhash64("u", "v").cast("decimal(20,0)").alias("h"))
        .agg(F.count("*"), F.sum("h"))
        .first()
    )
