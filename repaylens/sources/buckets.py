"""Source tables stored in buckets by account.

All five tables with accounts share one number of buckets, so they are laid out alike:
aggregates by account and the star join of accounts need no exchange any more. The tables
belong to a database of the session catalog, in a folder of their own.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from repaylens.operators.accounts import ACCOUNT
from repaylens.schemas import SCHEMAS
from repaylens.session import shared_path
from repaylens.sources.files import Tables, read_catalog_tables


def store_in_buckets(t: Tables, buckets: int, database: str | None = None, folder: str | None = None) -> tuple[str, Tables]:
    """Write the source tables and return the database and its tables.

    Rows are dealt out by account first, so each bucket is one file, sorted by account. A
    hot account's rows share a bucket; analyses combine them on the map side while they
    read. ``database`` must not hold such tables yet; without one, a new name is taken.
    ``folder`` defaults to a new path in the shared folder. The tables are written side by
    side: the few long tasks of one stage leave no core idle while another table has work.
    """
    spark = next(iter(t.values())).sparkSession
    database = database or f"accounts_{uuid.uuid4().hex}"
    location = folder or shared_path(spark)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    frames = {name: t[name] for name in SCHEMAS}

    @inheritable_thread_target(spark)
    def write(name: str) -> None:
        df = frames[name]
        if ACCOUNT in df.columns:
            rows = df.repartition(buckets, ACCOUNT).write.bucketBy(buckets, ACCOUNT).sortBy(ACCOUNT)
        else:
            rows = df.write
        rows.format("parquet").saveAsTable(f"{database}.{name}")

    with ThreadPoolExecutor(len(frames)) as pool:
        list(pool.map(write, frames))
    return database, read_catalog_tables(spark, database)


def drop_buckets(spark: SparkSession, database: str) -> None:
    """Remove the database and its files."""
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
