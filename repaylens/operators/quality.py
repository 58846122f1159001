"""Checks of tables against their keys, dates, amounts and each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repaylens.functions.columns import percent, ratio


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """``UNION ALL`` by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def row_counts(frames: Mapping[str, DataFrame], name: str = "table_name") -> DataFrame:
    return stacked(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(table).alias(name), "row_count"
            )
            for table, df in frames.items()
        ]
    )


def table_shapes(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of every table."""
    return stacked(
        [
            df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(table).alias("table_name"), "rows", F.lit(len(df.columns)).alias("columns")
            )
            for table, df in frames.items()
        ]
    )


def preview(df: DataFrame, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows. With an order this is a top-k, without one any rows."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def date_ranges(frames: Mapping[str, DataFrame], columns: Mapping[str, str]) -> DataFrame:
    """First and last date of one date column per table."""
    return stacked(
        [
            frames[table]
            .agg(F.min(column).alias("min_date"), F.max(column).alias("max_date"))
            .select(
                F.lit(table).alias("table_name"),
                F.lit(column).alias("date_field"),
                "min_date",
                "max_date",
            )
            for table, column in columns.items()
        ]
    )


def numeric_range(df: DataFrame, column: str) -> DataFrame:
    """Smallest, largest and mean value in one row."""
    return df.agg(
        F.min(column).alias(f"min_{column}"),
        F.max(column).alias(f"max_{column}"),
        ratio(f"sum({column})", f"count({column})").alias(f"avg_{column}"),
    )


def count_where(df: DataFrame, condition: str, name: str) -> DataFrame:
    return df.agg(F.expr(f"count_if({condition}) AS {name}"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, null included."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("duplicate_count")).filter(
        F.col("duplicate_count") > 1
    )


def orphan_count(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Child rows whose key, or null key, has no parent row.

    Children are counted per key before they meet the parents, so a key with very
    many rows is one row in the join.
    """
    per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("child_rows"))
    unmatched = per_key.join(parent.select(key), key, "left_anti")
    return unmatched.agg(F.coalesce(F.sum("child_rows"), F.lit(0)).alias(name))


def missing_values(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Null count and percent of every column that has nulls; one pass per table."""
    parts = []
    for order, (table, df) in enumerate(frames.items()):
        nulls = df.agg(
            F.count(F.lit(1)).alias("table_rows"),
            *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
        )
        parts.append(
            nulls.unpivot("table_rows", df.columns, "column_name", "missing_values")
            .filter(F.col("missing_values") > 0)
            .select(
                F.lit(order).alias("table_order"),
                F.lit(table).alias("table_name"),
                "column_name",
                "missing_values",
                percent("missing_values", "table_rows").alias("missing_percent"),
            )
        )
    return (
        stacked(parts)
        .orderBy("table_order", F.desc("missing_percent"), "column_name")
        .drop("table_order")
    )
