"""Category shares, histograms and summary statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repaylens.functions.columns import percent, rounded_ratio
from repaylens.operators.quantiles import exact_quantiles, group_extremes, unit_counts
from repaylens.sources.files import stored


def share_of_total(count: str) -> Column:
    """Percent of the grand total, over an already aggregated table."""
    return percent(count, F.sum(count).over(Window.partitionBy()))


def row_distribution(df: DataFrame, column: str, count: str, share: str) -> DataFrame:
    """Rows and rounded share per category; null is a category."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(count))
    return counts.withColumn(share, F.round(share_of_total(count), 2)).orderBy(
        F.desc(count), F.asc_nulls_first(column)
    )


def unit_distribution(
    df: DataFrame, columns: Sequence[str], unit: str, count: str, share: str
) -> DataFrame:
    """Distinct units and share per category; rows without a category are left out."""
    known = df
    for column in columns:
        known = known.filter(F.col(column).isNotNull())
    counts = known.select(*columns, unit).distinct().groupBy(*columns).agg(
        F.count(unit).alias(count)
    )
    return counts.withColumn(share, share_of_total(count))


def histogram(df: DataFrame, column: str, bins: int = 40, digits: int = 2) -> DataFrame:
    """Rows in equal-width bins from the smallest to the largest value.

    The last bin includes its upper edge and empty bins are listed. If all values are
    equal, the range is widened by half a unit to both sides; without a value the bins
    have no edges.

    One pass: ``df`` is reduced to unit counts, in whole units of ``10 ** -digits``, which
    are stored; bins are formed on those, after the extremes are known. So ``df`` is planned
    and read once, when this is called, and no value falls beside its bin.
    """
    scale = 10**digits
    counts = stored(unit_counts(df, {}, {column: digits}))
    half = F.when(F.col("low") == F.col("high"), scale // 2 or 1).otherwise(0)
    edges = group_extremes(counts, ["column_name"]).select(
        "column_name", (F.col("low") - half).alias("low"), (F.col("high") + half).alias("high")
    )
    # edges are one row; unit counts are mergeable, so the join and the bins are one map-side pass
    position = F.try_divide((F.col("v") - F.col("low")) * bins, F.col("high") - F.col("low"))
    binned = (
        counts.join(F.broadcast(edges), "column_name")
        .groupBy(F.least(F.floor(position) + 1, F.lit(bins)).alias("bin"))
        .agg(F.sum("n").alias("row_count"), F.first("low").alias("low"), F.first("high").alias("high"))
    )
    spine = df.sparkSession.range(1, bins + 1, 1, 1).withColumnRenamed("id", "bin")
    whole = Window.partitionBy()  # over the bins
    low, high = F.max("low").over(whole), F.max("high").over(whole)
    width = (high - low).cast("double") / F.lit(float(bins))

    def edge(index: Column) -> Column:
        return (low.cast("double") + width * index.cast("double")) / F.lit(float(scale))

    return (
        spine.join(binned, "bin", "left")
        .select(
            F.col("bin").cast("int").alias("bin"),
            edge(F.col("bin") - 1).alias("bin_start"),
            edge(F.col("bin")).alias("bin_end"),
            F.coalesce("row_count", F.lit(0)).alias("row_count"),
        )
        .orderBy("bin")
    )


def describe(df: DataFrame, digits: dict[str, int], places: int = 4) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact quartiles of decimal columns.

    ``digits`` gives the decimal places of each column.
    """
    names = list(digits)
    found = (
        exact_quantiles(df, {}, digits, [0.25, 0.5, 0.75], moments=True)
        .groupBy("column_name")
        .agg(
            F.max("n").alias("value_count"),
            rounded_ratio("max(sum)", "max(n)", places).alias("mean"),
            F.round(F.sqrt(F.max("variance")), places).alias("std"),
            F.max("low").alias("min"),
            F.max("high").alias("max"),
            *[
                F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(name)
                for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
            ]
        )
    )
    spine = df.sparkSession.range(0, len(names), 1, 1).select(
        F.element_at(F.array(*map(F.lit, names)), F.col("id").cast("int") + 1).alias("column_name"), "id"
    )
    return (
        spine.join(found, "column_name", "left")
        .withColumn("value_count", F.coalesce("value_count", F.lit(0)))
        .orderBy("id")
        .select("column_name", "value_count", "mean", "std", "min", "p25", "p50", "p75", "max")
    )
