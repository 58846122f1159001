"""Exact quantiles, moments and unit counts of large groups.

``percentile`` and ``median`` gather all distinct values of a group in one task. Here a
single pass over the data reduces it to unit counts, one row per group, column and distinct
value, combined on the map side and stored in the shared folder. All that follows reads
those: extremes and exact sums of each group, then radix selection. The range between a
group's extremes is cut into equal buckets, whose counts show the bucket of each wanted
rank; that bucket is cut again; only the values of the last buckets are ranked one by one.
So buckets fit the data, wide or narrow, and a window never holds more than one group's or
one bucket's buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from repaylens.sources.files import stored

FAN_BITS = 12  # a bucket is cut into 4,096
LEVELS = 2


def require_digits(df: DataFrame, digits: Mapping[str, int]) -> None:
    """Refuse decimal columns with more places than ``digits`` says: they would be cut off."""
    for name, places in digits.items():
        kind = df.schema[name].dataType
        if isinstance(kind, DecimalType) and kind.scale > places:
            raise ValueError(f"{name} has {kind.scale} decimal places, more than {places}")


def unit_counts(df: DataFrame, by: Mapping[str, Sequence[str]], digits: Mapping[str, int]) -> DataFrame:
    """``(*by, column_name, v, n)``: rows per distinct value, in units of ``10 ** -digits``.

    ``by`` maps category columns to their labels; other labels and null values are left out.
    Counts of parts of the data add up to those of the whole.
    """
    require_digits(df, digits)
    entries = [
        F.struct(
            F.lit(name).alias("column_name"),
            (F.col(name).cast("decimal(24,4)") * 10**places).cast("bigint").alias("v"),
        )
        for name, places in digits.items()
    ]
    values = df.select(*by, F.inline(F.array(*entries)))
    for column, labels in by.items():
        values = values.filter(F.col(column).isin(list(labels)))
    return values.filter(F.col("v").isNotNull()).groupBy(*by, "column_name", "v").agg(F.count(F.lit(1)).alias("n"))


def group_extremes(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, total, whole, low, high)``: rows, exact sum in units, and extremes of each group."""
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.sum(F.col("v").cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)")).alias("whole"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
    )


def select_ranks(
    counts: DataFrame, groups: DataFrame, keys: Sequence[str], quantiles: Sequence[float], fan_bits: int = FAN_BITS
) -> tuple[DataFrame, DataFrame]:
    """Radix selection: ``(*keys, quantile, position, rank, before, start, width)`` and the values left.

    A target says that the value of ``rank`` lies among ``width`` units from ``start`` on,
    and ``before`` values of the group lie below. The values left are the unit counts in
    those stretches, with their ``start``.
    """
    last = (F.col("total") - 1).cast("double")
    wanted = F.array(
        *[
            F.struct(
                F.lit(q).alias("quantile"),
                (last * F.lit(q)).alias("position"),
                side(last * F.lit(q)).cast("bigint").alias("rank"),
            )
            for q in quantiles
            for side in (F.floor, F.ceil)
        ]
    )
    targets = groups.select(
        *keys,
        F.inline(F.array_distinct(wanted)),
        F.lit(0).cast("bigint").alias("before"),
        F.col("low").alias("start"),
        (F.col("high") - F.col("low") + 1).alias("width"),
    )
    left = counts.join(
        # one row per group of stated labels: the number is known before reading anything
        F.broadcast(groups.select(*keys, F.col("low").alias("start"), (F.col("high") - F.col("low") + 1).alias("width"))),
        list(keys),
    )
    for _ in range(LEVELS):
        narrow = F.shiftright(F.col("width") - 1, fan_bits) + 1
        left = left.withColumn("width", narrow).withColumn(
            "inner", F.col("start") + F.expr("(v - start) div width") * F.col("width")
        )
        stretch = Window.partitionBy(*keys, "start").orderBy("inner")
        buckets = (
            left.groupBy(*keys, "start", "inner")
            .agg(F.sum("n").alias("n"))
            .withColumn("offset", F.sum("n").over(stretch) - F.col("n"))
        )
        # at most two ranks per quantile, column and combination of stated labels
        targets = (
            buckets.join(F.broadcast(targets.withColumn("width", narrow)), [*keys, "start"])
            .withColumn("before", F.col("before") + F.col("offset"))
            .filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
            .drop("start", "offset", "n")
            .withColumnRenamed("inner", "start")
        )
        left = (
            left.drop("start")
            .withColumnRenamed("inner", "start")
            .join(F.broadcast(targets.select(*keys, "start").distinct()), [*keys, "start"], "left_semi")
        )
    return targets, left.drop("width")


def exact_quantiles(
    df: DataFrame,
    by: Mapping[str, Sequence[str]],
    digits: Mapping[str, int],
    quantiles: Sequence[float],
    fan_bits: int = FAN_BITS,
    moments: bool = False,
) -> DataFrame:
    """Linearly interpolated quantiles of decimal columns.

    ``by`` maps category columns to their labels, as for a pivot; other labels and
    null values are left out. ``digits`` maps each column to its number of decimal
    places. One row per group, column and quantile:
    ``*by, column_name, quantile, value``. ``moments`` adds ``n, sum, variance, low, high``
    of the group, where sum is exact.

    ``df`` is planned and read once, when this is called: its unit counts are stored.
    """
    keys = [*by, "column_name"]
    counts = stored(unit_counts(df, by, digits))
    groups = group_extremes(counts, keys)
    targets, left = select_ranks(counts, groups, keys, quantiles, fan_bits)
    stretch = [*keys, "start"]
    ranked = left.withColumn("offset", F.sum("n").over(Window.partitionBy(*stretch).orderBy("v")) - F.col("n"))
    place = F.col("before") + F.col("offset")
    found = ranked.join(F.broadcast(targets), stretch).filter((F.col("rank") >= place) & (F.col("rank") < place + F.col("n")))
    scale = _scale(digits)
    low, high = F.min("v").cast("double"), F.max("v").cast("double")
    part = F.max(F.col("position") - F.floor("position").cast("double"))
    out = found.groupBy(*keys, "quantile").agg((low + (high - low) * part).alias("value"))
    out = out.withColumn("value", F.col("value") / scale)
    return out.join(F.broadcast(_moments(counts, groups, keys, scale)), keys) if moments else out


def _scale(digits: Mapping[str, int]) -> Column:
    places = F.create_map(*[F.lit(x) for name, places in digits.items() for x in (name, 10.0**places)])
    return F.element_at(places, F.col("column_name"))


def _moments(counts: DataFrame, groups: DataFrame, keys: Sequence[str], scale: Column) -> DataFrame:
    """``(*keys, n, sum, variance, low, high)``; squares are taken of the distance from the mean."""
    mean = F.col("whole").cast("double") / F.col("total")
    away = F.col("v").cast("double") - F.col("mean")
    squares = (
        counts.join(F.broadcast(groups.select(*keys, mean.alias("mean"))), list(keys))
        .groupBy(*keys)
        .agg(F.sum(away * away * F.col("n")).alias("squares"))
    )
    n = F.col("total")
    return groups.join(F.broadcast(squares), list(keys)).select(
        *keys,
        n.alias("n"),
        (F.col("whole") / scale.cast("decimal(10,0)")).cast("decimal(38,6)").alias("sum"),
        F.when(n > 1, F.col("squares") / (n - 1) / scale / scale).alias("variance"),
        (F.col("low") / scale).alias("low"),
        (F.col("high") / scale).alias("high"),
    )
