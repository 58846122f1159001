"""Wide to long and back, for result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_rows(one_row: DataFrame, metrics: Mapping[str, Column | str], value: str = "value") -> DataFrame:
    """One row per named metric, in the given order, from a one-row result."""
    rows = [
        F.struct(
            F.lit(order).alias("metric_order"),
            F.lit(name).alias("metric"),
            (F.col(c) if isinstance(c, str) else c).cast("double").alias(value),
        )
        for order, (name, c) in enumerate(metrics.items())
    ]
    return one_row.select(F.inline(F.array(*rows))).orderBy("metric_order").drop("metric_order")


def to_long(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str
) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def to_wide(
    df: DataFrame,
    index: str,
    column: str,
    labels: Sequence[str],
    value: str,
    prefix: str = "",
    all_labels: bool = False,
    rest: str | None = None,
) -> DataFrame:
    """One column per label. Stating the labels saves Spark a pass to find them.

    ``rest`` names a map column for labels outside the list, null as ``(null)``: it is null
    in rows without any, and nothing runs while planning. ``all_labels`` instead gives such
    labels columns of their own, in alphabetical order, null at the end; for result tables
    only, because the labels are looked up first.
    """
    names = list(labels)
    if all_labels:
        found = {row[0] for row in df.select(column).distinct().collect()}
        names += sorted(x for x in found - set(labels) if x is not None)
        if None in found:
            df = df.withColumn(column, F.coalesce(column, F.lit("(null)")))
            names.append("(null)")
    if rest is not None:
        return _with_rest(df, index, column, names, value, prefix, rest)
    wide = df.groupBy(index).pivot(column, names).agg(F.first(value))
    return wide.select(index, *[F.col(f"`{label}`").alias(prefix + label) for label in names])


def _with_rest(
    df: DataFrame, index: str, column: str, names: list[str], value: str, prefix: str, rest: str
) -> DataFrame:
    """Stated labels are masked values of one aggregate; the others travel as entries.

    One row per label is expected, as in a result table; of several the first by value counts.
    """
    label = F.coalesce(F.col(column), F.lit("(null)"))
    known = F.col(column).isin(names)
    cells = df.groupBy(index, column).agg(F.min(value).alias("cell"))
    entry = F.when(known, None).otherwise(F.struct(label.alias("label"), F.col("cell").alias("cell")))
    wide = cells.groupBy(index).agg(
        *[F.max(F.when(F.col(column) == name, F.col("cell"))).alias(prefix + name) for name in names],
        F.array_sort(F.collect_list(entry)).alias("entries"),  # one for each label of a row of the result
    )
    others = F.when(F.size("entries") > 0, F.map_from_entries("entries"))
    return wide.select(index, *[F.col(f"`{prefix + name}`") for name in names], others.alias(rest))
