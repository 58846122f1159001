"""Segment totals with exact distinct counts.

``COUNT(DISTINCT CASE WHEN flag = 1 THEN account END)`` for many flags makes Spark
copy every row once per flag. Counting in two steps avoids that: first one row per
segment and account, then one row per segment. The first step combines on the map
side and is spread by account, so neither a segment nor an account that holds a
large part of the rows becomes one task's work.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(
    df: DataFrame,
    keys: Sequence[str],
    unit: str,
    flags: Iterable[str] = (),
    sums: Iterable[str] = (),
) -> DataFrame:
    """One row per key (one in all without keys). Null keys form their own group.

    ``units``        distinct non-null units
    ``rows``         rows
    ``units_<flag>`` distinct units with a row where the flag is 1
    ``sum_<col>``    sum over rows, ``n_<col>`` rows where the column is not null
    """
    flags, sums = list(flags), list(sums)
    per_unit = df.groupBy(*keys, unit).agg(
        F.expr("count(*) AS rows"),
        *[F.expr(f"max(`{c}`) AS `any_{c}`") for c in flags],
        *[F.expr(f"sum(`{c}`) AS `sum_{c}`") for c in sums],
        *[F.expr(f"count(`{c}`) AS `n_{c}`") for c in sums],
    )
    known = f"`{unit}` IS NOT NULL"
    return per_unit.groupBy(*keys).agg(
        F.expr(f"count(`{unit}`) AS units"),
        F.expr("sum(rows) AS rows"),
        *[F.expr(f"count_if({known} AND `any_{c}` = 1) AS `units_{c}`") for c in flags],
        *[F.expr(f"sum(`sum_{c}`) AS `sum_{c}`") for c in sums],
        *[F.expr(f"sum(`n_{c}`) AS `n_{c}`") for c in sums],
    )
