"""Comparison of two groups: lifts, proportion tests and a mean test.

Accounts are aggregated once; everything after that is arithmetic on one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repaylens.functions.columns import percent, quoted, ratio, rounded
from repaylens.functions.stats import normal_p_value, student_p_value
from repaylens.operators.accounts import ACCOUNT
from repaylens.operators.rollup import rollup
from repaylens.schemas import CONTROL, VARIANT

SIGNIFICANCE_LEVEL = 0.05


@dataclass(frozen=True)
class Proportion:
    """One test: a 0/1 column, a title, and optionally the segment it is limited to."""

    column: str
    title: str
    segment: str | None = None


def significance(p_value: str) -> Column:
    return F.expr(
        f"CASE WHEN {p_value} < {SIGNIFICANCE_LEVEL}D THEN 'Statistically significant'"
        " ELSE 'Not statistically significant' END AS significance"
    )


def direction(lift: str, control: str = CONTROL, variant: str = VARIANT) -> Column:
    return F.expr(
        f"CASE WHEN {lift} > 0 THEN {quoted(variant + ' higher')}"
        f" WHEN {lift} < 0 THEN {quoted(control + ' higher')}"
        " ELSE 'No difference' END AS direction"
    )


def proportion_ztest(
    accounts: DataFrame,
    tests: Sequence[Proportion],
    by: str | None = None,
    group: str = "ab_test_group",
    control: str = CONTROL,
    variant: str = VARIANT,
    unit: str = ACCOUNT,
    digits: int = 4,
) -> DataFrame:
    """Two-proportion z-tests with pooled variance, two-sided, variant minus control.

    ``by`` names the column the tests' segments refer to. Tests without accounts
    in a group, or without any variance, give null statistics.
    """
    columns = list(dict.fromkeys(t.column for t in tests))
    totals = rollup(accounts, [*([by] if by else []), group], unit, sums=columns)

    def of(test: Proportion, name: str, value: str) -> str:
        mine = f"{group} = {quoted(name)}"
        if test.segment is not None:
            mine += f" AND {by} = {quoted(test.segment)}"
        return f"cast(coalesce(sum(CASE WHEN {mine} THEN {value} END), 0) AS bigint)"

    rows = [
        f"""named_struct(
            'test_order', {order},
            'segment', {"cast(NULL AS string)" if t.segment is None else quoted(t.segment)},
            'metric', {quoted(t.title)},
            'control_successes', {of(t, control, f"sum_{t.column}")},
            'control_total', {of(t, control, "units")},
            'variant_successes', {of(t, variant, f"sum_{t.column}")},
            'variant_total', {of(t, variant, "units")})"""
        for order, t in enumerate(tests, start=1)
    ]
    counts = totals.agg(F.expr(f"array({', '.join(rows)}) AS tests")).selectExpr("inline(tests)")
    measured = (
        counts.select(
            "*",
            percent("control_successes", "control_total").alias("control_rate_percent"),
            percent("variant_successes", "variant_total").alias("variant_rate_percent"),
            ratio(
                "control_successes + variant_successes", "control_total + variant_total"
            ).alias("pooled"),
        )
        .selectExpr(
            "*",
            "variant_rate_percent - control_rate_percent AS lift_percentage_points",
            "sqrt(pooled * (1D - pooled) * (try_divide(1D, control_total)"
            " + try_divide(1D, variant_total))) AS standard_error",
        )
        .selectExpr(
            "*", "try_divide(lift_percentage_points / 100D, standard_error) AS z_statistic"
        )
        .withColumn("p_value", normal_p_value("z_statistic"))
    )
    return measured.orderBy("test_order").select(
        *([F.col("segment").alias(by)] if by else []),
        "metric",
        "control_successes",
        "control_total",
        rounded("control_rate_percent", digits).alias("control_rate_percent"),
        "variant_successes",
        "variant_total",
        rounded("variant_rate_percent", digits).alias("variant_rate_percent"),
        rounded("lift_percentage_points", digits).alias("lift_percentage_points"),
        rounded("z_statistic", digits).alias("z_statistic"),
        rounded("p_value", digits).alias("p_value"),
        significance("p_value"),
        direction("lift_percentage_points", control, variant),
    )


def welch_ttest(
    accounts: DataFrame,
    value: str,
    title: str,
    group: str = "ab_test_group",
    control: str = CONTROL,
    variant: str = VARIANT,
    digits: int = 4,
) -> DataFrame:
    """Welch's test of a mean, two-sided, variant minus control, without equal variances."""

    def stats(name: str, side: int) -> list[Column]:
        mine = f"CASE WHEN {group} = {quoted(name)} THEN {value} END"
        return [
            F.expr(f"count({mine}) AS n{side}"),
            ratio(f"sum({mine})", f"count({mine})").alias(f"m{side}"),
            F.expr(f"var_samp(cast({mine} AS double)) AS v{side}"),
        ]

    tested = (
        accounts.agg(*stats(control, 1), *stats(variant, 2))
        .selectExpr("*", "try_divide(v1, n1) AS e1", "try_divide(v2, n2) AS e2")
        .selectExpr(
            "m1",
            "m2",
            "try_divide(m2 - m1, sqrt(e1 + e2)) AS t",
            "try_divide((e1 + e2) * (e1 + e2), try_divide(e1 * e1, n1 - 1)"
            " + try_divide(e2 * e2, n2 - 1)) AS dof",
        )
        .withColumn("p", student_p_value("t", "dof"))
    )
    return tested.select(
        F.lit(title).alias("metric"),
        rounded("m1", digits).alias("control_avg_amount"),
        rounded("m2", digits).alias("variant_avg_amount"),
        rounded("m2 - m1", digits).alias("amount_lift"),
        rounded("t", digits).alias("t_statistic"),
        rounded("p", digits).alias("p_value"),
        significance("p"),
    )


def mean_lifts(
    accounts: DataFrame,
    points: dict[str, str],
    amounts: dict[str, str],
    group: str = "ab_test_group",
    control: str = CONTROL,
    variant: str = VARIANT,
    unit: str = ACCOUNT,
) -> DataFrame:
    """Differences of means in one row, variant minus control.

    ``points`` maps result names to columns whose lift is given in percentage
    points, ``amounts`` to columns whose lift is given in their own unit.
    """
    totals = rollup(accounts, [group], unit, sums=[*points.values(), *amounts.values()])

    def mean(name: str, column: str) -> str:
        quotient = f"try_divide(cast(sum_{column} AS double), cast(n_{column} AS double))"
        return f"max(CASE WHEN {group} = {quoted(name)} THEN {quotient} END)"

    def lift(column: str) -> str:
        return f"({mean(variant, column)} - {mean(control, column)})"

    return totals.agg(
        *[rounded(f"{lift(c)} * 100D").alias(name) for name, c in points.items()],
        *[rounded(lift(c)).alias(name) for name, c in amounts.items()],
    ).select(F.lit(f"{variant} vs {control}").alias("comparison"), "*")
