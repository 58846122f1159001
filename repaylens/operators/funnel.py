"""Stage tables of a funnel and funnels by segment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repaylens.functions.columns import pct, percent
from repaylens.operators.accounts import ACCOUNT, flag_name
from repaylens.operators.rollup import rollup

# name of a rate: (stage counted, stage it is compared with)
SEGMENT_RATES = {
    "link_open_rate": ("link_opened", "invite_delivered"),
    "verification_after_open_rate": ("identity_verified", "link_opened"),
    "payment_conversion_rate": ("payment_made", "invite_delivered"),
    "plan_setup_rate": ("repayment_plan_created", "invite_delivered"),
}


def stage_counts(
    accounts: DataFrame,
    stages: Mapping[str, str],
    everyone: str | None = None,
    unit: str = ACCOUNT,
) -> DataFrame:
    """Distinct accounts per stage, in order: one pass, then one row per stage.

    ``stages`` maps flag columns to stage names. Stages need not be nested: an
    account counts at a stage whether or not it passed the earlier ones.
    ``everyone`` names a first stage that counts all accounts.
    """
    totals = rollup(accounts, [], unit, flags=stages)
    counts = [] if everyone is None else [(everyone, F.col("units"))]
    counts += [(label, F.col(f"units_{column}")) for column, label in stages.items()]
    rows = [
        F.struct(
            F.lit(order).alias("stage_order"),
            F.lit(label).alias("funnel_stage"),
            count.alias("customers"),
        )
        for order, (label, count) in enumerate(counts, start=1)
    ]
    return totals.select(F.inline(F.array(*rows)))


def percent_of_first(stage_table: DataFrame, name: str) -> DataFrame:
    """Compare every stage with the first one. For stage tables, not for account rows."""
    ordered = Window.orderBy("stage_order")
    return stage_table.withColumn(
        name, F.round(percent("customers", F.first("customers").over(ordered)), 2)
    ).orderBy("stage_order")


def drop_off(stage_table: DataFrame) -> DataFrame:
    """Conversion from and loss since the stage before; the first stage has neither."""
    ordered = Window.orderBy("stage_order")
    now, before = "customers", "previous_stage_customers"
    return (
        stage_table.withColumn(before, F.lag("customers", 1).over(ordered))
        .filter(F.col(before).isNotNull())
        .withColumns(
            {
                "stage_to_stage_conversion_percent": pct(now, before),
                "stage_drop_off_percent": pct(f"{before} - {now}", before),
            }
        )
        .orderBy("stage_order")
    )


def segment_funnel(
    accounts: DataFrame,
    keys: Sequence[str],
    stages: Sequence[str],
    rates: Sequence[str],
    total: str = "total_customers",
    unit: str = ACCOUNT,
) -> DataFrame:
    """Distinct accounts per stage and conversion rates for every segment."""
    counts = rollup(accounts, keys, unit, flags=[flag_name(s) for s in stages])

    def reached(stage: str) -> str:
        return f"units_{flag_name(stage)}"

    return counts.select(
        *keys,
        F.col("units").alias(total),
        *[F.col(reached(stage)).alias(f"{stage}_customers") for stage in stages],
        *[pct(reached(SEGMENT_RATES[r][0]), reached(SEGMENT_RATES[r][1])).alias(r) for r in rates],
    )
