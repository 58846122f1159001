"""Funnels of the digital journey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repaylens.functions.columns import month_of, pct, rounded_ratio, sort_keys
from repaylens.operators.accounts import (
    attach_plans,
    attach_stages,
    first_touch,
    flag_name,
    with_client,
)
from repaylens.operators.funnel import drop_off, percent_of_first, segment_funnel, stage_counts
from repaylens.results import known_result
from repaylens.schemas import AFFORDABILITY_STAGES, JOURNEY_STAGES
from repaylens.sources.files import Tables

CORE_RATES = ("link_open_rate", "payment_conversion_rate", "plan_setup_rate")
CORE_STAGES = (
    "invite_delivered",
    "link_opened",
    "identity_verified",
    "payment_option_selected",
    "payment_made",
    "repayment_plan_created",
)


def _overall_stages(t: Tables) -> DataFrame:
    accounts = attach_stages(t["customers"].select("customer_id"), t["journey_events"], JOURNEY_STAGES)
    labels = {flag_name(stage): label for stage, label in JOURNEY_STAGES.items()}
    return stage_counts(accounts, labels, everyone="Account Uploaded")


def overall_funnel(t: Tables) -> DataFrame:
    return percent_of_first(_overall_stages(t), "percent_of_uploaded_accounts")


def stage_drop_off(t: Tables) -> DataFrame:
    known = known_result(t, "overall_funnel")
    stages = _overall_stages(t) if known is None else known.select("stage_order", "funnel_stage", "customers")
    return drop_off(stages)


def affordability_funnel(t: Tables) -> DataFrame:
    """The optional affordability branch, compared with balance viewers."""
    accounts = attach_stages(
        t["customers"].select("customer_id"), t["journey_events"], AFFORDABILITY_STAGES
    )
    accounts = attach_plans(accounts, t["repayment_plans"], only=["first_instalment_paid_flag"])
    labels = {flag_name(stage): label for stage, label in AFFORDABILITY_STAGES.items()}
    labels["first_instalment_paid_flag"] = "First Instalment Paid"
    return percent_of_first(stage_counts(accounts, labels), "percent_of_balance_viewers")


def funnel_by_channel(t: Tables) -> DataFrame:
    """Accounts belong to the channel of their first message, or to none."""
    first = first_touch(t["communication_events"], ["channel"]).withColumnRenamed(
        "channel", "primary_channel"
    )
    stages = [s for s in JOURNEY_STAGES if s != "invite_sent"]
    accounts = t["customers"].select("customer_id").join(first, "customer_id", "left")
    accounts = attach_stages(accounts, t["journey_events"], stages)
    rates = ["link_open_rate", "verification_after_open_rate", *CORE_RATES[1:]]
    return segment_funnel(accounts, ["primary_channel"], stages, rates).orderBy(
        F.desc("total_customers"), F.asc_nulls_first("primary_channel")
    )


def _funnel_by(t: Tables, key: str, accounts: DataFrame, **options) -> DataFrame:
    stages = options.pop("stages", CORE_STAGES)
    flagged = attach_stages(accounts.select("customer_id", key), t["journey_events"], stages)
    return segment_funnel(flagged, [key], stages, CORE_RATES, **options)


def funnel_by_balance_band(t: Tables) -> DataFrame:
    return _funnel_by(t, "balance_band", t["customers"]).orderBy(*sort_keys(["balance_band"]))


def funnel_by_debt_age(t: Tables) -> DataFrame:
    return _funnel_by(t, "debt_age_band", t["customers"]).orderBy(*sort_keys(["debt_age_band"]))


def funnel_by_client_type(t: Tables) -> DataFrame:
    accounts = with_client(
        t["customers"].select("customer_id", "client_id"), t["clients"], ["client_type"]
    )
    return _funnel_by(t, "client_type", accounts).orderBy(
        F.desc("payment_conversion_rate"), F.asc_nulls_first("client_type")
    )


def monthly_funnel_trend(t: Tables) -> DataFrame:
    accounts = t["customers"].select(
        "customer_id", month_of("account_upload_date").alias("upload_month")
    )
    stages = [s for s in CORE_STAGES if s != "payment_option_selected"]
    return _funnel_by(
        t, "upload_month", accounts, stages=stages, total="uploaded_customers"
    ).orderBy(F.asc_nulls_first("upload_month"))


#: Steps whose duration is measured, from the first date of one event to that of the next.
STEPS = (
    ("invite_delivered", "link_opened"),
    ("link_opened", "identity_verified"),
    ("identity_verified", "payment_option_selected"),
    ("payment_option_selected", "payment_made"),
    ("invite_delivered", "payment_made"),
    ("invite_delivered", "repayment_plan_created"),
)


def _first_date(event: str) -> str:
    return f"first_{event}_date"


def journey_first_dates(t: Tables) -> DataFrame:
    """One row per account: first date of each core event and the days between them.

    Days are negative where the later step came first; null where either is missing.
    """
    accounts = attach_stages(
        t["customers"].select("customer_id", "account_upload_date"),
        t["journey_events"],
        [],
        {event: _first_date(event) for event in CORE_STAGES},
    )
    return accounts.select(
        "customer_id",
        *map(_first_date, CORE_STAGES),
        F.date_diff(_first_date("invite_delivered"), "account_upload_date").alias("days_upload_to_invite_delivered"),
        *[F.date_diff(_first_date(b), _first_date(a)).alias(f"days_{a}_to_{b}") for a, b in STEPS],
    )


def stage_intervals(t: Tables) -> DataFrame:
    """One row per step: accounts with both events, mean and median days, shares.

    Accounts are first counted by step and days, on the map side; median and shares come
    from those few counts. Shares are of accounts that took the step in that order.
    """
    steps = [
        F.struct(
            F.lit(order).alias("step_order"),
            F.lit(a).alias("from_event"),
            F.lit(b).alias("to_event"),
            F.col(f"days_{a}_to_{b}").alias("days"),
        )
        for order, (a, b) in enumerate(STEPS, start=1)
    ]
    counts = (
        journey_first_dates(t)
        .select(F.inline(F.array(*steps)))
        .groupBy("step_order", "from_event", "to_event", "days")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def among(condition: str) -> str:
        return f"coalesce(sum(CASE WHEN {condition} THEN n END), 0L)"

    return (
        counts.groupBy("step_order", "from_event", "to_event")
        .agg(
            F.expr(f"{among('days IS NOT NULL')} AS customers"),
            F.expr(f"{among('days < 0')} AS out_of_order_customers"),
            rounded_ratio("sum(CASE WHEN days >= 0 THEN days * n END)", among("days >= 0"), 2).alias("avg_days"),
            F.expr("percentile(CASE WHEN days >= 0 THEN days END, 0.5D, n) AS median_days"),
            pct(among("days = 0"), among("days >= 0")).alias("same_day_share"),
            pct(among("days BETWEEN 0 AND 7"), among("days >= 0")).alias("within_a_week_share"),
        )
        .orderBy("step_order")
    )
