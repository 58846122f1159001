"""Recovery of balances and quality of repayment plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repaylens.functions.columns import (
    either_label,
    flag,
    pct,
    percent,
    ratio,
    rounded,
    rounded_ratio,
    sort_keys,
)
from repaylens.operators.accounts import (
    attach_payments,
    attach_plans,
    recovery_rate,
    with_client,
)
from repaylens.operators.distribution import describe, histogram
from repaylens.operators.reshape import metric_rows, to_wide
from repaylens.operators.rollup import rollup
from repaylens.results import known_result
from repaylens.schemas import BAND_ORDER, FAILED, REVERSED, SUCCESSFUL
from repaylens.sources.files import Tables

AFFORDABILITY_DONE, AFFORDABILITY_NOT_DONE = "Affordability Completed", "No Affordability Completed"

_FLAGS = (
    "payment_made_flag",
    "one_off_payment_flag",
    "repayment_plan_created_flag",
    "first_instalment_paid_flag",
    "broken_plan_flag",
)
_SUMS = ("debt_balance", "amount_collected")


def account_outcomes(t: Tables, accounts: DataFrame | None = None) -> DataFrame:
    """Accounts with their payment and plan totals.

    If ``t`` holds ``customer_recovery_summary``, stored or exported before, it is used.
    """
    if "customer_recovery_summary" in t:
        return t["customer_recovery_summary"].withColumnRenamed(
            "affordability_completed_flag", "affordability_completed_plan_flag"
        )
    base = t["customers"] if accounts is None else accounts
    return attach_plans(attach_payments(base, t["payments"]), t["repayment_plans"])


def recovery_metrics() -> dict[str, Column]:
    """Recovery of a segment, on the columns of a rollup. Rates are per account
    unless stated otherwise; broken plans are per account with a plan."""
    plans = "units_repayment_plan_created_flag"
    return {
        "total_customers": F.col("units"),
        "avg_debt_balance": rounded_ratio("sum_debt_balance", "n_debt_balance"),
        "total_outstanding_balance": rounded("sum_debt_balance"),
        "total_amount_collected": rounded("sum_amount_collected"),
        "recovery_rate": pct("sum_amount_collected", "sum_debt_balance"),
        "payment_conversion_rate": pct("units_payment_made_flag", "units"),
        "one_off_payment_rate": pct("units_one_off_payment_flag", "units"),
        "plan_setup_rate": pct(plans, "units"),
        "broken_plan_rate": pct("units_broken_plan_flag", plans),
    }


def segment_recovery(
    outcomes: DataFrame, keys: Sequence[str], names: Sequence[str], **extra: Column
) -> DataFrame:
    """Chosen recovery metrics of every segment."""
    sums = [*_SUMS, *(["debt_age_days"] if "debt_age_days" in outcomes.columns else [])]
    totals = rollup(outcomes, keys, "customer_id", flags=_FLAGS, sums=sums)
    metrics = recovery_metrics() | extra
    return totals.select(*keys, *[metrics[name].alias(name) for name in names])


def recovery_overall(t: Tables) -> DataFrame:
    """The portfolio in one row."""
    totals = rollup(account_outcomes(t), [], "customer_id", flags=_FLAGS, sums=_SUMS)
    rates = recovery_metrics()
    return totals.select(
        F.col("units").alias("total_customer_accounts"),
        rates["total_outstanding_balance"].alias("total_outstanding_balance"),
        rates["total_amount_collected"].alias("total_amount_collected"),
        rates["recovery_rate"].alias("overall_recovery_rate"),
        F.col("units_payment_made_flag").alias("customers_with_successful_payment"),
        rates["payment_conversion_rate"].alias("payment_conversion_rate"),
        F.col("units_one_off_payment_flag").alias("one_off_payment_customers"),
        rates["one_off_payment_rate"].alias("one_off_payment_rate"),
        F.col("units_repayment_plan_created_flag").alias("repayment_plan_customers"),
        rates["plan_setup_rate"].alias("plan_setup_rate"),
        F.col("units_first_instalment_paid_flag").alias("first_instalment_paid_customers"),
        F.col("units_broken_plan_flag").alias("broken_plan_customers"),
    )


def recovery_by_balance_band(t: Tables) -> DataFrame:
    return segment_recovery(
        account_outcomes(t), ["balance_band"], list(recovery_metrics())
    ).orderBy(*sort_keys(["balance_band"]))


_SEGMENT_METRICS = (
    "total_customers",
    "total_outstanding_balance",
    "total_amount_collected",
    "recovery_rate",
    "payment_conversion_rate",
    "plan_setup_rate",
    "broken_plan_rate",
)


def recovery_by_debt_age(t: Tables) -> DataFrame:
    age = rounded_ratio("sum_debt_age_days", "n_debt_age_days")
    names = ["total_customers", "avg_debt_age_days", *_SEGMENT_METRICS[1:]]
    return segment_recovery(
        account_outcomes(t), ["debt_age_band"], names, avg_debt_age_days=age
    ).orderBy(*sort_keys(["debt_age_band"]))


def recovery_by_client_type(t: Tables) -> DataFrame:
    if "customer_recovery_summary" in t:
        outcomes = account_outcomes(t)
    else:
        outcomes = account_outcomes(t, with_client(t["customers"], t["clients"], ["client_type"]))
    return segment_recovery(outcomes, ["client_type"], _SEGMENT_METRICS).orderBy(F.desc("recovery_rate"), F.asc_nulls_first("client_type"))


def payment_method_performance(t: Tables) -> DataFrame:
    """Attempts and results per payment method; an unknown method is a group."""

    def attempts(status: str) -> str:
        return f"count_if(payment_status = '{status}')"

    paid = f"CASE WHEN payment_status = '{SUCCESSFUL}' THEN payment_amount END"
    return (
        t["payments"]
        .groupBy("payment_method")
        .agg(
            F.expr("count(*) AS total_payment_attempts"),
            F.expr(f"{attempts(SUCCESSFUL)} AS successful_payments"),
            F.expr(f"{attempts(FAILED)} AS failed_payments"),
            F.expr(f"{attempts(REVERSED)} AS reversed_payments"),
            pct(attempts(SUCCESSFUL), "count(*)").alias("payment_success_rate"),
            rounded(f"coalesce(sum({paid}), 0BD)").alias("successful_amount_collected"),
            rounded_ratio(f"sum({paid})", f"count({paid})").alias("avg_successful_payment_amount"),
        )
        .orderBy(F.desc("successful_amount_collected"), F.asc_nulls_first("payment_method"))
    )


_PLAN_AMOUNTS = ("plan_amount", "instalment_amount", "plan_length_months", "missed_payment_count")


def segment_plans(
    plans: DataFrame, keys: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """Chosen plan metrics of every segment, counted in distinct plans."""
    marked = plans.withColumns(
        {
            "first_paid": flag(F.col("first_instalment_paid_flag") == 1),
            "broken": flag(F.col("plan_status") == "Broken"),
        }
    )
    totals = rollup(marked, keys, "plan_id", flags=["first_paid", "broken"], sums=_PLAN_AMOUNTS)
    metrics: dict[str, Column] = {
        "total_repayment_plans": F.col("units"),
        "first_instalment_paid_plans": F.col("units_first_paid"),
        "first_instalment_paid_rate": pct("units_first_paid", "units"),
        "broken_plans": F.col("units_broken"),
        "broken_plan_rate": pct("units_broken", "units"),
    }
    for column in _PLAN_AMOUNTS:
        metrics[f"avg_{column}"] = rounded_ratio(f"sum_{column}", f"n_{column}")
    return totals.select(*keys, *[metrics[name].alias(name) for name in names])


def plan_sustainability(t: Tables) -> DataFrame:
    names = [
        "total_repayment_plans",
        "first_instalment_paid_plans",
        "first_instalment_paid_rate",
        "broken_plans",
        "broken_plan_rate",
        "avg_plan_amount",
        "avg_instalment_amount",
        "avg_plan_length_months",
        "avg_missed_payment_count",
    ]
    return segment_plans(t["repayment_plans"], [], names)


def plan_by_balance_band(t: Tables) -> DataFrame:
    names = [
        "total_repayment_plans",
        "avg_plan_amount",
        "avg_instalment_amount",
        "avg_plan_length_months",
        "first_instalment_paid_rate",
        "broken_plan_rate",
        "avg_missed_payment_count",
    ]
    bands = t["customers"].select("customer_id", "balance_band")
    plans = t["repayment_plans"].join(bands, "customer_id", "left")
    return segment_plans(plans, ["balance_band"], names).orderBy(*sort_keys(["balance_band"]))


def affordability_status(column: str = "affordability_completed_flag") -> Column:
    return either_label(F.col(column) == 1, AFFORDABILITY_DONE, AFFORDABILITY_NOT_DONE)


def plan_by_affordability(t: Tables) -> DataFrame:
    names = [
        "total_repayment_plans",
        "first_instalment_paid_rate",
        "broken_plan_rate",
        "avg_missed_payment_count",
        "avg_plan_amount",
        "avg_instalment_amount",
    ]
    plans = t["repayment_plans"].withColumn("affordability_status", affordability_status())
    return segment_plans(plans, ["affordability_status"], names).orderBy("affordability_status")


SEGMENT = ("balance_band", "debt_age_band")


def recovery_priority_segments(t: Tables, ordered: bool = True) -> DataFrame:
    """Balance band by debt age, weakest recovery first."""
    segments = known_result(t, "recovery_priority_segments")
    if segments is None:
        segments = segment_recovery(account_outcomes(t), SEGMENT, _SEGMENT_METRICS)
    if not ordered:
        return segments
    return segments.orderBy(F.asc_nulls_first("recovery_rate"), *sort_keys(SEGMENT))


def customer_recovery_summary(
    t: Tables,
    ordered: bool = False,
    client_columns: Sequence[str] = ("client_type", "industry", "integration_type"),
) -> DataFrame:
    """One row per account, in 24 columns. ``ordered`` sorts by account, as for an export.

    Without ``client_columns`` clients are not looked up. If ``t`` holds this table, it is
    read as it is.
    """
    if "customer_recovery_summary" in t:
        known = t["customer_recovery_summary"]
        return known.orderBy("customer_id") if ordered else known
    out = with_client(account_outcomes(t), t["clients"], client_columns).select(
        "customer_id",
        "client_id",
        *client_columns,
        "portfolio_type",
        "debt_balance",
        "balance_band",
        "debt_age_days",
        "debt_age_band",
        "customer_age_band",
        "region",
        "vulnerability_flag",
        "preferred_contact_channel",
        "account_status",
        "payment_made_flag",
        "one_off_payment_flag",
        "amount_collected",
        "repayment_plan_created_flag",
        "first_instalment_paid_flag",
        "broken_plan_flag",
        F.col("affordability_completed_plan_flag").alias("affordability_completed_flag"),
        "max_missed_payment_count",
        recovery_rate().alias("customer_recovery_rate"),
    )
    return out.orderBy("customer_id") if ordered else out


def recovery_baseline_long(t: Tables) -> DataFrame:
    """Ten portfolio figures as metric and value."""
    totals = rollup(account_outcomes(t), [], "customer_id", flags=_FLAGS, sums=_SUMS)
    accounts, plans = "units", "units_repayment_plan_created_flag"
    paying, broken = "units_payment_made_flag", "units_broken_plan_flag"
    owed, collected = "sum_debt_balance", "sum_amount_collected"
    return metric_rows(
        totals,
        {
            "Total Customer Accounts": accounts,
            "Total Outstanding Balance": owed,
            "Total Amount Collected": collected,
            "Overall Recovery Rate": percent(collected, owed),
            "Customers with Successful Payment": paying,
            "Payment Conversion Rate": percent(paying, accounts),
            "Customers with Repayment Plan": plans,
            "Plan Setup Rate": percent(plans, accounts),
            "Broken Plan Customers": broken,
            "Broken Plan Rate Among Plans": percent(broken, plans),
        },
    )


def weakest(segments: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` segments of lowest recovery, labelled ``balance | age``; a missing part
    reads ``nan``."""
    return (
        segments.orderBy(F.asc_nulls_last("recovery_rate"), *sort_keys(SEGMENT))
        .limit(k)
        .withColumn(
            "segment", F.expr(" || ' | ' || ".join(f"coalesce({key}, 'nan')" for key in SEGMENT))
        )
    )


def weakest_segments(t: Tables) -> DataFrame:
    return weakest(recovery_priority_segments(t, ordered=False))


def recovery_matrix(t: Tables) -> DataFrame:
    """Recovery rate with balance bands down and debt ages across.

    Rates of debt ages outside the list stand in ``other_debt_ages``, as JSON by label; it is
    null in a row without any. Nothing runs before the result is used.
    """
    wide = to_wide(
        recovery_priority_segments(t, ordered=False),
        "balance_band",
        "debt_age_band",
        BAND_ORDER["debt_age_band"],
        "recovery_rate",
        rest="other_debt_ages",
    )
    return wide.withColumn("other_debt_ages", F.to_json("other_debt_ages")).orderBy(*sort_keys(["balance_band"]))


def matrix(segments: DataFrame) -> DataFrame:
    """The same of segments at hand, with a column for each debt age they hold."""
    return to_wide(
        segments, "balance_band", "debt_age_band", BAND_ORDER["debt_age_band"], "recovery_rate", all_labels=True
    ).orderBy(*sort_keys(["balance_band"]))


def high_exposure(segments: DataFrame) -> DataFrame:
    """Segments that owe at least the median and recover at most the median."""
    everything = Window.partitionBy()  # over the few segments, not over accounts
    owed = F.col("total_outstanding_balance")
    return (
        segments.withColumns(
            {
                "owed_median": F.median(owed.cast("double")).over(everything),
                "rate_median": F.median("recovery_rate").over(everything),
            }
        )
        .filter((owed >= F.col("owed_median")) & (F.col("recovery_rate") <= F.col("rate_median")))
        .drop("owed_median", "rate_median")
        .orderBy(F.desc("total_outstanding_balance"), "recovery_rate", *sort_keys(SEGMENT))
    )


def high_exposure_low_recovery(t: Tables) -> DataFrame:
    return high_exposure(recovery_priority_segments(t, ordered=False))


def recovery_describe(t: Tables) -> DataFrame:
    return describe(
        customer_recovery_summary(t, client_columns=()),
        {"debt_balance": 2, "amount_collected": 2, "customer_recovery_rate": 4},
    )


def balance_histogram(t: Tables) -> DataFrame:
    return histogram(t["customers"], "debt_balance")


def collected_histogram(t: Tables) -> DataFrame:
    """Amounts of the accounts that paid anything."""
    if "customer_recovery_summary" in t:
        paying = t["customer_recovery_summary"]
    else:
        paying = attach_payments(t["customers"].select("customer_id"), t["payments"])
    return histogram(paying.filter(F.col("amount_collected") > 0), "amount_collected")


def payment_plan_status(t: Tables) -> DataFrame:
    """Accounts with a payment, a plan, both or neither."""
    keys = ["payment_made_flag", "repayment_plan_created_flag"]
    totals = rollup(
        customer_recovery_summary(t, client_columns=()),
        keys,
        "customer_id",
        sums=[*_SUMS, "customer_recovery_rate"],
    )

    def mean(column: str) -> Column:
        return ratio(f"sum_{column}", f"n_{column}")

    payment, plan = (F.col(k) == 1 for k in keys)
    label = (
        F.when(payment & plan, "Payment + Plan")
        .when(payment, "Payment Only")
        .when(plan, "Plan Only")
        .otherwise("No Payment or Plan")
    )
    return totals.select(
        *keys,
        F.col("units").alias("customers"),
        mean("debt_balance").alias("avg_debt_balance"),
        mean("amount_collected").alias("avg_amount_collected"),
        mean("customer_recovery_rate").alias("avg_customer_recovery_rate"),
        label.alias("customer_status"),
    ).orderBy(*keys)
