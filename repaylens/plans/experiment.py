"""The message experiment, at account level."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repaylens.functions.columns import (
    mapped,
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
    attach_stages,
    first_touch,
    recovery_rate,
    experiment_message,
    with_client,
)
from repaylens.operators.distribution import share_of_total, unit_distribution
from repaylens.operators.experiment import (
    Proportion,
    mean_lifts,
    proportion_ztest,
    welch_ttest,
)
from repaylens.operators.quantiles import exact_quantiles
from repaylens.operators.reshape import metric_rows, to_long, to_wide
from repaylens.operators.rollup import rollup
from repaylens.results import known_result
from repaylens.schemas import BAND_ORDER, CONTROL, TEST_WINDOW, VARIANT
from repaylens.sources.files import Tables, stored

Window = tuple[date, date]
GROUP = "ab_test_group"
CLIENT_COLUMNS = ("client_type", "industry", "integration_type")

# Tested flags with their titles, and labels of the compared rates.
TESTED_FLAGS = {
    "link_opened_flag": "Link Open Rate",
    "payment_made_flag": "Payment Rate",
    "one_off_payment_flag": "One-off Payment Rate",
    "repayment_plan_created_flag": "Plan Setup Rate",
    "first_instalment_paid_flag": "First Instalment Paid Rate",
    "broken_plan_flag": "Broken Plan Rate",
}
RATE_LABELS = {
    "link_open_rate": "Link Open Rate",
    "payment_rate": "Payment Rate",
    "one_off_payment_rate": "One-off Payment Rate",
    "plan_setup_rate": "Plan Setup Rate",
    "first_instalment_paid_rate": "First Instalment Paid Rate",
}
LIFT_LABELS = {
    "Link Open Rate": "link_open_rate_point_lift",
    "Payment Rate": "payment_rate_point_lift",
    "One-off Payment Rate": "one_off_payment_rate_point_lift",
    "Plan Setup Rate": "plan_setup_rate_point_lift",
    "Avg Recovery Rate": "avg_recovery_rate_point_lift",
}

# name of a rate: the flag whose mean over accounts it is
GROUP_RATES = {
    "link_open_rate": "link_opened_flag",
    "identity_verification_rate": "identity_verified_flag",
    "balance_view_rate": "balance_viewed_flag",
    "payment_option_selection_rate": "payment_option_selected_flag",
    "payment_rate": "payment_made_flag",
    "one_off_payment_rate": "one_off_payment_flag",
    "plan_setup_rate": "repayment_plan_created_flag",
    "first_instalment_paid_rate": "first_instalment_paid_flag",
    "broken_plan_rate": "broken_plan_flag",
}


def experiment_accounts(t: Tables, window: Window = TEST_WINDOW) -> DataFrame:
    """One row per test account: its first message of the experiment."""
    return first_touch(
        t["communication_events"],
        [
            "client_id",
            "sent_date",
            GROUP,
            "message_tone",
            "delivered_flag",
            "opened_or_clicked_flag",
        ],
        where=experiment_message(window=window),
    )


def ab_population(t: Tables, window: Window = TEST_WINDOW) -> DataFrame:
    sizes = (
        experiment_accounts(t, window)
        .groupBy(GROUP, "message_tone")
        .agg(F.count("customer_id").alias("test_customers"))
    )
    return sizes.withColumn(
        "customer_share_percent", F.round(share_of_total("test_customers"), 2)
    ).orderBy(GROUP, F.asc_nulls_first("message_tone"))


def ab_customer_outcomes(
    t: Tables,
    window: Window = TEST_WINDOW,
    ordered: bool = False,
    client_columns: Sequence[str] = CLIENT_COLUMNS,
) -> DataFrame:
    """One row per test account with everything it did, in 33 columns.

    ``ordered`` sorts by group and account, as for an export. ``client_columns`` names
    the client attributes wanted; without any, clients are not looked up. If ``t`` holds
    this table, stored or exported before, it is read as it is, whatever the ``window``.
    """
    if "ab_customer_outcomes" in t:
        known = t["ab_customer_outcomes"]
        unwanted = set(CLIENT_COLUMNS) - set(client_columns)
        known = known.select(*[c for c in known.columns if c not in unwanted])
        return known.orderBy(GROUP, "customer_id") if ordered else known
    account_columns = [
        "portfolio_type",
        "debt_balance",
        "balance_band",
        "debt_age_days",
        "debt_age_band",
        "customer_age_band",
        "region",
        "vulnerability_flag",
        "account_status",
    ]
    engagement = [
        "link_opened",
        "identity_verified",
        "balance_viewed",
        "payment_option_selected",
    ]
    accounts = experiment_accounts(t, window).join(
        t["customers"].select("customer_id", *account_columns), "customer_id", "left"
    )
    accounts = attach_stages(accounts, t["journey_events"], engagement)
    accounts = attach_payments(accounts, t["payments"])
    accounts = attach_plans(accounts, t["repayment_plans"])
    out = with_client(accounts, t["clients"], client_columns).select(
        "customer_id",
        "client_id",
        *client_columns,
        *account_columns,
        F.col("sent_date").alias("sms_sent_date"),
        GROUP,
        "message_tone",
        "delivered_flag",
        F.coalesce("opened_or_clicked_flag", F.lit(0)).alias(
            "communication_opened_or_clicked_flag"
        ),
        *[f"{stage}_flag" for stage in engagement],
        "payment_made_flag",
        "one_off_payment_flag",
        "amount_collected",
        "avg_successful_payment_amount",
        "repayment_plan_created_flag",
        "first_instalment_paid_flag",
        "broken_plan_flag",
        F.col("affordability_completed_plan_flag").alias("affordability_completed_flag"),
        "max_missed_payment_count",
        recovery_rate().alias("customer_recovery_rate"),
    )
    return out.orderBy(GROUP, "customer_id") if ordered else out


def ab_view_check(t: Tables, window: Window = TEST_WINDOW) -> DataFrame:
    """Rows against distinct accounts: they must be equal."""
    return (
        rollup(ab_customer_outcomes(t, window), [GROUP], "customer_id")
        .select(
            GROUP, F.col("rows").alias("rows_in_view"), F.col("units").alias("distinct_customers")
        )
        .orderBy(GROUP)
    )


def _outcomes(t: Tables, window: Window, *client_columns: str) -> DataFrame:
    """Test accounts with the client attributes that an analysis uses, mostly none."""
    return ab_customer_outcomes(t, window, client_columns=client_columns)


def group_metrics() -> dict[str, Column]:
    """The metrics of a group of test accounts, on the columns of a rollup."""
    amount = "amount_collected"
    metrics: dict[str, Column] = {"test_customers": F.col("units")}
    for name, flag in GROUP_RATES.items():
        metrics[name] = pct(f"sum_{flag}", f"n_{flag}")
    metrics["total_amount_collected"] = rounded(f"sum_{amount}")
    metrics["avg_amount_collected_per_customer"] = rounded_ratio(
        f"sum_{amount}", f"n_{amount}"
    )
    metrics["avg_customer_recovery_rate"] = pct(
        "sum_customer_recovery_rate", "n_customer_recovery_rate"
    )
    return metrics


def group_summary(accounts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Chosen metrics of test accounts for every key."""
    metrics = group_metrics()
    measured = [f for f in GROUP_RATES.values() if f in accounts.columns]
    totals = rollup(
        accounts, keys, "customer_id", sums=[*measured, "amount_collected", "customer_recovery_rate"]
    )
    return totals.select(*keys, *[metrics[name].alias(name) for name in names])


def ab_core_performance(t: Tables, window: Window = TEST_WINDOW) -> DataFrame:
    return group_summary(
        _outcomes(t, window), [GROUP], list(group_metrics())
    ).orderBy(GROUP)


def _ab_by(t: Tables, key: str, window: Window, rates: list[str]) -> DataFrame:
    clients = [key] if key in CLIENT_COLUMNS else []
    names = ["test_customers", *rates, "total_amount_collected", "avg_customer_recovery_rate"]
    return group_summary(_outcomes(t, window, *clients), [key, GROUP], names).orderBy(
        *sort_keys([key]), GROUP
    )


def ab_by_balance_band(t: Tables, window: Window = TEST_WINDOW) -> DataFrame:
    rates = ["link_open_rate", "payment_rate", "one_off_payment_rate", "plan_setup_rate"]
    return _ab_by(t, "balance_band", window, rates)


def ab_by_client_type(t: Tables, window: Window = TEST_WINDOW) -> DataFrame:
    return _ab_by(t, "client_type", window, ["link_open_rate", "payment_rate", "plan_setup_rate"])


def ab_by_debt_age(t: Tables, window: Window = TEST_WINDOW) -> DataFrame:
    return _ab_by(t, "debt_age_band", window, ["link_open_rate", "payment_rate", "plan_setup_rate"])


def lift_summary(accounts: DataFrame) -> DataFrame:
    return mean_lifts(
        accounts,
        points={
            "link_open_rate_point_lift": "link_opened_flag",
            "payment_rate_point_lift": "payment_made_flag",
            "one_off_payment_rate_point_lift": "one_off_payment_flag",
            "plan_setup_rate_point_lift": "repayment_plan_created_flag",
            "avg_recovery_rate_point_lift": "customer_recovery_rate",
        },
        amounts={"avg_amount_collected_per_customer_lift": "amount_collected"},
    )


def ab_lift_summary(t: Tables, window: Window = TEST_WINDOW) -> DataFrame:
    return lift_summary(_outcomes(t, window))


def ab_group_sizes(t: Tables, window: Window = TEST_WINDOW) -> DataFrame:
    return unit_distribution(
        _outcomes(t, window),
        [GROUP],
        "customer_id",
        "customers",
        "customer_share_percent",
    ).orderBy(GROUP)


def ab_core_rates_long(t: Tables, window: Window = TEST_WINDOW) -> DataFrame:
    """Five rates with readable labels, one row per group and rate."""
    wide = known_result(t, "ab_core_performance")
    if wide is None:
        wide = group_summary(_outcomes(t, window), [GROUP], list(RATE_LABELS))
    long = to_long(wide, [GROUP], list(RATE_LABELS), "metric", "rate")
    return long.withColumn("metric_label", mapped("metric", RATE_LABELS))


def ab_lift_long(t: Tables, window: Window = TEST_WINDOW) -> DataFrame:
    known = known_result(t, "ab_lift_summary")
    return metric_rows(ab_lift_summary(t, window) if known is None else known, LIFT_LABELS, "point_lift")


def ab_ztests(t: Tables, window: Window = TEST_WINDOW) -> DataFrame:
    tests = [Proportion(column, title) for column, title in TESTED_FLAGS.items()]
    return proportion_ztest(_outcomes(t, window), tests)


def plan_tests_by_band(
    accounts: DataFrame, bands: Sequence[str] = BAND_ORDER["balance_band"]
) -> DataFrame:
    """Each balance band by itself; a band without accounts has null statistics."""
    tests = [
        Proportion("repayment_plan_created_flag", f"Plan Setup Rate - {band} Balance", band)
        for band in bands
    ]
    return proportion_ztest(accounts, tests, by="balance_band").drop(
        "control_successes", "control_total", "variant_successes", "variant_total"
    )


def ab_ztests_by_band(t: Tables, window: Window = TEST_WINDOW) -> DataFrame:
    """Plan set-up tested separately in each balance band."""
    return plan_tests_by_band(_outcomes(t, window))


def ab_amount_ttest(t: Tables, window: Window = TEST_WINDOW) -> DataFrame:
    return welch_ttest(
        _outcomes(t, window), "amount_collected", "Amount Collected per Customer"
    )


def amount_summary(accounts: DataFrame) -> DataFrame:
    """Mean and median amount, and the share of accounts that paid anything, per group."""
    # three columns of the accounts, which totals and medians then read: the base runs once
    grouped = stored(accounts.filter(F.col(GROUP).isNotNull()).select(GROUP, "customer_id", "amount_collected"))
    totals = rollup(
        grouped.withColumn("collected", (F.col("amount_collected") > 0).cast("int")),
        [GROUP],
        "customer_id",
        sums=["amount_collected", "collected"],
    ).select(
        GROUP,
        ratio("sum_amount_collected", "n_amount_collected").alias("avg_amount_collected"),
        F.col("units").alias("customers"),
        F.col("sum_collected").alias("customers_with_collection"),
    )
    groups = {GROUP: (CONTROL, VARIANT)}
    medians = exact_quantiles(grouped, groups, {"amount_collected": 2}, [0.5]).select(
        GROUP, F.col("value").alias("median_amount_collected")
    )
    return (
        totals.join(medians, GROUP, "left")
        .select(
            GROUP,
            "avg_amount_collected",
            "median_amount_collected",
            "customers",
            "customers_with_collection",
            percent("customers_with_collection", "customers").alias(
                "collection_customer_rate"
            ),
        )
        .orderBy(GROUP)
    )


def ab_amount_summary(t: Tables, window: Window = TEST_WINDOW) -> DataFrame:
    return amount_summary(_outcomes(t, window))


def ab_rate_pivot(t: Tables, rate: str, window: Window = TEST_WINDOW) -> DataFrame:
    """``plan_setup_rate`` or ``payment_rate``: a row per balance band, a column per group."""
    by_band = known_result(t, "ab_by_balance_band")
    if by_band is None:
        by_band = group_summary(_outcomes(t, window), ["balance_band", GROUP], [rate])
    return to_wide(by_band, "balance_band", GROUP, [CONTROL, VARIANT], rate).orderBy(
        *sort_keys(["balance_band"])
    )
