"""The reporting layer: one row per account, and the views built on it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repaylens.functions.columns import flag, month_of, pct, rounded
from repaylens.operators.accounts import (
    ACCOUNT,
    attach_payments,
    attach_plans,
    attach_stages,
    earliest,
    recovery_rate,
    experiment_message,
    with_client,
)
from repaylens.operators.funnel import segment_funnel
from repaylens.operators.quality import row_counts, stacked
from repaylens.operators.rollup import rollup
from repaylens.plans.experiment import ab_customer_outcomes, group_summary
from repaylens.plans.recovery import affordability_status, segment_recovery
from repaylens.schemas import CONTROL, TEST_WINDOW, VARIANT
from repaylens.sources.files import Tables, register_views, stored

Window = tuple[date, date]

CLIENT_COLUMNS = (
    "client_name",
    "client_type",
    "industry",
    "integration_type",
    "client_size",
    "region_focus",
)
SUMMARY_STAGES = (
    "invite_sent",
    "invite_delivered",
    "link_opened",
    "identity_verified",
    "balance_viewed",
    "affordability_started",
    "affordability_completed",
    "payment_option_selected",
)
FUNNEL_KEYS = (
    "upload_month",
    "client_type",
    "primary_channel",
    "balance_band",
    "debt_age_band",
    "portfolio_type",
)
AB_KEYS = (
    "ab_test_group",
    "message_tone",
    "balance_band",
    "client_type",
    "debt_age_band",
    "portfolio_type",
)
RECOVERY_KEYS = (
    "client_type",
    "balance_band",
    "debt_age_band",
    "portfolio_type",
    "primary_channel",
)
CLIENT_KEYS = ("client_id", *CLIENT_COLUMNS)


def message_summary(messages: DataFrame, window: Window = TEST_WINDOW) -> DataFrame:
    """First channel and, where there is one, the test message of each account.

    Both first touches come from one pass over the messages.
    """
    order = ["sent_date", "communication_id"]
    tested = experiment_message(window=window)
    touches = messages.groupBy(ACCOUNT).agg(
        earliest(order, ["channel"]).alias("first"),
        earliest(order, ["ab_test_group", "message_tone"], tested).alias("test"),
    )
    return touches.selectExpr(
        ACCOUNT,
        "first.channel AS primary_channel",
        "first.sent_date AS first_communication_date",
        "test.ab_test_group AS ab_test_group",
        "test.message_tone AS message_tone",
    )


def vw_customer_summary(
    t: Tables,
    window: Window = TEST_WINDOW,
    attempts: bool = True,
    client_columns: Sequence[str] = CLIENT_COLUMNS,
) -> DataFrame:
    """One row per account with its client, contact, journey, payments and plans.

    Without ``client_columns`` clients are not looked up.

    ``attempts=False`` leaves out the counts of failed and reversed payments, which
    no view built on the summary needs, and with them the reading of such payments.
    """
    accounts = t["customers"].join(
        message_summary(t["communication_events"], window), ACCOUNT, "left"
    )
    accounts = attach_stages(accounts, t["journey_events"], SUMMARY_STAGES)
    accounts = attach_payments(accounts, t["payments"], attempts=attempts)
    accounts = attach_plans(accounts, t["repayment_plans"])
    uploaded = F.col("account_upload_date")
    return with_client(accounts, t["clients"], client_columns).select(
        "customer_id",
        "client_id",
        *client_columns,
        "account_upload_date",
        month_of(uploaded).alias("upload_month"),
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
        "primary_channel",
        "first_communication_date",
        *[f"{stage}_flag" for stage in SUMMARY_STAGES],
        "payment_made_flag",
        "one_off_payment_flag",
        "amount_collected",
        "avg_successful_payment_amount",
        "successful_payment_count",
        *(["failed_payment_count", "reversed_payment_count"] if attempts else []),
        "repayment_plan_created_flag",
        "first_instalment_paid_flag",
        "broken_plan_flag",
        "active_plan_flag",
        "completed_plan_flag",
        "cancelled_plan_flag",
        "affordability_completed_plan_flag",
        F.coalesce("plan_status", F.lit("No Plan")).alias("plan_status"),
        "avg_plan_amount",
        "avg_instalment_amount",
        "avg_plan_length_months",
        "max_missed_payment_count",
        "ab_test_group",
        "message_tone",
        recovery_rate().alias("customer_recovery_rate"),
        F.date_diff("first_successful_payment_date", uploaded).alias("days_to_first_payment"),
        F.date_diff("first_plan_created_date", uploaded).alias("days_to_first_plan"),
    )


_COUNTED_STAGES = (
    "invite_delivered",
    "link_opened",
    "identity_verified",
    "balance_viewed",
    "payment_option_selected",
    "payment_made",
    "repayment_plan_created",
)
_FUNNEL_RATES = (
    "link_open_rate",
    "verification_after_open_rate",
    "payment_conversion_rate",
    "plan_setup_rate",
)


def vw_funnel_summary(summary: DataFrame) -> DataFrame:
    """Funnel by six keys. "Payment made" means a successful payment here."""
    return segment_funnel(summary, FUNNEL_KEYS, ["invite_sent", *_COUNTED_STAGES], _FUNNEL_RATES)


def vw_channel_performance(summary: DataFrame) -> DataFrame:
    """Funnel and recovery by first channel."""
    stages = [s for s in _COUNTED_STAGES if s != "balance_viewed"]
    totals = rollup(
        summary,
        ["primary_channel"],
        ACCOUNT,
        flags=[f"{s}_flag" for s in stages],
        sums=["amount_collected", "debt_balance"],
    )

    def rate(part: str, whole: str) -> Column:
        return pct(f"units_{part}_flag", f"units_{whole}_flag")

    return totals.select(
        "primary_channel",
        F.col("units").alias("total_customers"),
        *[F.col(f"units_{s}_flag").alias(f"{s}_customers") for s in stages],
        rate("link_opened", "invite_delivered").alias("link_open_rate"),
        rate("identity_verified", "link_opened").alias("verification_after_open_rate"),
        rate("payment_made", "invite_delivered").alias("payment_conversion_rate"),
        rate("repayment_plan_created", "invite_delivered").alias("plan_setup_rate"),
        rounded("sum_amount_collected").alias("total_amount_collected"),
        rounded("sum_debt_balance").alias("total_outstanding_balance"),
        pct("sum_amount_collected", "sum_debt_balance").alias("recovery_rate"),
    )


def vw_ab_test_summary(summary: DataFrame) -> DataFrame:
    """Test metrics by six keys."""
    names = [
        "test_customers",
        "link_open_rate",
        "identity_verification_rate",
        "payment_option_selection_rate",
        "payment_rate",
        "one_off_payment_rate",
        "plan_setup_rate",
        "first_instalment_paid_rate",
        "broken_plan_rate",
        "total_amount_collected",
        "avg_amount_collected_per_customer",
        "avg_customer_recovery_rate",
    ]
    tested = summary.filter(F.col("ab_test_group").isin(CONTROL, VARIANT))
    return group_summary(tested, list(AB_KEYS), names)


def vw_recovery_summary(summary: DataFrame) -> DataFrame:
    """Recovery by five keys."""
    names = [
        "total_customers",
        "total_outstanding_balance",
        "total_amount_collected",
        "recovery_rate",
        "payment_conversion_rate",
        "one_off_payment_rate",
        "plan_setup_rate",
        "broken_plan_rate",
    ]
    return segment_recovery(summary, RECOVERY_KEYS, names)


def vw_client_portfolio_summary(summary: DataFrame, clients: DataFrame) -> DataFrame:
    """Recovery and engagement per client.

    Accounts are counted on their own partitioning and combined on the map side; the
    look-up meets one row per client, so a client with most accounts is no task's work.
    """
    totals = rollup(
        summary,
        ["client_id"],
        ACCOUNT,
        flags=[
            "invite_delivered_flag",
            "link_opened_flag",
            "payment_made_flag",
            "repayment_plan_created_flag",
            "broken_plan_flag",
        ],
        sums=["debt_balance", "amount_collected"],
    )
    accounts, plans = "units", "units_repayment_plan_created_flag"
    return with_client(totals, clients, CLIENT_COLUMNS).select(
        *CLIENT_KEYS,
        F.col(accounts).alias("total_customers"),
        rounded("sum_debt_balance").alias("total_outstanding_balance"),
        rounded("sum_amount_collected").alias("total_amount_collected"),
        pct("sum_amount_collected", "sum_debt_balance").alias("recovery_rate"),
        pct("units_link_opened_flag", "units_invite_delivered_flag").alias(
            "link_open_rate"
        ),
        pct("units_payment_made_flag", accounts).alias("payment_conversion_rate"),
        pct(plans, accounts).alias("plan_setup_rate"),
        pct("units_broken_plan_flag", plans).alias("broken_plan_rate"),
    )


def vw_plan_performance(t: Tables) -> DataFrame:
    """One row per plan with the attributes of its account and client."""
    accounts = t["customers"].select(
        "customer_id", "balance_band", "debt_age_band", "portfolio_type", "vulnerability_flag"
    )
    plans = t["repayment_plans"].join(accounts, "customer_id", "left")
    return with_client(plans, t["clients"], ["client_type", "industry", "integration_type"]).select(
        "plan_id",
        "customer_id",
        "client_id",
        "client_type",
        "industry",
        "integration_type",
        "balance_band",
        "debt_age_band",
        "portfolio_type",
        "vulnerability_flag",
        "plan_created_date",
        month_of("plan_created_date").alias("plan_created_month"),
        "plan_amount",
        "instalment_amount",
        "plan_length_months",
        "first_instalment_paid_flag",
        "missed_payment_count",
        "plan_status",
        "affordability_completed_flag",
        affordability_status().alias("affordability_status"),
        flag(F.col("plan_status") == "Broken").alias("broken_plan_flag"),
    )


def dashboard_kpis(summary: DataFrame) -> DataFrame:
    """The headline figures in one row."""
    totals = rollup(
        summary,
        [],
        ACCOUNT,
        flags=[f"{s}_flag" for s in _COUNTED_STAGES],
        sums=["debt_balance", "amount_collected"],
    )
    return totals.select(
        F.col("units").alias("total_customers"),
        *[F.col(f"units_{s}_flag").alias(f"{s}_customers") for s in _COUNTED_STAGES],
        rounded("sum_debt_balance").alias("total_outstanding_balance"),
        rounded("sum_amount_collected").alias("total_amount_collected"),
        pct("sum_amount_collected", "sum_debt_balance").alias(
            "overall_recovery_rate"
        ),
    )


#: Grouped views by their keys: a grouped view has one row per combination.
_GROUPED_VIEWS = {
    "vw_funnel_summary": FUNNEL_KEYS,
    "vw_channel_performance": ("primary_channel",),
    "vw_ab_test_summary": AB_KEYS,
    "vw_recovery_summary": RECOVERY_KEYS,
    "vw_client_portfolio_summary": CLIENT_KEYS,
}


def view_row_counts(t: Tables, window: Window = TEST_WINDOW) -> DataFrame:
    """Rows per view without building them.

    The accounts are reduced once to the distinct combinations of all keys; clients are
    looked up for combinations. Each combination then gives one hash of 128 bits per view,
    over that view's keys. Equal hashes of a view are first reduced to one, on the map side
    and spread by hash, and then counted.
    """
    wanted = dict.fromkeys([*FUNNEL_KEYS, *AB_KEYS, *RECOVERY_KEYS, "client_id"])
    keys = [k for k in wanted if k not in CLIENT_COLUMNS]
    accounts = vw_customer_summary(t, window, attempts=False, client_columns=())
    combinations = with_client(
        accounts.groupBy(*keys).agg(F.count(F.lit(1)).alias("accounts")), t["clients"], CLIENT_COLUMNS
    )
    tested = F.col("ab_test_group").isin(CONTROL, VARIANT)

    def entry(view: str, key: Column, rows: Column) -> Column:
        return F.struct(F.lit(view).alias("view_name"), key.alias("key"), rows.alias("rows"))

    # null keys are left out of the text, so a combination with a null is one of its own
    hashes = {view: F.md5(F.to_json(F.struct(*columns))) for view, columns in _GROUPED_VIEWS.items()}
    hashes["vw_ab_test_summary"] = F.when(tested, hashes["vw_ab_test_summary"])
    entries = [entry("vw_customer_summary", F.lit(""), F.col("accounts"))]
    entries += [entry(view, key, F.lit(0).cast("bigint")) for view, key in hashes.items()]
    counts = (
        combinations.select(F.inline(F.array(*entries)))
        .filter("key IS NOT NULL")
        .groupBy("view_name", "key")
        .agg(F.sum("rows").alias("rows"))
        .groupBy("view_name")
        .agg(F.when(F.col("view_name") == "vw_customer_summary", F.sum("rows")).otherwise(F.count(F.lit(1))).alias("n"))
    )
    names = ["vw_customer_summary", *_GROUPED_VIEWS]
    spine = accounts.sparkSession.range(0, len(names), 1, 1).select(
        F.element_at(F.array(*map(F.lit, names)), F.col("id").cast("int") + 1).alias("view_name")
    )
    grouped = spine.join(counts, "view_name", "left").select("view_name", F.coalesce("n", F.lit(0)).alias("row_count"))
    plans = row_counts({"vw_plan_performance": vw_plan_performance(t)}, "view_name")
    return stacked([grouped, plans])


def build_views(
    t: Tables, window: Window = TEST_WINDOW, store_summary: bool = False, summary: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All views by name. ``store_summary`` keeps the account summary as Parquet in the
    shared folder, which pays off when several views are read. ``summary`` is one at hand,
    such as ``StoredSummary.read()``, which follows new facts."""
    if summary is None:
        summary = vw_customer_summary(t, window)
        if store_summary:
            summary = stored(summary)
    return {
        "vw_ab_test_customer_outcomes": ab_customer_outcomes(t, window),
        "vw_customer_summary": summary,
        "vw_funnel_summary": vw_funnel_summary(summary),
        "vw_channel_performance": vw_channel_performance(summary),
        "vw_ab_test_summary": vw_ab_test_summary(summary),
        "vw_recovery_summary": vw_recovery_summary(summary),
        "vw_client_portfolio_summary": vw_client_portfolio_summary(summary, t["clients"]),
        "vw_plan_performance": vw_plan_performance(t),
    }


def register_reporting(
    t: Tables, window: Window = TEST_WINDOW, store_summary: bool = False, summary: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Register the source tables and all views for Spark SQL."""
    views = build_views(t, window, store_summary, summary)
    register_views({**t, **views})
    return views
