"""Typed catalogue of the results that are handed over as files, and their reading.

Types are those that ``export_results`` writes: money of reports as doubles, money of the
tables with a row per account as decimals, which an exported double fits into.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from repaylens.sources.files import Tables, read_csv

_REACHED = (
    "invite_delivered_customers bigint, link_opened_customers bigint, identity_verified_customers bigint, "
)
_CORE_RATES = "payment_conversion_rate double, plan_setup_rate double"
_SEGMENT = (
    "total_customers bigint, total_outstanding_balance double, total_amount_collected double, "
    f"recovery_rate double, {_CORE_RATES}, broken_plan_rate double"
)
_TEST = "lift_percentage_points double, z_statistic double, p_value double, significance string, direction string"
_ACCOUNT = "customer_id {id}, client_id {id}, client_type string, industry string, integration_type string, "
_OUTCOME = (
    "repayment_plan_created_flag int, first_instalment_paid_flag int, broken_plan_flag int, "
    "affordability_completed_flag int, max_missed_payment_count int, customer_recovery_rate decimal(24,4)"
)

#: Columns of each result; ``{id}`` is the type of account and client ids.
RESULTS: dict[str, str] = {
    "overall_funnel": (
        "stage_order int, funnel_stage string, customers bigint, percent_of_uploaded_accounts double"
    ),
    "stage_drop_off": (
        "stage_order int, funnel_stage string, customers bigint, previous_stage_customers bigint, "
        "stage_to_stage_conversion_percent double, stage_drop_off_percent double"
    ),
    "funnel_by_channel": (
        f"primary_channel string, total_customers bigint, {_REACHED}balance_viewed_customers bigint, "
        "payment_option_selected_customers bigint, payment_made_customers bigint, "
        "repayment_plan_created_customers bigint, link_open_rate double, verification_after_open_rate double, "
        f"{_CORE_RATES}"
    ),
    "funnel_by_balance_band": (
        f"balance_band string, total_customers bigint, {_REACHED}payment_option_selected_customers bigint, "
        "payment_made_customers bigint, repayment_plan_created_customers bigint, link_open_rate double, "
        f"{_CORE_RATES}"
    ),
    "monthly_funnel_trend": (
        f"upload_month date, uploaded_customers bigint, {_REACHED}payment_made_customers bigint, "
        f"repayment_plan_created_customers bigint, link_open_rate double, {_CORE_RATES}"
    ),
    "ab_core_performance": (
        "ab_test_group string, test_customers bigint, link_open_rate double, identity_verification_rate double, "
        "balance_view_rate double, payment_option_selection_rate double, payment_rate double, "
        "one_off_payment_rate double, plan_setup_rate double, first_instalment_paid_rate double, "
        "broken_plan_rate double, total_amount_collected double, avg_amount_collected_per_customer double, "
        "avg_customer_recovery_rate double"
    ),
    "ab_by_balance_band": (
        "balance_band string, ab_test_group string, test_customers bigint, link_open_rate double, "
        "payment_rate double, one_off_payment_rate double, plan_setup_rate double, total_amount_collected double, "
        "avg_customer_recovery_rate double"
    ),
    "ab_lift_summary": (
        "comparison string, link_open_rate_point_lift double, payment_rate_point_lift double, "
        "one_off_payment_rate_point_lift double, plan_setup_rate_point_lift double, "
        "avg_recovery_rate_point_lift double, avg_amount_collected_per_customer_lift double"
    ),
    "ab_customer_outcomes": (
        f"{_ACCOUNT}portfolio_type string, debt_balance decimal(18,2), balance_band string, debt_age_days int, "
        "debt_age_band string, customer_age_band string, region string, vulnerability_flag int, "
        "account_status string, sms_sent_date date, ab_test_group string, message_tone string, delivered_flag int, "
        "communication_opened_or_clicked_flag int, link_opened_flag int, identity_verified_flag int, "
        "balance_viewed_flag int, payment_option_selected_flag int, payment_made_flag int, "
        f"one_off_payment_flag int, amount_collected decimal(28,2), avg_successful_payment_amount double, {_OUTCOME}"
    ),
    "recovery_by_balance_band": (
        "balance_band string, total_customers bigint, avg_debt_balance double, total_outstanding_balance double, "
        "total_amount_collected double, recovery_rate double, payment_conversion_rate double, "
        "one_off_payment_rate double, plan_setup_rate double, broken_plan_rate double"
    ),
    "recovery_by_debt_age": (
        "debt_age_band string, total_customers bigint, avg_debt_age_days double, total_outstanding_balance double, "
        f"total_amount_collected double, recovery_rate double, {_CORE_RATES}, broken_plan_rate double"
    ),
    "recovery_by_client_type": f"client_type string, {_SEGMENT}",
    "plan_by_affordability": (
        "affordability_status string, total_repayment_plans bigint, first_instalment_paid_rate double, "
        "broken_plan_rate double, avg_missed_payment_count double, avg_plan_amount double, "
        "avg_instalment_amount double"
    ),
    "recovery_priority_segments": f"balance_band string, debt_age_band string, {_SEGMENT}",
    "customer_recovery_summary": (
        f"{_ACCOUNT}portfolio_type string, debt_balance decimal(18,2), balance_band string, debt_age_days int, "
        "debt_age_band string, customer_age_band string, region string, vulnerability_flag int, "
        "preferred_contact_channel string, account_status string, payment_made_flag int, "
        f"one_off_payment_flag int, amount_collected decimal(28,2), {_OUTCOME}"
    ),
    "ab_ztests": (
        "metric string, control_successes bigint, control_total bigint, control_rate_percent double, "
        f"variant_successes bigint, variant_total bigint, variant_rate_percent double, {_TEST}"
    ),
    "ab_amount_ttest": (
        "metric string, control_avg_amount double, variant_avg_amount double, amount_lift double, "
        "t_statistic double, p_value double, significance string"
    ),
    "ab_ztests_by_band": (
        f"balance_band string, metric string, control_rate_percent double, variant_rate_percent double, {_TEST}"
    ),
    "recovery_baseline_long": "metric string, value double",
    "high_exposure_low_recovery": f"balance_band string, debt_age_band string, {_SEGMENT}",
    "payment_plan_status": (
        "payment_made_flag int, repayment_plan_created_flag int, customers bigint, avg_debt_balance double, "
        "avg_amount_collected double, avg_customer_recovery_rate double, customer_status string"
    ),
}


def result_schema(name: str, id_type: str = "string") -> str:
    return RESULTS[name].format(id=id_type)


def read_results(
    spark: SparkSession, folder: str, names: Iterable[str] = tuple(RESULTS), id_type: str = "string"
) -> dict[str, DataFrame]:
    """Results that ``export_results`` has written to ``folder``, by name.

    A value that does not fit its type fails the read. Handed to an analysis as tables,
    alone or beside the source tables, they are what it starts from.
    """
    base = folder.rstrip("/")
    return {name: read_csv(spark, f"{base}/{name}", result_schema(name, id_type)) for name in names}


def known_result(t: Tables, name: str) -> DataFrame | None:
    """The result ``name`` if ``t`` holds it, stored or exported before."""
    return t[name] if name in t else None
