"""Every named analysis by name, as a function of the six source tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repaylens.plans import experiment, journey, quality, recovery, reporting
from repaylens.plans.refresh import StoredSummary
from repaylens.results import RESULTS, known_result, read_results
from repaylens.schemas import BAND_ORDER, DATE_COLUMNS, KEYS, TEST_WINDOW
from repaylens.session import shared_path
from repaylens.sources.buckets import store_in_buckets
from repaylens.sources.files import Tables, export_csv, stored

Analysis = Callable[[Tables], DataFrame]

_QUALITY = (
    "dq_row_counts",
    "dq_table_shapes",
    "dq_date_ranges",
    "dq_duplicate_keys",
    "dq_orphans",
    "dq_client_type_counts",
    "dq_missing_values",
    "channel_distribution",
    "channel_engagement",
)
_JOURNEY = (
    "overall_funnel",
    "stage_drop_off",
    "affordability_funnel",
    "funnel_by_channel",
    "funnel_by_balance_band",
    "funnel_by_debt_age",
    "funnel_by_client_type",
    "monthly_funnel_trend",
    "journey_first_dates",
    "stage_intervals",
)
_EXPERIMENT = (
    "ab_population",
    "ab_customer_outcomes",
    "ab_view_check",
    "ab_core_performance",
    "ab_by_balance_band",
    "ab_by_client_type",
    "ab_by_debt_age",
    "ab_lift_summary",
    "ab_group_sizes",
    "ab_core_rates_long",
    "ab_lift_long",
    "ab_ztests",
    "ab_ztests_by_band",
    "ab_amount_ttest",
    "ab_amount_summary",
)
_RECOVERY = (
    "recovery_overall",
    "recovery_by_balance_band",
    "recovery_by_debt_age",
    "recovery_by_client_type",
    "payment_method_performance",
    "plan_sustainability",
    "plan_by_balance_band",
    "plan_by_affordability",
    "recovery_priority_segments",
    "customer_recovery_summary",
    "recovery_baseline_long",
    "weakest_segments",
    "recovery_matrix",
    "high_exposure_low_recovery",
    "recovery_describe",
    "balance_histogram",
    "collected_histogram",
    "payment_plan_status",
)
# Views on the account summary, with the client attributes they use.
_SUMMARY_VIEWS = {
    "vw_funnel_summary": ("client_type",),
    "vw_channel_performance": (),
    "vw_ab_test_summary": ("client_type",),
    "vw_recovery_summary": ("client_type",),
    "dashboard_kpis": (),
}


def analyses(window: tuple[date, date] = TEST_WINDOW) -> dict[str, Analysis]:
    """``window`` gives the first and last day of the message experiment."""
    out: dict[str, Analysis] = {name: getattr(quality, name) for name in _QUALITY}
    for table in KEYS:
        out[f"dq_preview_{table}"] = partial(quality.dq_preview, table=table)
    for column in ("debt_balance", "payment_amount", "plan_amount"):
        out[f"dq_numeric_ranges_{column}"] = partial(quality.dq_numeric_ranges, column=column)
    for column in ("debt_balance", "payment_amount"):
        out[f"dq_invalid_amounts_{column}"] = partial(quality.dq_invalid_amounts, column=column)
    for column in (*BAND_ORDER, "channel", "event_name", "payment_status", "plan_status"):
        out[f"dq_distribution_{column}"] = partial(quality.dq_distribution, column=column)
    for column in (*BAND_ORDER, "client_type", "portfolio_type"):
        out[f"eda_distribution_{column}"] = partial(quality.eda_distribution, column=column)

    out.update({name: getattr(journey, name) for name in _JOURNEY})

    for name in _EXPERIMENT:
        out[name] = partial(getattr(experiment, name), window=window)
    for rate in ("plan_setup_rate", "payment_rate"):
        out[f"ab_rate_pivot_{rate}"] = partial(experiment.ab_rate_pivot, rate=rate, window=window)

    out.update({name: getattr(recovery, name) for name in _RECOVERY})

    out["vw_customer_summary"] = partial(reporting.vw_customer_summary, window=window)
    out["vw_customer_summary_from_buckets"] = partial(_summary_from_buckets, window)
    out["vw_customer_summary_refreshed"] = partial(_summary_refreshed, window)
    for name, columns in _SUMMARY_VIEWS.items():
        out[name] = partial(_on_summary, getattr(reporting, name), window, columns)
    out["vw_client_portfolio_summary"] = partial(_per_client, window)
    out["vw_plan_performance"] = reporting.vw_plan_performance
    out["view_row_counts"] = partial(reporting.view_row_counts, window=window)
    return {name: partial(_known_or, name, analysis) if name in RESULTS else analysis for name, analysis in out.items()}


def _known_or(name: str, analysis: Analysis, t: Tables) -> DataFrame:
    """A result that ``t`` holds already is not computed again."""
    known = known_result(t, name)
    return analysis(t) if known is None else known


# Results handed over as files, with the sort order of those that have a row per account.
EXPORTS: dict[str, list[str]] = {
    "overall_funnel": [],
    "stage_drop_off": [],
    "funnel_by_channel": [],
    "funnel_by_balance_band": [],
    "monthly_funnel_trend": [],
    "ab_core_performance": [],
    "ab_by_balance_band": [],
    "ab_lift_summary": [],
    "ab_customer_outcomes": ["ab_test_group", "customer_id"],
    "recovery_by_balance_band": [],
    "recovery_by_debt_age": [],
    "recovery_by_client_type": [],
    "plan_by_affordability": [],
    "recovery_priority_segments": [],
    "customer_recovery_summary": ["customer_id"],
    "ab_ztests": [],
    "ab_amount_ttest": [],
    "ab_ztests_by_band": [],
    "recovery_baseline_long": [],
    "high_exposure_low_recovery": [],
    "payment_plan_status": [],
}


def export_results(
    t: Tables,
    folder: str,
    window: tuple[date, date] = TEST_WINDOW,
    names: Iterable[str] = tuple(EXPORTS),
    mode: str = "error",
) -> None:
    """Write results as CSV, one folder per analysis. ``mode`` says what to do if one exists.

    Reports become one file. Tables with a row per account are sorted over as many
    files as Spark makes. The two account tables that the others start from are computed
    once, if several results are wanted.
    """
    run, names = analyses(window), list(names)
    if len(names) > 1:
        t = with_account_tables(t, window, names)
    for name in names:
        order = EXPORTS.get(name, [])
        export_csv(run[name](t), f"{folder.rstrip('/')}/{name}", order, None if order else 1, mode)


#: Tables with a row per account that other analyses start from, by what those begin with.
ACCOUNT_TABLES = {
    "ab_customer_outcomes": ("ab_",),
    "customer_recovery_summary": (
        "recovery_", "customer_recovery_", "high_exposure_", "payment_plan_", "collected_", "weakest_"
    ),
}


def with_account_tables(
    t: Tables, window: tuple[date, date] = TEST_WINDOW, names: Iterable[str] = tuple(EXPORTS)
) -> Tables:
    """``t`` and, as Parquet in the shared folder, the account tables that ``names`` start from."""
    run, names = analyses(window), list(names)
    wanted = [
        table for table, users in ACCOUNT_TABLES.items()
        if table not in t and any(n.startswith(users) for n in names)
    ]
    return {**t, **{table: stored(run[table](t)) for table in wanted}}


def read_account_tables(t: Tables, folder: str) -> Tables:
    """``t`` and the account tables that ``export_results`` has written to ``folder``.

    The experiment and recovery analyses then start from the exported accounts.
    """
    customers = t["customers"]
    ids = customers.schema["customer_id"].dataType.simpleString()
    return {**t, **read_results(customers.sparkSession, folder, ACCOUNT_TABLES, ids)}


def _on_summary(
    view: Callable[[DataFrame], DataFrame],
    window: tuple[date, date],
    client_columns: tuple[str, ...],
    t: Tables,
) -> DataFrame:
    return view(reporting.vw_customer_summary(t, window, False, client_columns))


def _summary_from_buckets(window: tuple[date, date], t: Tables) -> DataFrame:
    """The account summary over source tables stored in buckets by account."""
    buckets = int(t["customers"].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reporting.vw_customer_summary(store_in_buckets(t, buckets)[1], window)


def _summary_refreshed(window: tuple[date, date], t: Tables) -> DataFrame:
    """The account summary, stored without the facts of the last 30 days and then refreshed by them."""
    spark = t["customers"].sparkSession
    last = F.date_sub(t["payments"].agg(F.max("payment_date").alias("last")).scalar(), 30)
    recent = {name: F.col(DATE_COLUMNS[name]) > last for name in ("payments", "communication_events", "journey_events")}
    before = {name: df.filter(~recent[name] | recent[name].isNull()) if name in recent else df for name, df in t.items()}
    summary = StoredSummary(spark, shared_path(spark), parts=16, window=window)
    summary.build(before)
    summary.refresh(t, {name: t[name].filter(condition) for name, condition in recent.items()})
    return summary.read()


def _per_client(window: tuple[date, date], t: Tables) -> DataFrame:
    summary = reporting.vw_customer_summary(t, window, attempts=False, client_columns=())
    return reporting.vw_client_portfolio_summary(summary, t["clients"])
