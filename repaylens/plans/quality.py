"""Data-quality checks and category distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repaylens.functions.columns import percent, sort_keys
from repaylens.operators import quality as q
from repaylens.operators.accounts import with_client
from repaylens.operators.distribution import row_distribution, unit_distribution
from repaylens.schemas import DATE_COLUMNS, KEYS
from repaylens.sources.files import Tables


def dq_row_counts(t: Tables) -> DataFrame:
    return q.row_counts(t)


def dq_table_shapes(t: Tables) -> DataFrame:
    return q.table_shapes(t)


def dq_preview(t: Tables, table: str, n: int = 10) -> DataFrame:
    """The first rows of a table by its key."""
    df = t[table]
    return q.preview(df, n, [KEYS[table], *[c for c in df.columns if c != KEYS[table]]])


def dq_date_ranges(t: Tables) -> DataFrame:
    return q.date_ranges(t, DATE_COLUMNS)


def dq_duplicate_keys(t: Tables) -> DataFrame:
    """Repeated primary keys of all tables."""
    return q.stacked(
        [
            q.duplicate_keys(t[table], key).select(
                F.lit(table).alias("table_name"),
                F.col(key).cast("string").alias("key_value"),
                "duplicate_count",
            )
            for table, key in KEYS.items()
        ]
    )


def dq_orphans(t: Tables) -> DataFrame:
    """Rows whose foreign key has no match, for the five relations, one row each."""
    relations = [
        ("communication_events", "customers", "customer_id"),
        ("journey_events", "customers", "customer_id"),
        ("payments", "customers", "customer_id"),
        ("repayment_plans", "customers", "customer_id"),
        ("customers", "clients", "client_id"),
    ]
    return q.stacked(
        [
            q.orphan_count(t[child], t[parent], key, "unmatched_rows").select(
                F.lit(child).alias("child_table"),
                F.lit(parent).alias("parent_table"),
                "unmatched_rows",
            )
            for child, parent, key in relations
        ]
    )


def dq_numeric_ranges(t: Tables, column: str) -> DataFrame:
    """Smallest, largest and mean balance, payment amount or plan amount."""
    table = {
        "debt_balance": "customers",
        "payment_amount": "payments",
        "plan_amount": "repayment_plans",
    }[column]
    return q.numeric_range(t[table], column)


def dq_invalid_amounts(t: Tables, column: str) -> DataFrame:
    """Balances that are zero or negative, or payments that are negative."""
    table, condition, name = {
        "debt_balance": ("customers", "debt_balance <= 0", "invalid_debt_balance_records"),
        "payment_amount": ("payments", "payment_amount < 0", "negative_payment_records"),
    }[column]
    return q.count_where(t[table], condition, name)


def dq_client_type_counts(t: Tables) -> DataFrame:
    return (
        t["clients"]
        .groupBy("client_type")
        .agg(F.count(F.lit(1)).alias("client_count"))
        .orderBy(F.desc("client_count"), "client_type")
    )


def dq_distribution(t: Tables, column: str) -> DataFrame:
    """Rows and share by balance band, debt age band, channel, event, or status."""
    table, noun = {
        "balance_band": ("customers", "customer"),
        "debt_age_band": ("customers", "customer"),
        "channel": ("communication_events", "communication"),
        "event_name": ("journey_events", "event"),
        "payment_status": ("payments", "payment"),
        "plan_status": ("repayment_plans", "plan"),
    }[column]
    return row_distribution(t[table], column, f"{noun}_count", f"{noun}_share_percent")


def dq_missing_values(t: Tables) -> DataFrame:
    return q.missing_values(t)


def eda_distribution(t: Tables, column: str) -> DataFrame:
    """Distinct accounts and share by band, client type or portfolio type."""
    accounts = t["customers"]
    if column == "client_type":
        accounts = with_client(accounts, t["clients"], ["client_type"])
    shares = unit_distribution(
        accounts, [column], "customer_id", "customers", "customer_share_percent"
    )
    if column.endswith("_band"):
        return shares.orderBy(*sort_keys([column]))
    return shares.orderBy(F.desc("customers"), column)


def channel_distribution(t: Tables) -> DataFrame:
    """Distinct messages and share by channel."""
    return unit_distribution(
        t["communication_events"],
        ["channel"],
        "communication_id",
        "communication_count",
        "communication_share_percent",
    ).orderBy(F.desc("communication_count"), "channel")


def channel_engagement(t: Tables) -> DataFrame:
    """Delivery per message, and opening or clicking per delivered message, by channel."""
    per_message = (
        t["communication_events"]
        .filter(F.col("channel").isNotNull())
        .groupBy("channel", "communication_id")
        .agg(
            F.sum("delivered_flag").alias("delivered"),
            F.sum("opened_or_clicked_flag").alias("opened"),
        )
    )
    return (
        per_message.groupBy("channel")
        .agg(
            F.count("communication_id").alias("communication_count"),
            F.sum("delivered").alias("delivered_count"),
            F.sum("opened").alias("opened_or_clicked_count"),
        )
        .withColumns(
            {
                "delivery_rate": percent("delivered_count", "communication_count"),
                "open_or_click_rate": percent("opened_or_clicked_count", "delivered_count"),
            }
        )
        .orderBy(F.desc("communication_count"), "channel")
    )
