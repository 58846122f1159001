"""The six source tables derived from an order star schema and an event log.

Lets every analysis run on any ``customer / orders / lineitem / nation / region /
events`` Parquet set, at the size of that set. Whole tables are read. Customers
play the accounts, nations the clients, orders the messages and the repayment
plans, and line items the payments. A third of the accounts holds all plans.
"""

from __future__ import annotations

from datetime import date
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repaylens.sources.files import LazyTables, Tables

TEST_WINDOW = (date(1998, 1, 1), date(1998, 12, 31))

_SNAPSHOT = "2001-08-02"
_PORTFOLIO_START = "1995-01-01"
_JOURNEY_START = "2024-01-01"
_CLIENT_SLOTS = 26


def _client_of(customer: str) -> str:
    return f"pmod({customer}, {_CLIENT_SLOTS}) AS client_id"


def clients(nation: DataFrame, region: DataFrame) -> DataFrame:
    return nation.join(
        region, nation["n_regionkey"] == region["r_regionkey"], "left"
    ).selectExpr(
        "cast(n_nationkey AS bigint) AS client_id",
        "n_name AS client_name",
        "r_name AS client_type",
        """CASE WHEN n_regionkey <= 1 THEN 'Financial Services'
                WHEN n_regionkey = 2 THEN 'Utilities'
                ELSE 'Collections' END AS industry""",
        f"date_add(date'{_PORTFOLIO_START}', n_nationkey * 30) AS go_live_date",
        "(n_nationkey + 1) * 50 AS monthly_account_volume",
        """CASE n_nationkey % 3 WHEN 0 THEN 'UK-wide' WHEN 1 THEN 'England'
                ELSE 'Mixed' END AS region_focus""",
        """CASE n_nationkey % 4 WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'Batch Upload'
                ELSE 'API' END AS integration_type""",
        """CASE WHEN n_nationkey % 5 = 0 THEN 'Small' WHEN n_nationkey % 5 <= 2 THEN 'Mid-Market'
                ELSE 'Enterprise' END AS client_size""",
    )


def customers(customer: DataFrame, orders: DataFrame) -> DataFrame:
    span = (
        orders.selectExpr("o_custkey AS customer_id", "cast(o_orderdate AS date) AS placed")
        .groupBy("customer_id")
        .agg(F.min("placed").alias("first_order"), F.max("placed").alias("last_order"))
    )
    return (
        customer.withColumnRenamed("c_custkey", "customer_id")
        .join(span, "customer_id", "left")
        .selectExpr("*", f"date_diff(date'{_SNAPSHOT}', last_order) AS debt_age_days")
        .selectExpr(
            "customer_id",
            _client_of("customer_id"),
            "first_order AS account_upload_date",
            "c_mktsegment AS portfolio_type",
            "cast(c_acctbal AS decimal(18,2)) AS debt_balance",
            """CASE WHEN c_acctbal < 1000 THEN 'Low' WHEN c_acctbal < 4000 THEN 'Medium'
                    WHEN c_acctbal < 7500 THEN 'High' ELSE 'Very High' END AS balance_band""",
            "debt_age_days",
            """CASE WHEN debt_age_days <= 30 THEN '0-30' WHEN debt_age_days <= 90 THEN '31-90'
                    WHEN debt_age_days <= 180 THEN '91-180' WHEN debt_age_days <= 365 THEN '181-365'
                    WHEN debt_age_days > 365 THEN '365+' END AS debt_age_band""",
            """CASE c_nationkey % 6 WHEN 0 THEN '18-24' WHEN 1 THEN '25-34' WHEN 2 THEN '35-44'
                    WHEN 3 THEN '45-54' WHEN 4 THEN '55+' END AS customer_age_band""",
            """CASE WHEN c_nationkey < 12 THEN 'North' WHEN c_nationkey < 22 THEN 'South'
                    END AS region""",
            "CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS vulnerability_flag",
            """CASE WHEN c_mktsegment = 'BUILDING' THEN 'Letter'
                    WHEN c_mktsegment = 'MACHINERY' THEN 'Email'
                    WHEN c_mktsegment <> 'FURNITURE' THEN 'SMS'
                    END AS preferred_contact_channel""",
            "CASE WHEN c_acctbal <= 0 THEN 'Closed' ELSE 'Open' END AS account_status",
        )
    )


def communication_events(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS communication_id",
        "o_custkey AS customer_id",
        _client_of("o_custkey"),
        "cast(o_orderdate AS date) AS sent_date",
        """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'SMS'
                WHEN o_orderpriority = '3-MEDIUM' THEN 'Email'
                WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Letter'
                ELSE 'Agent Referral' END AS channel""",
        """CASE WHEN o_orderpriority = '5-LOW' THEN 'Agent Follow-up'
                WHEN o_orderstatus = 'P' THEN 'Initial Invite'
                ELSE 'Reminder 1' END AS message_type""",
        """CASE o_orderstatus WHEN 'F' THEN 'Control' WHEN 'O' THEN 'Variant'
                ELSE 'Not Applicable' END AS ab_test_group""",
        """CASE o_orderstatus WHEN 'F' THEN 'Direct' WHEN 'O' THEN 'Supportive'
                ELSE 'Informational' END AS message_tone""",
        "CASE WHEN o_totalprice >= 25000 THEN 1 ELSE 0 END AS delivered_flag",
        "CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END AS opened_or_clicked_flag",
        f"date_diff(cast(o_orderdate AS date), date'{_PORTFOLIO_START}') AS days_after_upload",
    )


def journey_events(events: DataFrame) -> DataFrame:
    """Each user of the log stands for seven accounts, by day of the month.

    Half of the accounts have no event, and a few events belong to no account.
    """
    return events.selectExpr(
        "*", "cast(ts AS date) AS day", "user_id * 10 + day(ts) % 7 * 2 AS customer_id"
    ).selectExpr(
        "event_id",
        "customer_id",
        _client_of("customer_id"),
        "day AS event_date",
        """CASE event_type
                WHEN 'signup' THEN if(value < 35, 'invite_sent', 'invite_delivered')
                WHEN 'view' THEN if(value < 35, 'link_opened', 'identity_verified')
                WHEN 'click' THEN if(value < 35, 'balance_viewed', 'payment_option_selected')
                WHEN 'purchase' THEN if(value < 70, 'payment_made', 'repayment_plan_created')
                WHEN 'error' THEN if(value < 35, 'affordability_started', 'affordability_completed')
                END AS event_name""",
        "if(event_type = 'error', 'Email', 'SMS') AS channel",
        r"""CASE WHEN try_cast(regexp_extract(props, '([0-9]+)', 1) AS int) % 4 = 0 THEN 'Mobile'
                WHEN value > 150 THEN 'Desktop' END AS device_type""",
        "concat_ws('-', user_id, day) AS session_id",
        f"date_diff(day, date'{_JOURNEY_START}') AS days_since_invite",
    )


def payments(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One payment attempt per line item.

    A line cleared when it was not returned, had no discount and was a bulk line.
    """
    return lineitem.join(
        orders.select("o_orderkey", "o_custkey", "o_orderdate"),
        lineitem["l_orderkey"] == orders["o_orderkey"],
        "left",
    ).selectExpr(
        "l_orderkey * 8 + l_linenumber AS payment_id",
        "o_custkey AS customer_id",
        _client_of("o_custkey"),
        "cast(l_shipdate AS date) AS payment_date",
        "cast(l_extendedprice AS decimal(18,2)) AS payment_amount",
        """CASE WHEN l_linenumber <= 2 THEN 'Card' WHEN l_linenumber <= 4 THEN 'Direct Debit'
                WHEN l_linenumber <= 6 THEN 'Open Banking' END AS payment_method""",
        "if(l_linestatus = 'O', 'One-off', 'Plan Instalment') AS payment_type",
        # nested, so that a filter on the status is one condition on the lines
        """if(l_returnflag = 'N' AND l_discount < 0.005D AND l_quantity > 25, 'Successful',
              if(l_returnflag = 'R', 'Reversed', 'Failed')) AS payment_status""",
        "date_diff(cast(l_shipdate AS date), cast(o_orderdate AS date)) AS days_to_payment",
    )


def _plan_holder(customer: str) -> str:
    """Three neighbouring customers give their plans to one of them."""
    return f"({customer} - pmod({customer}, 3))"


def repayment_plans(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One plan per order; its line items give the instalment attributes."""
    lines = lineitem.groupBy(F.col("l_orderkey").alias("plan_id")).agg(
        F.expr("cast(count(*) AS int) AS line_count"),
        F.expr("max(if(l_linenumber = 1 AND l_returnflag = 'N', 1, 0)) AS first_paid"),
        F.expr("cast(count_if(l_returnflag = 'R') AS int) AS returned"),
    )
    return (
        orders.withColumnRenamed("o_orderkey", "plan_id")
        .join(lines, "plan_id", "left")
        .selectExpr(
            "plan_id",
            f"{_plan_holder('o_custkey')} AS customer_id",
            _client_of(_plan_holder("o_custkey")),
            "cast(o_orderdate AS date) AS plan_created_date",
            "cast(o_totalprice AS decimal(18,2)) AS plan_amount",
            "cast(round(o_totalprice / line_count, 2) AS decimal(18,2)) AS instalment_amount",
            "line_count AS plan_length_months",
            "first_paid AS first_instalment_paid_flag",
            "returned AS missed_payment_count",
            """CASE WHEN o_orderstatus = 'F' THEN 'Completed' WHEN o_orderstatus = 'O' THEN 'Active'
                    WHEN o_orderpriority = '5-LOW' THEN 'Cancelled' ELSE 'Broken'
                    END AS plan_status""",
            """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0
                    END AS affordability_completed_flag""",
        )
    )


# Columns of the input files that are read.
INPUT_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}


def load_tables(spark: SparkSession, folder: str) -> Tables:
    """The six source tables over the Parquet files of a folder (nothing is read yet)."""

    @cache
    def table(name: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}.parquet"
        return spark.read.schema(INPUT_SCHEMAS[name]).parquet(path)

    return LazyTables(
        {
            "clients": lambda: clients(table("nation"), table("region")),
            "customers": lambda: customers(table("customer"), table("orders")),
            "communication_events": lambda: communication_events(table("orders")),
            "journey_events": lambda: journey_events(table("events")),
            "payments": lambda: payments(table("lineitem"), table("orders")),
            "repayment_plans": lambda: repayment_plans(table("orders"), table("lineitem")),
        }
    )
