"""Facts reduced to one row per account, and their attachment to an account table.

Every fact table is aggregated by account before it is joined. Rows are combined
on the map side, so an account with very many rows costs each map task one row,
and the joins that follow meet at most one row per account from each side.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repaylens.functions.columns import quoted, ratio, rounded_ratio
from repaylens.schemas import (
    CONTROL,
    FAILED,
    ONE_OFF,
    PLAN_STATUSES,
    REVERSED,
    SUCCESSFUL,
    TEST_CHANNEL,
    TEST_WINDOW,
    VARIANT,
)

ACCOUNT = "customer_id"
RATE = T.DecimalType(24, 4)


def flag_name(event: str) -> str:
    return f"{event}_flag"


def attach_stages(
    accounts: DataFrame,
    events: DataFrame,
    stages: Iterable[str],
    first_dates: Mapping[str, str] | None = None,
    key: str = ACCOUNT,
) -> DataFrame:
    """Add a 0/1 flag per journey event, and the first date of the events in ``first_dates``.

    The events of an account travel as the bits of one number, so ten stages cost
    one aggregate and one column in the shuffle. ``first_dates`` maps events to column
    names; their dates are masked minima of the same aggregate. Accounts without events stay.
    """
    stages, first_dates = list(stages), dict(first_dates or {})
    bits = " ".join(f"WHEN {quoted(stage)} THEN {1 << i}L" for i, stage in enumerate(stages))
    reached = [F.expr(f"bit_or(CASE event_name {bits} ELSE 0L END) AS reached_stages")] if stages else []
    dates = [
        F.expr(f"min(CASE WHEN event_name = {quoted(event)} THEN event_date END) AS {name}")
        for event, name in first_dates.items()
    ]
    facts = events.filter(F.col("event_name").isin(sorted({*stages, *first_dates}))).groupBy(key).agg(*reached, *dates)
    return accounts.join(facts, key, "left").selectExpr(
        *accounts.columns,
        *[
            f"cast(shiftright(coalesce(reached_stages, 0L), {i}) & 1 AS int) AS {flag_name(stage)}"
            for i, stage in enumerate(stages)
        ],
        *first_dates.values(),
    )


def earliest(order: Sequence[str], payload: Sequence[str], where: str | None = None) -> Column:
    """Aggregate giving the first row of a group by ``order``, null first, as a struct.

    An aggregate rather than a row number: it combines on the map side and several
    of them share one pass over the events.
    """
    row = f"struct({', '.join(dict.fromkeys([*order, *payload]))})"
    return F.expr(f"min({row})" if where is None else f"min(CASE WHEN {where} THEN {row} END)")


def first_touch(
    events: DataFrame,
    payload: Sequence[str],
    order: Sequence[str] = ("sent_date", "communication_id"),
    where: str | None = None,
    key: str = ACCOUNT,
) -> DataFrame:
    """The first qualifying event of each account; ties on the date go to the lower id."""
    source = events if where is None else events.filter(where)
    first = source.groupBy(key).agg(earliest(order, payload).alias("first"))
    return first.selectExpr(key, *[f"first.{c} AS {c}" for c in payload])


def experiment_message(
    channel: str = TEST_CHANNEL,
    groups: Sequence[str] = (CONTROL, VARIANT),
    window: tuple[date, date] = TEST_WINDOW,
) -> str:
    """Condition: a message that belongs to the experiment. Both window days count."""
    labels = ", ".join(quoted(g) for g in groups)
    return (
        f"channel = {quoted(channel)} AND ab_test_group IN ({labels})"
        f" AND sent_date BETWEEN date'{window[0]}' AND date'{window[1]}'"
    )


def payment_summary(payments: DataFrame, key: str = ACCOUNT) -> DataFrame:
    """Payment totals per account. Only successful payments count as collected."""
    paid = f"payment_status = '{SUCCESSFUL}'"
    amount = f"CASE WHEN {paid} THEN payment_amount END"
    return payments.groupBy(key).agg(
        F.expr(f"coalesce(sum({amount}), 0BD) AS amount_collected"),
        ratio(f"sum({amount})", f"count({amount})").alias(
            "avg_successful_payment_amount"
        ),
        F.expr(f"max(CASE WHEN {paid} THEN 1 ELSE 0 END) AS payment_made_flag"),
        F.expr(
            f"max(CASE WHEN {paid} AND payment_type = '{ONE_OFF}' THEN 1 ELSE 0 END)"
            " AS one_off_payment_flag"
        ),
        F.expr(f"min(CASE WHEN {paid} THEN payment_date END) AS first_successful_payment_date"),
        *[
            F.expr(
                f"count(CASE WHEN payment_status = '{label}' THEN payment_id END)"
                f" AS {label.lower()}_payment_count"
            )
            for label in (SUCCESSFUL, FAILED, REVERSED)
        ],
    )


def plan_summary(plans: DataFrame, key: str = ACCOUNT) -> DataFrame:
    """Plan totals per account. Several plans: the alphabetically last status is kept."""

    def any_row(condition: str, name: str) -> Column:
        return F.expr(f"max(CASE WHEN {condition} THEN 1 ELSE 0 END) AS {name}")

    def mean(column: str) -> Column:
        return ratio(f"sum({column})", f"count({column})").alias(f"avg_{column}")

    return plans.groupBy(key).agg(
        F.lit(1).alias("repayment_plan_created_flag"),
        any_row("first_instalment_paid_flag = 1", "first_instalment_paid_flag"),
        *[any_row(f"plan_status = '{s}'", f"{s.lower()}_plan_flag") for s in PLAN_STATUSES],
        any_row("affordability_completed_flag = 1", "affordability_completed_plan_flag"),
        F.max("plan_status").alias("plan_status"),
        F.min("plan_created_date").alias("first_plan_created_date"),
        mean("plan_amount"),
        mean("instalment_amount"),
        mean("plan_length_months"),
        F.max("missed_payment_count").alias("max_missed_payment_count"),
    )


_PAYMENT_NUMBERS = (
    "amount_collected",
    "avg_successful_payment_amount",
    "payment_made_flag",
    "one_off_payment_flag",
    "successful_payment_count",
)
_ATTEMPT_NUMBERS = ("failed_payment_count", "reversed_payment_count")
_PLAN_NUMBERS = (
    "repayment_plan_created_flag",
    "first_instalment_paid_flag",
    *(f"{label.lower()}_plan_flag" for label in PLAN_STATUSES),
    "affordability_completed_plan_flag",
    "avg_plan_amount",
    "avg_instalment_amount",
    "avg_plan_length_months",
    "max_missed_payment_count",
)


def attach_payments(
    accounts: DataFrame, payments: DataFrame, key: str = ACCOUNT, attempts: bool = False
) -> DataFrame:
    """Add the payment totals; accounts without payments get zeros.

    Without the counts of failed and reversed ``attempts``, only successful payments
    are read and shuffled: an account with none of them ends up with zeros as well.
    """
    if attempts:
        summary, numbers = payment_summary(payments, key), [*_PAYMENT_NUMBERS, *_ATTEMPT_NUMBERS]
    else:
        paid = payments.filter(F.col("payment_status") == SUCCESSFUL)
        summary, numbers = payment_summary(paid, key).drop(*_ATTEMPT_NUMBERS), [*_PAYMENT_NUMBERS]
    return accounts.join(summary, key, "left").fillna(0, subset=numbers)


def attach_plans(
    accounts: DataFrame,
    plans: DataFrame,
    key: str = ACCOUNT,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Add the plan totals, or ``only`` some; accounts without plans get zeros, no status."""
    summary = plan_summary(plans, key)
    if only is not None:
        summary = summary.select(key, *only)
    numbers = [c for c in _PLAN_NUMBERS if only is None or c in only]
    return accounts.join(summary, key, "left").fillna(0, subset=numbers)


def with_client(df: DataFrame, clients: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Look up client attributes; rows of unknown clients stay, with nulls.

    Without ``columns`` nothing is joined: Spark cannot tell that the clients' key is
    unique, so it would keep a join whose columns nobody uses.
    No broadcast is forced. Spark broadcasts the clients while they are below
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges, where
    adaptive execution splits the partition of a client with very many accounts.
    """
    if not columns:
        return df
    return df.join(clients.select("client_id", *columns), "client_id", "left")


def recovery_rate() -> Column:
    """Share of the balance an account has paid, to four places; null without a balance."""
    return rounded_ratio("amount_collected", "debt_balance", 4).cast(RATE)
