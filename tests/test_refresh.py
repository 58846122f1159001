"""The stored account summary follows new facts."""

from collections import Counter
from datetime import date
from decimal import Decimal

import pytest

from repaylens.plans import reporting
from repaylens.plans.refresh import PART, StoredSummary
from repaylens.schemas import SCHEMAS
from small_tables import CLIENTS, COMMUNICATIONS, CUSTOMERS, JOURNEY, PAYMENTS, event, small_tables


@pytest.fixture
def summary(spark, tmp_path):
    return StoredSummary(spark, str(tmp_path / "summary"), parts=4)


def rows(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def files(spark, summary):
    """Files of each part."""
    return {r["part"]: r["files"] for r in spark.read.parquet(summary.folder).selectExpr(
        f"{PART} AS part", "_metadata.file_path AS f").groupBy("part").agg({"f": "collect_set"}).withColumnRenamed(
        "collect_set(f)", "files").collect()}


def test_a_day_of_facts_is_taken_in(spark, summary):
    t = small_tables(spark)
    summary.build(t)
    assert rows(summary.read()) == rows(reporting.vw_customer_summary(t))
    before = files(spark, summary)

    new_events = [event(30, "A5", "2023-05-01", "link_opened"), event(31, "A5", "2023-05-01", "invite_sent")]
    new_payments = [("P9", "A5", "K2", date(2023, 5, 1), Decimal("12.50"), "Card", "One-off", "Successful", 2)]
    later = small_tables(spark, journey_events=[*JOURNEY, *new_events], payments=[*PAYMENTS, *new_payments])
    arrived = {
        "journey_events": spark.createDataFrame(new_events, SCHEMAS["journey_events"]),
        "payments": spark.createDataFrame(new_payments, SCHEMAS["payments"]),
    }
    summary.refresh(later, arrived)
    assert rows(summary.read()) == rows(reporting.vw_customer_summary(later))
    # one part is new and its old files are gone; the others are as they were
    after = files(spark, summary)
    changed = [p for p in after if set(after[p]) != set(before.get(p, []))]
    assert len(changed) == 1 and not set(after[changed[0]]) & set(before.get(changed[0], []))


def test_new_changed_and_withdrawn_accounts(spark, summary):
    t = small_tables(spark)
    summary.build(t)
    moved = (*CUSTOMERS[0][:5], "High", *CUSTOMERS[0][6:])
    new = ("A8", *CUSTOMERS[1][1:])
    later = small_tables(spark, customers=[moved, *CUSTOMERS[2:], new])  # A2 is withdrawn
    summary.refresh(later, {"customers": spark.createDataFrame([moved, new, CUSTOMERS[1]], SCHEMAS["customers"])})
    assert rows(summary.read()) == rows(reporting.vw_customer_summary(later))


def test_a_part_may_become_empty(spark, tmp_path):
    summary = StoredSummary(spark, str(tmp_path / "one"), parts=1)
    summary.build(small_tables(spark))
    none = small_tables(spark, customers=[])
    summary.refresh(none, {"customers": small_tables(spark)["customers"]})
    assert summary.read().count() == 0
    summary.refresh(small_tables(spark), {"customers": small_tables(spark)["customers"]})
    assert rows(summary.read()) == rows(reporting.vw_customer_summary(small_tables(spark)))


def test_a_changed_client_reaches_its_accounts(spark, summary):
    summary.build(small_tables(spark))
    renamed = [(CLIENTS[0][0], "Renamed", *CLIENTS[0][2:]), CLIENTS[1]]
    later = small_tables(spark, clients=renamed)
    summary.refresh(later, {"clients": spark.createDataFrame(renamed[:1], SCHEMAS["clients"])})
    assert rows(summary.read()) == rows(reporting.vw_customer_summary(later))


def test_nothing_new_changes_nothing(spark, summary):
    t = small_tables(spark)
    summary.build(t)
    before = files(spark, summary)
    summary.refresh(t, {"payments": t["payments"].limit(0)})
    assert files(spark, summary) == before


def test_views_start_from_the_stored_summary(spark, summary):
    t = small_tables(spark, communication_events=COMMUNICATIONS)
    summary.build(t)
    views = reporting.build_views(t, summary=summary.read())
    assert rows(views["vw_channel_performance"]) == rows(reporting.build_views(t)["vw_channel_performance"])
    summary.remove()
