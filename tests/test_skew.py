"""One key with a third of all rows: same results, and the hot partition is split."""

import pytest
from pyspark.sql import functions as F

from repaylens.operators.accounts import first_touch, payment_summary
from repaylens.operators.quality import orphan_count
from repaylens.plans import recovery, reporting
from repaylens.sources import commerce
from small_tables import small_tables

FOLDER = "/root/testdata/sf0.01"
ROWS = 60000


@pytest.fixture
def skew_aware(spark):
    """Thresholds scaled down to the test data; joins must shuffle."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot_lines(spark):
    """Line items of which a third belong to order 7."""
    lines = spark.read.schema(commerce.INPUT_SCHEMAS["lineitem"]).parquet(f"{FOLDER}/lineitem.parquet")
    hot = F.when(F.col("l_suppkey") % 3 == 0, F.lit(7)).otherwise(F.col("l_orderkey"))
    return lines.withColumn("l_orderkey", hot.cast("bigint")).repartition(12)


def test_hot_order_is_split_in_the_payment_join(skew_aware):
    spark = skew_aware
    orders = spark.read.schema(commerce.INPUT_SCHEMAS["orders"]).parquet(f"{FOLDER}/orders.parquet")
    lines = hot_lines(spark)
    summary = payment_summary(commerce.payments(lines, orders)).agg(
        F.sum("successful_payment_count"), F.sum("failed_payment_count"), F.sum("reversed_payment_count")
    )
    assert "skew=true" in final_plan(summary)
    assert sum(summary.first()) == lines.count()


def test_hot_account_is_split_in_the_plan_join(skew_aware):
    spark = skew_aware
    t = small_tables(spark)
    plans = spark.range(0, ROWS, 1, 12).select(
        F.col("id").cast("string").alias("plan_id"),
        F.when(F.col("id") % 3 == 0, "A2").otherwise(F.concat(F.lit("B"), "id")).alias("customer_id"),
        F.lit("K1").alias("client_id"),
        F.lit("2023-01-01").cast("date").alias("plan_created_date"),
        F.lit(10).cast("decimal(18,2)").alias("plan_amount"),
        F.lit(1).cast("decimal(18,2)").alias("instalment_amount"),
        F.lit(10).alias("plan_length_months"),
        F.lit(1).alias("first_instalment_paid_flag"),
        F.lit(0).alias("missed_payment_count"),
        F.when(F.col("id") % 2 == 0, "Broken").otherwise("Active").alias("plan_status"),
        F.lit(0).alias("affordability_completed_flag"),
    )
    by_band = recovery.plan_by_balance_band({**t, "repayment_plans": plans})
    assert "skew=true" in final_plan(by_band)
    found = {r["balance_band"]: (r["total_repayment_plans"], r["broken_plan_rate"]) for r in by_band.collect()}
    assert found == {"Medium": (ROWS // 3, 50.0), None: (ROWS - ROWS // 3, 50.0)}
    assert reporting.vw_plan_performance({**t, "repayment_plans": plans}).count() == ROWS


def test_hot_account_travels_as_one_row_per_task(skew_aware):
    spark = skew_aware
    events = spark.range(0, ROWS, 1, 12).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("customer_id"),
        F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("sent_date"),
        F.lpad(F.col("id").cast("string"), 9, "0").alias("communication_id"),
    )
    first = first_touch(events, ["communication_id"])
    rows = {r[0]: r[1] for r in first.filter("customer_id = 'HOT'").collect()}
    assert rows == {"HOT": "000000000"}
    assert first.count() == ROWS - ROWS // 3 + 1
    parents = spark.createDataFrame([("1",), ("2",)], "customer_id string")
    assert orphan_count(events, parents, "customer_id", "n").first()[0] == ROWS - 2


def test_hot_client_is_split_where_clients_are_not_broadcast(skew_aware):
    from repaylens.plans import journey

    spark = skew_aware
    t = small_tables(spark)
    accounts = spark.range(0, ROWS, 1, 12).select(
        F.col("id").cast("string").alias("customer_id"),
        F.when(F.col("id") % 3 == 0, "K1").otherwise(F.concat(F.lit("X"), "id")).alias("client_id"),
    )
    by_type = journey.funnel_by_client_type({**t, "customers": accounts})
    assert "skew=true" in final_plan(by_type)
    found = {r["client_type"]: r["total_customers"] for r in by_type.collect()}
    assert found == {"Telecoms": ROWS // 3, None: ROWS - ROWS // 3}
