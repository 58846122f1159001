"""Shape of the physical plans: what must and must not be in them."""

import re
from threading import Barrier

import pytest
from pyspark.sql import DataFrameWriter

import __spark_entry__ as contract
from repaylens.plans import experiment, journey, recovery, reporting
from repaylens.plans.catalog import analyses
from repaylens.sources.commerce import TEST_WINDOW, load_tables
from repaylens.sources.buckets import drop_buckets, store_in_buckets
from repaylens.sources.files import export_parquet, read_parquet_tables
from small_tables import small_tables

FOLDER = "/root/testdata/sf0.001"
# the corpus queries may run Python on the executors
QUERIES = {k: v for k, v in contract.queries().items() if k not in contract.LLM_QUERIES}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large_inputs(spark):
    """Plan as for inputs beyond the broadcast limit."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield load_tables(spark, FOLDER)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_rows_no_all_pairs_no_copies_per_distinct_count(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for banned in ("PythonUDF", "EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert banned not in text
    assert not re.search(r"Expand .*gid", text)


def test_columns_and_filters_reach_the_scan(large_inputs):
    text = plan(journey.overall_funnel(large_inputs))
    assert "ReadSchema: struct<c_custkey:bigint>" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text
    text = plan(recovery.plan_sustainability(large_inputs))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderpriority:string>" in text


@pytest.mark.parametrize(
    "name",
    ["ab_core_performance", "ab_ztests", "ab_by_balance_band", "ab_lift_summary", "ab_amount_ttest",
     "payment_plan_status", "recovery_describe", "dashboard_kpis", "vw_channel_performance"],
)
def test_clients_are_looked_up_only_where_used(large_inputs, name):
    assert "n_nationkey" not in plan(analyses(TEST_WINDOW)[name](large_inputs))


def test_clients_are_looked_up_after_accounts_are_counted(large_inputs):
    for name in ("vw_client_portfolio_summary", "view_row_counts"):
        lines = plan(analyses(TEST_WINDOW)[name](large_inputs)).splitlines()
        joins = [k for k, line in enumerate(lines) if "Join [client_id" in line]
        counts = [k for k, line in enumerate(lines) if "partial_" in line and "HashAggregate(keys=[" in line]
        assert joins and max(counts) > joins[0]


def test_unused_sides_are_not_read(large_inputs):
    # the flags of a plan need no line items, and bands need no upload date
    text = plan(recovery.recovery_by_balance_band(large_inputs))
    assert text.count("FileScan") == 4  # customer, lineitem and orders for payments, orders for plans
    assert plan(journey.funnel_by_balance_band(large_inputs)).count("FileScan") == 2


def test_facts_are_reduced_before_they_are_shuffled_to_accounts(large_inputs):
    text = plan(journey.overall_funnel(large_inputs))
    assert "partial_bit_or" in text
    # one exchange per side of the join, one for the nine totals
    assert text.count("Exchange") == 3
    assert text.count("Exchange SinglePartition") == 1


def test_account_totals_reuse_the_join_partitioning(large_inputs):
    text = plan(recovery.recovery_by_balance_band(large_inputs))
    shuffles = re.findall(r"Exchange hashpartitioning\((\w+)#", text)
    assert sorted(shuffles) == sorted(
        ["balance_band", "customer_id", "customer_id", "customer_id", "l_orderkey", "o_orderkey"]
    )


def test_both_first_touches_share_one_pass(large_inputs):
    text = plan(reporting.message_summary(large_inputs["communication_events"]))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_orphan_children_are_counted_before_the_join(large_inputs):
    from repaylens.operators.quality import orphan_count

    text = plan(orphan_count(large_inputs["communication_events"], large_inputs["customers"], "customer_id", "n"))
    assert "LeftAnti" in text
    assert text.index("LeftAnti") < text.index("partial_count(1)", text.index("LeftAnti"))


def test_clients_are_broadcast_only_within_the_limit(spark, large_inputs):
    assert "BroadcastHashJoin" not in plan(journey.funnel_by_client_type(large_inputs))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    again = load_tables(spark, FOLDER)
    assert "BroadcastHashJoin" in plan(journey.funnel_by_client_type(again))


def test_top_segments_use_a_bounded_sort(large_inputs):
    assert "TakeOrderedAndProject" in plan(recovery.weakest_segments(large_inputs))


def test_medians_do_not_gather_groups(large_inputs):
    text = plan(experiment.ab_amount_summary(large_inputs))
    assert "percentile" not in text and "collect_" not in text
    text = plan(recovery.recovery_describe(large_inputs))
    assert "percentile" not in text


def test_only_successful_payments_are_read_for_recovery(spark, large_inputs, tmp_path):
    for name, df in small_tables(spark).items():
        export_parquet(df, f"{tmp_path}/{name}.parquet")
    text = plan(recovery.recovery_by_balance_band(read_parquet_tables(spark, str(tmp_path))))
    assert "EqualTo(payment_status,Successful)" in text
    # on line items, the condition stands below the shuffle to the orders
    text = plan(recovery.recovery_by_balance_band(large_inputs))
    line = next(x for x in text.splitlines() if "Filter" in x and "l_returnflag" in x)
    assert text.index("Exchange hashpartitioning(l_orderkey") < text.index(line)


def test_star_join_over_buckets_has_no_exchange_by_account(spark, large_inputs):
    database, t = store_in_buckets(large_inputs, 8)
    try:
        text = plan(reporting.vw_customer_summary(t))
        assert "hashpartitioning(customer_id" not in text and text.count("SelectedBucketsCount: 8 out of 8") == 5
        totals = plan(reporting.vw_channel_performance(reporting.vw_customer_summary(t, client_columns=())))
        assert re.findall(r"Exchange hashpartitioning\((\w+)#", totals) == ["primary_channel"]
    finally:
        drop_buckets(spark, database)
    assert not spark.catalog.databaseExists(database)


def test_bucket_tables_are_written_side_by_side(spark, monkeypatch):
    t = small_tables(spark)
    meet, save = Barrier(2, timeout=60), DataFrameWriter.saveAsTable

    def both(writer, name, *args, **kwargs):
        meet.wait()  # until another table is about to be written
        save(writer, name, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", both)
    database, stored = store_in_buckets(t, 3)
    try:
        for name, df in t.items():
            assert sorted(map(str, stored[name].collect())) == sorted(map(str, df.collect()))
    finally:
        drop_buckets(spark, database)


def jobs_while(spark, build) -> int:
    group = f"count-{id(build)}"
    spark.sparkContext.setJobGroup(group, "")
    build()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "")
    return jobs


def test_matrix_starts_no_job_before_it_is_used(spark, large_inputs):
    assert jobs_while(spark, lambda: recovery.recovery_matrix(large_inputs)) == 0


@pytest.mark.parametrize("name", ["recovery_describe", "ab_amount_summary", "collected_histogram", "balance_histogram"])
def test_base_is_read_once_and_then_only_what_was_stored(spark, large_inputs, name):
    # nothing of the source tables is left in the plan; they ran once, for the stored copy
    text = plan(analyses(TEST_WINDOW)[name](large_inputs))
    scans = re.findall(r"Location: \w+ ?(?:\(\d+ paths\))?\[([^\]]*)\]", text)
    assert scans and not any("/testdata/" in place for place in scans)
    assert "Subquery" not in text


def test_view_row_counts_count_hashes(large_inputs):
    text = plan(reporting.view_row_counts(large_inputs))
    assert "Expand" not in text and "count(distinct" not in text
