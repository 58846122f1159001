"""CSV and Parquet in and out, and the views."""

import datetime as dt
from decimal import Decimal

import pytest

from repaylens.functions.columns import mapped, money_as_double, month_of, rank_of, to_dates
from repaylens.plans.catalog import ACCOUNT_TABLES, EXPORTS, analyses, export_results
from repaylens.schemas import BAND_ORDER, SCHEMAS
from repaylens.session import shared_path
from repaylens.sources import files
from small_tables import small_tables


@pytest.fixture(scope="module")
def t(spark):
    return small_tables(spark)


def test_raw_csv_round_trip(spark, t, tmp_path):
    for name, df in t.items():
        df.coalesce(1).write.option("header", True).csv(f"{tmp_path}/{name}.csv")
    read = files.read_raw_tables(spark, str(tmp_path))
    assert set(read) == set(SCHEMAS)
    for name, df in t.items():
        assert read[name].schema.simpleString() == df.schema.simpleString()
        assert sorted(map(str, read[name].collect())) == sorted(map(str, df.collect()))


def test_bad_csv_is_refused(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1,x\n")
    with pytest.raises(Exception, match="MALFORMED|CAST|parse|FAILED_READ"):
        files.read_csv(spark, str(tmp_path / "bad.csv"), "a int, b int").collect()


def test_export_is_sorted_and_has_a_header(spark, t, tmp_path):
    out = str(tmp_path / "out")
    files.export_csv(t["customers"].select("customer_id", "debt_balance"), out, ["customer_id"], files=1)
    part = next((tmp_path / "out").glob("part-*.csv"))
    lines = part.read_text().splitlines()
    assert lines[0] == "customer_id,debt_balance"
    assert [line.split(",")[0] for line in lines[1:]] == ["A1", "A2", "A3", "A4", "A5", "A6", "A7"]
    assert lines[1] == "A1,100.0"


def test_results_are_exported_and_read_back(spark, t, tmp_path):
    from repaylens.functions.columns import money_as_double
    from repaylens.plans.catalog import EXPORTS, analyses, export_results

    names = ["overall_funnel", "ab_ztests", "customer_recovery_summary"]
    assert set(names) < set(EXPORTS) < set(analyses())
    export_results(t, str(tmp_path), names=names)
    for name in names:
        want = money_as_double(analyses()[name](t))
        back = files.read_csv(spark, f"{tmp_path}/{name}", want.schema)
        assert sorted(map(str, back.collect())) == sorted(map(str, want.collect()))
        if not EXPORTS[name]:
            assert back.collect() == want.collect()


def test_parquet_tables(spark, t, tmp_path):
    for name, df in t.items():
        files.export_parquet(df, f"{tmp_path}/{name}.parquet")
    read = files.read_parquet_tables(spark, str(tmp_path))
    assert read["payments"].count() == 7
    files.export_parquet(t["customers"], f"{tmp_path}/by_band", ["balance_band"])
    back = spark.read.parquet(f"{tmp_path}/by_band").filter("balance_band = 'Low'")
    assert back.count() == 4


def test_catalog_tables(spark, t):
    files.register_views(t)
    assert files.read_catalog_tables(spark)["clients"].count() == 2


def test_lazy_tables_build_once_when_asked(t):
    built = []

    def build():
        built.append(1)
        return t["clients"]

    lazy = files.LazyTables({"clients": build})
    assert list(lazy) == ["clients"] and len(lazy) == 1 and not built
    assert lazy["clients"] is lazy["clients"] and built == [1]


def test_stored_tables_lie_in_the_folder_of_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_path(spark).startswith(f"{named}/") and shared_path(spark) != shared_path(spark)
    out = files.stored(spark.range(3))
    assert out.count() == 3 and named in out.inputFiles()[0]


def test_without_a_shared_folder_nothing_is_stored():
    class Session:
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(Session())


def test_account_tables_are_computed_once(spark, t):
    from repaylens.plans.catalog import analyses, with_account_tables

    held = with_account_tables(t, names=["ab_ztests", "recovery_overall", "overall_funnel"])
    assert set(held) - set(t) == {"ab_customer_outcomes", "customer_recovery_summary"}
    assert set(with_account_tables(t, names=["overall_funnel"])) == set(t)
    for name in ("ab_by_client_type", "recovery_by_debt_age", "collected_histogram"):
        want, found = analyses()[name](t), analyses()[name](held)
        assert found.columns == want.columns and found.collect() == want.collect()
        text = found._jdf.queryExecution().executedPlan().toString()
        assert text.count("FileScan") >= 1 and "LocalTableScan" not in text and "ExistingRDD" not in text
        assert "vulnerability_flag" not in text  # only the columns used are read


def test_analyses_start_from_exported_accounts(spark, t, tmp_path):
    from repaylens.plans.catalog import ACCOUNT_TABLES, analyses, export_results, read_account_tables

    export_results(t, str(tmp_path), names=list(ACCOUNT_TABLES))
    held = read_account_tables(t, str(tmp_path))
    own = {name: held[name] for name in ACCOUNT_TABLES}  # no raw table at all
    run = analyses()
    for name in [
        "ab_core_performance", "ab_by_balance_band", "ab_by_client_type", "ab_lift_long", "ab_group_sizes",
        "ab_ztests", "ab_ztests_by_band", "ab_amount_ttest", "ab_amount_summary", "ab_view_check",
        "ab_rate_pivot_payment_rate", "recovery_overall", "recovery_by_client_type", "recovery_priority_segments",
        "recovery_matrix", "recovery_describe", "recovery_baseline_long", "payment_plan_status", "collected_histogram",
    ]:
        assert run[name](own).collect() == run[name](t).collect(), name


def test_every_result_reads_back_equal(spark, t, tmp_path):
    from repaylens.results import RESULTS, read_results

    assert set(RESULTS) == set(EXPORTS)
    export_results(t, str(tmp_path))
    held = read_results(spark, str(tmp_path))
    run = analyses()
    for name in EXPORTS:
        ours, read = money_as_double(run[name](t)), money_as_double(held[name])
        assert ours.dtypes == read.dtypes, name
        order = EXPORTS[name] or ours.columns
        assert ours.orderBy(*order).collect() == read.orderBy(*order).collect(), name


def test_analyses_start_from_results_alone(spark, t, tmp_path):
    from repaylens.results import read_results

    reports = [name for name in EXPORTS if name not in ACCOUNT_TABLES]
    export_results(t, str(tmp_path), names=reports)
    held = read_results(spark, str(tmp_path), reports)  # neither raw nor account tables
    run = analyses()
    for name in [
        *reports, "ab_core_rates_long", "ab_lift_long", "ab_rate_pivot_payment_rate", "ab_rate_pivot_plan_setup_rate",
        "weakest_segments", "recovery_matrix",
    ]:
        ours, theirs = (money_as_double(run[name](x)) for x in (t, held))
        assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect())), name


def test_a_result_of_other_types_fails(spark, tmp_path):
    from repaylens.results import read_results

    spark.createDataFrame([("m", "much")], "metric string, value string").write.option("header", True).csv(
        f"{tmp_path}/recovery_baseline_long"
    )
    with pytest.raises(Exception, match="much"):
        read_results(spark, str(tmp_path), ["recovery_baseline_long"])["recovery_baseline_long"].collect()


def test_local_sessions_have_a_folder_of_their_own():
    from repaylens import session

    def unset(**known):
        class Session:
            class conf:
                get = staticmethod(lambda key, default=None: known.get(key.removeprefix("spark."), default))

        return Session

    local = unset(**{"master": "local[4]", "app.id": "a1"})
    first, second = session.shared_path(local), session.shared_path(local)
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    for master in ("spark://host:7077", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_path(unset(master=master))


def test_column_helpers(spark):
    df = spark.createDataFrame([("2023-02-17", "High"), ("2023-02-01", None), ("2023-03-09", "Odd")], "d string, b string")
    out = to_dates(df, ["d"]).select(
        "d",
        month_of("d").alias("m"),
        rank_of("b", BAND_ORDER["balance_band"]).alias("r"),
        mapped("b", {"High": "H"}).alias("l"),
    )
    assert [tuple(r) for r in out.collect()] == [
        (dt.date(2023, 2, 17), dt.date(2023, 2, 1), 3, "H"),
        (dt.date(2023, 2, 1), dt.date(2023, 2, 1), 5, None),
        (dt.date(2023, 3, 9), dt.date(2023, 3, 1), 5, None),
    ]


def test_decimals_become_doubles(spark):
    from repaylens.functions.columns import money_as_double

    df = spark.createDataFrame([(Decimal("1.10"), 1)], "a decimal(18,2), b int")
    assert money_as_double(df).dtypes == [("a", "double"), ("b", "int")]
