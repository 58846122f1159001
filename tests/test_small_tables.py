"""Results on hand-made tables, worked out by hand."""

from datetime import date
from decimal import Decimal

import pytest

from repaylens.functions.columns import money_as_double
from repaylens.operators import quality as q
from repaylens.operators.distribution import histogram
from repaylens.plans import experiment, journey, quality, recovery, reporting
from repaylens.sources import commerce
from small_tables import COMMUNICATIONS, CUSTOMERS, small_tables


@pytest.fixture(scope="module")
def t(spark):
    return {name: df.cache() for name, df in small_tables(spark).items()}


def rows(df):
    return [tuple(r) for r in money_as_double(df).collect()]


def by_key(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in money_as_double(df).collect()}


def test_overall_funnel_keeps_silent_accounts_and_ignores_orphans(t):
    assert rows(journey.overall_funnel(t)) == [
        (1, "Account Uploaded", 7, 100.0),
        (2, "Invite Sent", 2, 28.57),
        (3, "Invite Delivered", 2, 28.57),
        (4, "Link Opened", 2, 28.57),
        (5, "Identity Verified", 0, 0.0),
        (6, "Balance Viewed", 2, 28.57),
        (7, "Payment Option Selected", 0, 0.0),
        (8, "Payment Made", 1, 14.29),
        (9, "Repayment Plan Created", 1, 14.29),
    ]


def test_drop_off_after_an_empty_stage_is_null(t):
    found = by_key(journey.stage_drop_off(t), "stage_order")
    assert 1 not in found
    assert found[4][3:] == (2, 100.0, 0.0)
    assert found[5][3:] == (2, 0.0, 100.0)
    assert found[6][3:] == (0, None, None)


def test_affordability_funnel(t):
    assert rows(journey.affordability_funnel(t)) == [
        (1, "Balance Viewed", 2, 100.0),
        (2, "Affordability Started", 1, 50.0),
        (3, "Affordability Completed", 1, 50.0),
        (4, "Repayment Plan Created", 1, 50.0),
        (5, "First Instalment Paid", 2, 100.0),
    ]


def test_channel_funnel_takes_lower_id_on_one_day_and_keeps_no_channel(t):
    found = by_key(journey.funnel_by_channel(t), "primary_channel")
    assert {k: r["total_customers"] for k, r in found.items()} == {"SMS": 4, "Email": 1, None: 2}
    assert found["SMS"]["link_opened_customers"] == 1  # A1 by M1, not by M2
    assert found[None]["link_open_rate"] is None


def test_band_order_puts_unknown_labels_last(t):
    bands = [r[0] for r in rows(journey.funnel_by_balance_band(t))]
    assert bands == ["Low", "Medium", "High", "Gigantic"]


def test_unknown_client_is_a_group(t):
    found = by_key(journey.funnel_by_client_type(t), "client_type")
    assert {k: r["total_customers"] for k, r in found.items()} == {
        "Telecoms": 3,
        "Utility Provider": 3,
        None: 1,
    }


def test_monthly_trend(t):
    found = rows(journey.monthly_funnel_trend(t))
    assert [(r[0], r[1]) for r in found] == [
        (date(2023, 1, 1), 2),
        (date(2023, 2, 1), 2),
        (date(2023, 3, 1), 2),
        (date(2023, 4, 1), 1),
    ]


def test_test_population_includes_both_edges_only(t):
    found = by_key(experiment.ab_customer_outcomes(t), "customer_id")
    assert {k: r["ab_test_group"] for k, r in found.items()} == {
        "A1": "Control",
        "A2": "Variant",
        "A3": "Variant",
        "A4": "Control",
    }
    assert len(found["A1"]) == 33
    assert found["A1"]["amount_collected"] == 50.0
    assert found["A1"]["avg_successful_payment_amount"] == 25.0
    assert found["A1"]["customer_recovery_rate"] == 0.5
    assert found["A3"]["payment_made_flag"] == 0 and found["A3"]["amount_collected"] == 0.0
    assert found["A4"]["one_off_payment_flag"] == 0 and found["A4"]["payment_made_flag"] == 1
    assert found["A2"]["max_missed_payment_count"] == 2


def test_population_shares(t):
    assert rows(experiment.ab_population(t)) == [
        ("Control", "Direct", 2, 50.0),
        ("Variant", "Supportive", 2, 50.0),
    ]


def test_group_means(t):
    found = by_key(experiment.ab_core_performance(t), "ab_test_group")
    assert found["Control"]["payment_rate"] == 100.0
    assert found["Control"]["avg_amount_collected_per_customer"] == 37.5
    assert found["Control"]["avg_customer_recovery_rate"] == 50.0
    assert found["Variant"]["plan_setup_rate"] == 50.0
    lift = money_as_double(experiment.ab_lift_summary(t)).first()
    assert lift["payment_rate_point_lift"] == -100.0
    assert lift["avg_amount_collected_per_customer_lift"] == -37.5


def test_band_without_a_group_gives_null_statistics(t):
    found = by_key(experiment.ab_ztests_by_band(t), "balance_band")
    assert list(found) == ["Low", "Medium", "High", "Very High"]
    low = found["Low"]  # two control accounts, no variant account
    assert (low["control_rate_percent"], low["variant_rate_percent"]) == (50.0, None)
    assert low["z_statistic"] is None and low["p_value"] is None
    assert low["significance"] == "Not statistically significant"
    assert low["direction"] == "No difference"


def test_no_variance_gives_null_z(t):
    found = by_key(experiment.ab_ztests(t), "metric")
    # both groups have one first instalment in two accounts
    assert found["First Instalment Paid Rate"]["z_statistic"] == 0.0
    assert found["First Instalment Paid Rate"]["p_value"] == 1.0


def test_medians_and_shares_of_amounts(t):
    found = by_key(experiment.ab_amount_summary(t), "ab_test_group")
    assert tuple(found["Control"]) == ("Control", 37.5, 37.5, 2, 2, 100.0)
    assert tuple(found["Variant"]) == ("Variant", 0.0, 0.0, 2, 0, 0.0)


def test_recovery_overall(t):
    r = money_as_double(recovery.recovery_overall(t)).first()
    assert r["total_customer_accounts"] == 7
    assert r["total_outstanding_balance"] == 5050.0
    assert r["total_amount_collected"] == 82.0
    assert r["overall_recovery_rate"] == 1.62
    assert r["customers_with_successful_payment"] == 3
    assert r["one_off_payment_customers"] == 2
    assert r["repayment_plan_customers"] == 2
    assert r["first_instalment_paid_customers"] == 2
    assert r["broken_plan_customers"] == 1


def test_zero_balance_has_no_rate(t):
    found = by_key(recovery.customer_recovery_summary(t), "customer_id")
    assert found["A6"]["customer_recovery_rate"] is None
    assert found["A6"]["amount_collected"] == 7.0
    assert found["A5"]["customer_recovery_rate"] == 0.0
    assert len(found["A5"]) == 24


def test_broken_rate_is_per_plan_account(t):
    found = by_key(recovery.recovery_by_balance_band(t), "balance_band")
    assert found["Medium"]["broken_plan_rate"] == 100.0
    assert found["High"]["broken_plan_rate"] is None
    assert found["Low"]["avg_debt_balance"] == 87.5


def test_payment_methods_keep_the_unknown_one(t):
    found = by_key(recovery.payment_method_performance(t), "payment_method")
    assert found["Card"]["total_payment_attempts"] == 4
    assert found["Card"]["payment_success_rate"] == 75.0
    assert found["Card"]["successful_amount_collected"] == 57.0
    assert found[None]["successful_amount_collected"] == 0.0
    assert found[None]["avg_successful_payment_amount"] is None


def test_plans(t):
    r = money_as_double(recovery.plan_sustainability(t)).first()
    assert tuple(r) == (4, 2, 50.0, 2, 50.0, 257.5, 61.25, 3.75, 1.25)
    found = by_key(recovery.plan_by_balance_band(t), "balance_band")
    assert {k: v["total_repayment_plans"] for k, v in found.items()} == {"Low": 1, "Medium": 2, None: 1}
    found = by_key(recovery.plan_by_affordability(t), "affordability_status")
    assert found["Affordability Completed"]["first_instalment_paid_rate"] == 100.0
    assert found["No Affordability Completed"]["broken_plan_rate"] == 100.0


def test_payment_plan_status_sums_to_accounts(t):
    found = {r["customer_status"]: r["customers"] for r in recovery.payment_plan_status(t).collect()}
    assert found == {"Payment + Plan": 1, "Payment Only": 2, "Plan Only": 1, "No Payment or Plan": 3}


def test_customer_summary(t):
    found = by_key(reporting.vw_customer_summary(t), "customer_id")
    assert len(found) == 7 and len(found["A1"]) == 54
    assert found["A1"]["primary_channel"] == "SMS"
    assert found["A2"]["first_communication_date"] == date(2022, 12, 30)
    assert found["A2"]["ab_test_group"] == "Variant"
    assert found["A7"]["ab_test_group"] is None
    assert found["A2"]["plan_status"] == "Broken"  # alphabetically after "Active"
    assert found["A5"]["plan_status"] == "No Plan"
    assert found["A4"]["days_to_first_payment"] == -8
    assert found["A2"]["avg_plan_amount"] == 450.0
    assert found["A2"]["active_plan_flag"] == 1 and found["A2"]["broken_plan_flag"] == 1
    assert found["A3"]["failed_payment_count"] == 1 and found["A3"]["reversed_payment_count"] == 1


def test_stage_first_dates(t):
    from repaylens.operators.accounts import attach_stages

    out = attach_stages(
        t["customers"].select("customer_id"),
        t["journey_events"],
        ["link_opened"],
        {"link_opened": "first_link_open_date", "payment_made": "first_payment_journey_date"},
    )
    found = by_key(out, "customer_id")
    assert tuple(found["A1"])[1:] == (1, date(2023, 1, 7), date(2023, 1, 8))
    assert tuple(found["A5"])[1:] == (0, None, None)


def test_first_dates_of_accounts_and_days_between(t):
    found = by_key(journey.journey_first_dates(t), "customer_id")
    assert len(found) == 7
    assert found["A1"]["first_link_opened_date"] == date(2023, 1, 7)
    assert found["A1"]["days_invite_delivered_to_link_opened"] == 1
    assert found["A1"]["days_upload_to_invite_delivered"] == 1
    assert found["A2"]["days_invite_delivered_to_repayment_plan_created"] == 3
    assert found["A2"]["days_invite_delivered_to_payment_made"] is None
    assert found["A5"]["first_invite_delivered_date"] is None


def test_stage_intervals(t):
    found = by_key(journey.stage_intervals(t), "to_event")
    opened = next(r for r in rows(journey.stage_intervals(t)) if tuple(r)[1:3] == ("invite_delivered", "link_opened"))
    assert tuple(opened)[3:] == (2, 0, 1.0, 1.0, 0.0, 100.0)
    # nobody was verified: no customers, no averages
    assert tuple(found["identity_verified"])[3:] == (0, 0, None, None, None, None)


def test_a_step_before_its_predecessor_is_counted_apart(t, spark):
    from small_tables import JOURNEY, event

    turned = [*JOURNEY, event(20, "A3", "2023-02-20", "invite_delivered"), event(21, "A3", "2023-02-18", "link_opened")]
    found = rows(journey.stage_intervals(small_tables(spark, journey_events=turned)))
    assert tuple(found[0])[3:] == (3, 1, 1.0, 1.0, 0.0, 100.0)


def test_quality_checks(t):
    assert set(rows(quality.dq_orphans(t))) == {
        ("communication_events", "customers", 1),
        ("journey_events", "customers", 1),
        ("payments", "customers", 0),
        ("repayment_plans", "customers", 1),
        ("customers", "clients", 1),
    }
    assert rows(quality.dq_duplicate_keys(t)) == [("payments", "P5", 2)]
    assert rows(quality.dq_invalid_amounts(t, "debt_balance")) == [(1,)]
    assert rows(quality.dq_invalid_amounts(t, "payment_amount")) == [(0,)]
    missing = {(r[0], r[1]): (r[2], round(r[3], 2)) for r in rows(quality.dq_missing_values(t))}
    assert missing == {
        ("customers", "customer_age_band"): (1, 14.29),
        ("customers", "region"): (1, 14.29),
        ("customers", "preferred_contact_channel"): (1, 14.29),
        ("journey_events", "device_type"): (13, 86.67),
        ("payments", "payment_method"): (2, 28.57),
    }
    assert ("clients", 2, 9) in rows(quality.dq_table_shapes(t))


def test_null_keys_are_orphans(spark):
    child = spark.createDataFrame([(None,), ("a",), ("b",), ("b",)], "k string")
    parent = spark.createDataFrame([("a",), (None,)], "k string")
    assert q.orphan_count(child, parent, "k", "n").first()[0] == 3


def test_empty_tables_give_empty_or_zero_results(spark):
    empty = small_tables(spark, **{n: [] for n in ("customers", "communication_events", "journey_events",
                                                   "payments", "repayment_plans", "clients")})
    assert rows(journey.overall_funnel(empty))[0] == (1, "Account Uploaded", 0, None)
    assert recovery.recovery_overall(empty).first()["total_customer_accounts"] == 0
    assert experiment.ab_ztests(empty).count() == 6
    assert {r[1] for r in rows(reporting.view_row_counts(empty))} == {0}
    assert rows(quality.dq_orphans(empty))[0][2] == 0


def test_repeated_account_rows_count_once_but_add_up(spark):
    twice = small_tables(spark, customers=CUSTOMERS + CUSTOMERS[:1])
    assert rows(journey.overall_funnel(twice))[0][2] == 7
    r = money_as_double(recovery.recovery_overall(twice)).first()
    assert (r["total_customer_accounts"], r["total_outstanding_balance"]) == (7, 5150.0)


def test_view_rows_equal_built_views(t):
    counted = {r[0]: r[1] for r in rows(reporting.view_row_counts(t))}
    built = reporting.build_views(t)
    assert counted == {name: built[name].count() for name in counted}


def test_registered_views_answer_sql(spark, t):
    reporting.register_reporting(t, store_summary=True)
    got = spark.sql(
        "SELECT sum(total_customers) AS n FROM vw_channel_performance"
        " UNION ALL SELECT count(*) FROM vw_plan_performance UNION ALL SELECT count(*) FROM payments"
    )
    assert [r[0] for r in got.collect()] == [7, 4, 7]


def test_first_touch_orders_missing_dates_first(spark):
    from repaylens.operators.accounts import first_touch

    late = [(*row[:3], None if row[0] == "M3" else row[3], *row[4:]) for row in COMMUNICATIONS]
    t = small_tables(spark, communication_events=late)
    found = by_key(first_touch(t["communication_events"], ["communication_id"]), "customer_id")
    assert found["A1"]["communication_id"] == "M3"


def test_money_stays_exact(spark):
    pennies = [
        (f"P{i}", "A1", "K1", date(2023, 1, 8), Decimal("0.10"), "Card", "One-off", "Successful", 0)
        for i in range(1000)
    ]
    t = small_tables(spark, payments=pennies)
    assert money_as_double(recovery.recovery_overall(t)).first()["total_amount_collected"] == 100.0


def test_labels_with_quotes(spark):
    from repaylens.operators.experiment import Proportion, proportion_ztest

    rows = [("c1", "It's", 1, "O'B"), ("c2", "It's", 0, "O'B"), ("c3", "New", 1, "O'B"), ("c4", "New", 1, "x")]
    df = spark.createDataFrame(rows, "customer_id string, ab_test_group string, won int, band string")
    got = proportion_ztest(
        df, [Proportion("won", "Won's", "O'B")], by="band", control="It's", variant="New"
    ).first()
    assert tuple(got)[:8] == ("O'B", "Won's", 1, 2, 50.0, 1, 1, 100.0)
    assert got["direction"] == "New higher"


def test_matrix_keeps_labels_outside_the_list(spark):
    rows = [("Low", "0-30", 1.0), ("Low", "Unknown", 2.0), ("Low", None, 3.0), ("High", "366+", 4.0)]
    segments = spark.createDataFrame(rows, "balance_band string, debt_age_band string, recovery_rate double")
    out = recovery.matrix(segments)
    assert out.columns[-3:] == ["366+", "Unknown", "(null)"]
    low = {r["balance_band"]: r for r in out.collect()}["Low"]
    assert (low["0-30"], low["Unknown"], low["(null)"]) == (1.0, 2.0, 3.0)


def test_recovery_matrix_maps_labels_outside_the_list(t, spark):
    odd = [(*row[:7], {"A1": "366+", "A3": None}.get(row[0], row[7]), *row[8:]) for row in CUSTOMERS]
    found = by_key(recovery.recovery_matrix(small_tables(spark, customers=odd)), "balance_band")
    assert found["Low"]["other_debt_ages"] == '{"366+":50.0}' and found["Low"]["91-180"] == 0.0
    assert found["High"]["other_debt_ages"] == '{"(null)":0.0}'
    assert found["Medium"]["other_debt_ages"] is None
    assert {r["other_debt_ages"] for r in recovery.recovery_matrix(t).collect()} == {None}


def test_views_of_nothing_have_no_rows(spark):
    none = small_tables(spark, customers=[], communication_events=[], journey_events=[], payments=[], repayment_plans=[])
    assert {r[1] for r in rows(reporting.view_row_counts(none))} == {0}
    assert len(rows(reporting.view_row_counts(none))) == 7


def test_histogram_of_a_constant_column(spark):
    df = spark.sql("SELECT CAST(5 AS DECIMAL(10, 2)) AS x FROM range(3)")
    rows = histogram(df, "x", bins=4).collect()
    assert (rows[0]["bin_start"], rows[-1]["bin_end"]) == (4.5, 5.5)
    assert sum(r["row_count"] for r in rows) == 3


def test_more_decimal_places_than_stated_are_refused(spark):
    df = spark.sql("SELECT CAST(5 AS DECIMAL(10, 4)) AS x")
    with pytest.raises(ValueError, match="decimal places"):
        histogram(df, "x")


def test_event_text_without_digits(spark):
    events = spark.sql(
        "SELECT 1L event_id, timestamp'2001-01-01' ts, 1L user_id, 'view' event_type, 1.0D value, 'none' props"
    )
    assert commerce.journey_events(events).select("device_type").first()[0] is None
