"""Formulas against published results, starting from the published counts."""

import pytest
from pyspark.sql import functions as F

from repaylens.functions.stats import normal_p_value, student_p_value
from repaylens.operators.accounts import flag_name
from repaylens.operators.experiment import Proportion, mean_lifts, proportion_ztest
from repaylens.operators.funnel import drop_off, percent_of_first, segment_funnel, stage_counts
from repaylens.plans.experiment import TESTED_FLAGS, plan_tests_by_band
from repaylens.plans.recovery import high_exposure, matrix, weakest
from repaylens.schemas import CONTROL, JOURNEY_STAGES, VARIANT

# Accounts at each stage, percent of the first stage, conversion and drop-off.
FUNNEL = [
    ("Account Uploaded", 10000, 100.0, None, None),
    ("Invite Sent", 10000, 100.0, 100.0, 0.0),
    ("Invite Delivered", 9772, 97.72, 97.72, 2.28),
    ("Link Opened", 3695, 36.95, 37.81, 62.19),
    ("Identity Verified", 2458, 24.58, 66.52, 33.48),
    ("Balance Viewed", 2238, 22.38, 91.05, 8.95),
    ("Payment Option Selected", 1817, 18.17, 81.19, 18.81),
    ("Payment Made", 1206, 12.06, 66.37, 33.63),
    ("Repayment Plan Created", 743, 7.43, 61.61, 38.39),
]

# Stage counts by first channel (all, delivered, opened, verified, viewed, selected,
# paid, plan) and the four rates.
CHANNELS = {
    "SMS": ((5922, 5814, 2390, 1604, 1461, 1181, 797, 494), (41.11, 67.11, 13.71, 8.5)),
    "Email": ((3015, 2908, 1022, 684, 625, 507, 330, 206), (35.14, 66.93, 11.35, 7.08)),
    "Letter": ((1058, 1045, 279, 166, 148, 125, 76, 40), (26.7, 59.5, 7.27, 3.83)),
    "Agent Referral": ((5, 5, 4, 4, 4, 4, 3, 3), (80.0, 100.0, 60.0, 60.0)),
}

# Successes of 929 control and 1,007 variant accounts, rates, lift, z, p, verdict.
ZTESTS = {
    "Link Open Rate": (376, 445, 40.4736, 44.1907, 3.717, 1.6533, 0.0983, False),
    "Payment Rate": (103, 136, 11.0872, 13.5055, 2.4183, 1.616, 0.1061, False),
    "One-off Payment Rate": (63, 48, 6.7815, 4.7666, -2.0149, -1.9051, 0.0568, False),
    "Plan Setup Rate": (57, 106, 6.1356, 10.5263, 4.3907, 3.4758, 0.0005, True),
    "First Instalment Paid Rate": (42, 90, 4.521, 8.9374, 4.4164, 3.8516, 0.0001, True),
    "Broken Plan Rate": (32, 27, 3.4446, 2.6812, -0.7633, -0.9762, 0.329, False),
}

# Plans and accounts per group by balance band; rates, lift, z, p.
BAND_TESTS = {
    "Low": ((9, 332, 23, 331), (2.7108, 6.9486, 4.2378, 2.5456, 0.0109)),
    "Medium": ((32, 387, 59, 465), (8.2687, 12.6882, 4.4194, 2.0795, 0.0376)),
    "High": ((16, 210, 24, 211), (7.619, 11.3744, 3.7554, 1.3139, 0.1889)),
}

# Balance band, debt age, accounts, outstanding, collected, recovery rate.
SEGMENTS = [
    ("Very High", "365+", 122, 682843.71, 4763.69, 0.7),
    ("Very High", "91-180", 166, 906339.41, 7314.86, 0.81),
    ("Very High", "31-90", 64, 351203.96, 2906.1, 0.83),
    ("Very High", "181-365", 184, 1042260.74, 10635.3, 1.02),
    ("Very High", "0-30", 38, 209623.1, 2742.26, 1.31),
    ("High", "365+", 303, 617653.11, 9026.41, 1.46),
    ("Medium", "365+", 549, 357972.31, 7748.7, 2.16),
    ("High", "0-30", 143, 285494.0, 8069.16, 2.83),
    ("High", "181-365", 535, 1087594.45, 31472.18, 2.89),
    ("High", "91-180", 595, 1205166.39, 45961.66, 3.81),
    ("Medium", "91-180", 1179, 737996.48, 29105.41, 3.94),
    ("High", "31-90", 277, 539096.03, 25630.66, 4.75),
    ("Medium", "181-365", 887, 549752.55, 27832.17, 5.06),
    ("Medium", "31-90", 868, 547845.83, 31782.37, 5.8),
    ("Low", "91-180", 902, 134542.21, 9541.83, 7.09),
    ("Low", "365+", 298, 45933.5, 3712.04, 8.08),
    ("Low", "181-365", 618, 91810.78, 7807.17, 8.5),
    ("Medium", "0-30", 582, 356051.07, 30977.48, 8.7),
    ("Low", "31-90", 914, 131609.01, 16656.23, 12.66),
    ("Low", "0-30", 776, 115813.42, 17232.74, 14.88),
]


def accounts_with_counts(spark, n, counts, **labels):
    """``n`` accounts of which the first ``counts[flag]`` have each flag."""
    base = spark.range(n).withColumnRenamed("id", "customer_id")
    return base.select(
        F.concat_ws("-", *[F.lit(v) for v in labels.values()], F.col("customer_id")).alias("customer_id"),
        *[F.lit(v).alias(k) for k, v in labels.items()],
        *[(F.col("customer_id") < c).cast("int").alias(f) for f, c in counts.items()],
    )


@pytest.fixture(scope="module")
def stage_table(spark):
    labels = {flag_name(s): label for s, label in JOURNEY_STAGES.items()}
    published = {label: n for label, n, *_ in FUNNEL}
    accounts = accounts_with_counts(spark, 10000, {f: published[label] for f, label in labels.items()})
    return stage_counts(accounts, labels, everyone="Account Uploaded")


def test_funnel_percentages(stage_table):
    got = [tuple(r) for r in percent_of_first(stage_table, "p").collect()]
    assert got == [(i, label, n, p) for i, (label, n, p, *_) in enumerate(FUNNEL, start=1)]


def test_stage_drop_off(stage_table):
    got = [(r[1], r[4], r[5]) for r in drop_off(stage_table).collect()]
    assert got == [(label, c, d) for label, _, _, c, d in FUNNEL[1:]]


def test_channel_rates(spark):
    stages = list(JOURNEY_STAGES)[1:]
    parts = [
        accounts_with_counts(
            spark, counts[0], dict(zip(map(flag_name, stages), counts[1:])), primary_channel=channel
        )
        for channel, (counts, _) in CHANNELS.items()
    ]
    accounts = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    rates = ["link_open_rate", "verification_after_open_rate", "payment_conversion_rate", "plan_setup_rate"]
    got = segment_funnel(accounts, ["primary_channel"], stages, rates).collect()
    assert {r[0]: (tuple(r[1:9]), tuple(r[9:])) for r in got} == CHANNELS


@pytest.fixture(scope="module")
def ab_accounts(spark):
    def group(name, n, index):
        return accounts_with_counts(
            spark, n, {f: ZTESTS[title][index] for f, title in TESTED_FLAGS.items()}, ab_test_group=name
        )

    return group(CONTROL, 929, 0).unionByName(group(VARIANT, 1007, 1))


def test_ztests(ab_accounts):
    got = proportion_ztest(ab_accounts, [Proportion(c, t) for c, t in TESTED_FLAGS.items()]).collect()
    assert [r["metric"] for r in got] == list(ZTESTS)
    for r in got:
        x1, x2, p1, p2, lift, z, p, significant = ZTESTS[r["metric"]]
        assert tuple(r)[1:10] == (x1, 929, p1, x2, 1007, p2, lift, z, p)
        assert r["significance"].startswith("Statistically") == significant
        assert r["direction"] == ("Variant higher" if lift > 0 else "Control higher")


def test_lifts(ab_accounts):
    points = {
        "open": "link_opened_flag",
        "pay": "payment_made_flag",
        "one_off": "one_off_payment_flag",
        "plan": "repayment_plan_created_flag",
    }
    assert tuple(mean_lifts(ab_accounts, points, {}).first()) == (
        "Variant vs Control", 3.72, 2.42, -2.01, 4.39,
    )


def test_band_tests(spark):
    parts = []
    for band, ((x1, n1, x2, n2), _) in BAND_TESTS.items():
        for name, x, n in ((CONTROL, x1, n1), (VARIANT, x2, n2)):
            parts.append(
                accounts_with_counts(
                    spark, n, {"repayment_plan_created_flag": x}, balance_band=band, ab_test_group=name
                )
            )
    accounts = parts[0]
    for part in parts[1:]:
        accounts = accounts.unionByName(part)
    got = plan_tests_by_band(accounts).collect()
    # the fourth band has no test accounts, so its statistics are null
    want = {band: want for band, (_, want) in BAND_TESTS.items()} | {"Very High": (None,) * 5}
    assert {r[0]: tuple(r[2:7]) for r in got} == want
    assert [r["metric"] for r in got] == [f"Plan Setup Rate - {b} Balance" for b in want]


def test_p_values(spark):
    def p(expression):
        return spark.range(1).select(expression).first()[0]

    assert round(p(student_p_value("1.0981D", "1850D")), 4) == 0.2723
    assert abs(p(student_p_value("2.228138852D", "10D")) - 0.05) < 1e-9
    assert abs(p(student_p_value("-1D", "1D")) - 0.5) < 1e-9
    assert abs(p(student_p_value("1.959963985D", "1e9D")) - 0.05) < 1e-8
    assert abs(p(normal_p_value("1.959963985D")) - 0.05) < 1e-9
    assert p(normal_p_value("0D")) == pytest.approx(1.0, abs=1e-12)
    assert p(normal_p_value("-6D")) == pytest.approx(1.973175290e-9, rel=1e-6)
    assert p(normal_p_value("10000D")) == 0.0
    assert p(normal_p_value("cast(NULL AS double)")) is None


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame(
        SEGMENTS,
        "balance_band string, debt_age_band string, total_customers long, "
        "total_outstanding_balance double, total_amount_collected double, recovery_rate double",
    )


def test_segments_are_whole(segments):
    total = segments.agg(F.sum("total_customers"), F.round(F.sum("total_outstanding_balance"), 2)).first()
    assert tuple(total) == (10000, 9996602.06)


def test_high_exposure_segments_in_order(segments):
    got = [(r[0], r[1]) for r in high_exposure(segments).collect()]
    assert got == [
        ("High", "91-180"),
        ("High", "181-365"),
        ("Very High", "181-365"),
        ("Very High", "91-180"),
        ("Very High", "365+"),
        ("High", "365+"),
    ]


def test_weakest_segments(segments):
    got = weakest(segments).collect()
    assert [(r[0], r[1]) for r in got] == [s[:2] for s in SEGMENTS[:10]]
    assert got[0]["segment"] == "Very High | 365+"


def test_matrix(segments):
    got = {r[0]: tuple(r[1:]) for r in matrix(segments).collect()}
    assert list(got) == ["Low", "Medium", "High", "Very High"]
    assert got["Low"] == (14.88, 12.66, 7.09, 8.5, 8.08)
    assert got["Very High"] == (1.31, 0.83, 0.81, 1.02, 0.7)
