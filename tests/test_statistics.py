"""Quantiles, histograms and summary statistics against brute force."""

import random
from decimal import Decimal

import numpy as np
import pytest

from repaylens.operators.distribution import describe, histogram, row_distribution, unit_distribution
from repaylens.operators.quantiles import exact_quantiles, group_extremes, select_ranks, unit_counts


def amounts(values, digits=2):
    return [(Decimal(v).scaleb(-digits),) if v is not None else (None,) for v in values]


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(7)
    spread = [rng.randrange(-500, 3_000_000_000) for _ in range(400)]
    return [0] * 900 + [None] * 25 + [1234] * 300 + spread + [rng.randrange(5000) for _ in range(700)]


@pytest.mark.parametrize("bucket_bits", [2, 9, 20, 50])
def test_quantiles_do_not_depend_on_buckets(spark, mixed, bucket_bits):
    df = spark.createDataFrame(amounts(mixed), "x decimal(18,2)").repartition(5)
    wanted = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    got = {r["quantile"]: r["value"] for r in exact_quantiles(df, {}, {"x": 2}, wanted, bucket_bits).collect()}
    known = np.array([v for v in mixed if v is not None])
    for q in wanted:
        assert got[q] == pytest.approx(np.quantile(known, q) / 100, abs=1e-9)


def test_quantiles_by_group(spark):
    rows = [("a", Decimal("1.00")), ("a", Decimal("2.00")), ("b", Decimal("5.55")), (None, Decimal("9.00"))]
    df = spark.createDataFrame(rows, "g string, x decimal(18,2)")
    got = {(r["g"], r["column_name"]): r["value"] for r in exact_quantiles(df, {"g": ["a", "b"]}, {"x": 2}, [0.5]).collect()}
    assert got == {("a", "x"): 1.5, ("b", "x"): 5.55}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x decimal(18,2)")
    assert exact_quantiles(df, {}, {"x": 2}, [0.5]).collect() == []


def test_histogram_equals_numpy(spark, mixed):
    values = [v for v in mixed if v is not None and v < 100_000]
    df = spark.createDataFrame(amounts(values), "x decimal(18,2)")
    got = histogram(df, "x").collect()
    counts, edges = np.histogram(np.array(values) / 100, bins=40)
    assert [r["row_count"] for r in got] == counts.tolist()
    assert [r["bin_start"] for r in got] == pytest.approx(edges[:-1].tolist())
    assert [r["bin_end"] for r in got] == pytest.approx(edges[1:].tolist())


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(Decimal("3.00"),)] * 4, "x decimal(18,2)")
    got = histogram(df, "x", bins=3).collect()
    assert [r["row_count"] for r in got] == [0, 4, 0]


def test_describe(spark, mixed):
    df = spark.createDataFrame(amounts(mixed), "x decimal(18,2)")
    r = describe(df, {"x": 2}).first()
    known = np.array([v for v in mixed if v is not None]) / 100
    assert r["value_count"] == len(known)
    assert r["mean"] == pytest.approx(known.mean(), abs=1e-4)
    assert r["std"] == pytest.approx(known.std(ddof=1), rel=1e-9)
    assert (r["min"], r["max"]) == (known.min(), known.max())
    assert [r["p25"], r["p50"], r["p75"]] == pytest.approx(np.quantile(known, [0.25, 0.5, 0.75]).tolist())


def test_distributions(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "k string, id int")
    assert [tuple(r) for r in row_distribution(df, "k", "n", "share").collect()] == [
        ("a", 2, 50.0),
        (None, 1, 25.0),
        ("b", 1, 25.0),
    ]
    assert {tuple(r) for r in unit_distribution(df, ["k"], "id", "n", "share").collect()} == {
        ("a", 1, 50.0),
        ("b", 1, 50.0),
    }


@pytest.mark.parametrize("width", [60_000, 5_000_000_000])
def test_radix_selection_leaves_few_values(spark, width):
    rng = random.Random(3)
    values = [10**9 + rng.randrange(width) for _ in range(20_000)]  # narrow or wide, far from zero
    df = spark.createDataFrame(amounts(values), "x decimal(18,2)")
    counts = unit_counts(df, {}, {"x": 2}).cache()
    groups = group_extremes(counts, ["column_name"])
    _, left = select_ranks(counts, groups, ["column_name"], [0.25, 0.5, 0.75])
    assert left.agg({"n": "sum"}).first()[0] < len(values) / 100


def test_quantiles_of_a_long_tail(spark):
    values = [*range(1, 2001), 10**15, -(10**15)]
    df = spark.createDataFrame(amounts(values), "x decimal(18,2)")
    got = {r["quantile"]: r["value"] for r in exact_quantiles(df, {}, {"x": 2}, [0.01, 0.5, 1.0]).collect()}
    for q, value in got.items():
        assert value == pytest.approx(np.quantile(np.array(values), q) / 100)


def test_unit_counts_of_parts_add_up(spark, mixed):
    df = spark.createDataFrame(amounts(mixed), "x decimal(18,2)")
    whole = unit_counts(df, {}, {"x": 2})
    parts = unit_counts(df.filter("x < 100"), {}, {"x": 2}).unionByName(unit_counts(df.filter("x >= 100"), {}, {"x": 2}))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
