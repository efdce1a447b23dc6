import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywright.functions.dates import month_key, month_number, utc_stamp
from tallywright.functions.numbers import (
    finite, ratio, round2, split_amounts, sum_parts, sum_total,
)


def doubles(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x DOUBLE")


def total(spark, values):
    parts = split_amounts(doubles(spark, values), ["x"]).agg(*sum_parts("x"))
    return parts.select(sum_total("x")).first()[0]


def test_round2_is_python_round(spark):
    rng = random.Random(5)
    values = [
        2.675, 0.125, 1.115, 1.005, 0.375, -0.125, -2.675, 0.0, -0.001, 0.005, 0.015, 0.025,
        1e13 + 0.125, 4.6e13 + 0.01, 8.9e13 + 0.37, 9.5e13, 1e300, -1e16,
    ]
    values += [rng.randrange(-(10**7), 10**7) / 1000 for _ in range(5000)]
    values += [rng.randrange(-(10**6), 10**6) / 8 for _ in range(5000)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-5, 16) for _ in range(5000)]
    values += [rng.randrange(10**9) / 200 for _ in range(5000)]
    got = doubles(spark, values).select("x", round2("x").alias("r")).collect()
    assert [r.r for r in got] == [round(r.x, 2) for r in got]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(-(10**12), 10**12), min_size=1, max_size=40))
def test_sum_of_six_decimals_is_exact(spark, millionths):
    values = [float(Decimal(m).scaleb(-6)) for m in millionths]
    assert total(spark, values) == float(Decimal(sum(millionths)).scaleb(-6))


@pytest.mark.parametrize(
    "values, want",
    [
        ([], 0.0),
        ([0.1] * 10, 1.0),
        ([1e300, 1.0], 1e300),
        ([3e12 + 0.25] * 5, 15e12 + 1.25),
        ([-5.5], -5.5),
        ([5e12, 1.5, -5e12], 1.5),
        ([1e-9] * 4, 4e-9),
    ],
)
def test_sum_edges(spark, values, want):
    assert total(spark, values) == pytest.approx(want, rel=1e-15, abs=0)


def test_sum_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    values = [round(rng.uniform(-1e6, 1e7), 4) for _ in range(20_000)]
    df = doubles(spark, values)
    sums = {
        split_amounts(df.repartition(n), ["x"]).agg(*sum_parts("x")).select(sum_total("x")).first()[0]
        for n in (1, 3, 16)
    }
    assert sums == {float(sum(Decimal(repr(v)) for v in values))}


def test_ratio_and_finite(spark):
    df = spark.createDataFrame([(6.0, 4.0), (1.0, 0.0), (1.0, -2.0)], "a DOUBLE, b DOUBLE")
    assert [r[0] for r in df.select(F.expr(ratio("a", "b", 100))).collect()] == [150.0, None, None]
    odd = doubles(spark, [1.5, float("nan"), float("inf"), float("-inf")])
    assert [r[0] for r in odd.select(finite(F.col("x"))).collect()] == [1.5, None, None, None]


def test_months(spark):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ'2024-01-31 23:59:59' d UNION ALL SELECT TIMESTAMP_NTZ'1999-12-01'"
        " UNION ALL SELECT TIMESTAMP_NTZ'0009-02-01'"
    )
    got = sorted(r[0] for r in df.select(month_key(month_number(F.col("d")))).collect())
    assert got == ["0009-02", "1999-12", "2024-01"]
    assert len(df.select(utc_stamp()).first()[0]) == len("2024-01-01T00:00:00.000000")
