import math
import random

import pytest

from tillframe.functions.measures import average, exact_sum, margin_pct, total

INF = float("inf")


def summed(spark, values, expression=exact_sum):
    return spark.createDataFrame([(v,) for v in values], "x double").agg(expression("x")).first()[0]


def test_half_cents_round_up_in_any_order(spark):
    """The decimal sum ends in exactly half a cent; a plain sum falls to either side of it."""
    random.seed(1)
    units = [random.randrange(1, 10**9) for _ in range(20_000)]
    units.append(50 - sum(units) % 100)
    expected = sum(units) / 10**4
    values = [u / 10**4 for u in units]
    rounded = (sum(units) + 50) // 100 / 100
    for _ in range(3):
        random.shuffle(values)
        assert summed(spark, values) == expected
        assert summed(spark, values, total) == rounded


def test_nulls_and_no_values(spark):
    assert summed(spark, [None, 1.25, None]) == 1.25
    assert summed(spark, [None, None]) is None
    assert summed(spark, []) is None
    assert summed(spark, [None], average) is None
    assert summed(spark, [1.0, None, 2.0], average) == 1.5


def test_not_finite_and_huge(spark):
    assert math.isnan(summed(spark, [1.0, float("nan")]))
    assert summed(spark, [1.0, INF]) == INF and summed(spark, [1.0, -INF]) == -INF
    assert math.isnan(summed(spark, [INF, -INF]))
    assert summed(spark, [1e300, 1e300]) == pytest.approx(2e300)


def test_tiny_values_count(spark):
    assert summed(spark, [1e-7] * 4) == 4e-7
    tiny = spark.createDataFrame([(4e-7, 2e-7)], "sales double, profit double")
    assert tiny.agg(margin_pct()).first()[0] == 50.0


def test_large_sums_do_not_depend_on_the_order(spark):
    random.seed(2)
    values = [random.uniform(1e13, 9e13) for _ in range(5000)]
    sums = set()
    for _ in range(3):
        random.shuffle(values)
        sums.add(summed(spark, values))
    assert len(sums) == 1 and sums.pop() == pytest.approx(math.fsum(values), rel=1e-15)


def test_negative_and_small(spark):
    assert summed(spark, [-0.1] * 10) == -1.0
    assert summed(spark, [0.1, 0.2]) == 0.3
