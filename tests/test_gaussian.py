"""The normal distribution function against the C library, and in a plan."""

import math

import pytest
from pyspark.sql import functions as F

from strandwork.functions import gaussian
from strandwork.operators import errors


def test_erfc_to_fourteen_digits(spark):
    values = [i / 37 for i in range(-260, 900)] + [0.0, 1e-300, -1e-9, 1e-17, 6.0, 26.0, 30.0, -30.0, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", gaussian.erfc(F.col("x")).alias("y"), gaussian.normal_cdf(F.col("x")).alias("p")).collect():
        exact = math.erfc(r.x)
        # exp(-x*x) itself loses digits as x grows: the relative error follows x*x.
        assert abs(r.y - exact) <= 1e-14 * min(1.0, max(exact, 1e-300) * (1 + r.x * r.x if math.isfinite(r.x) else 1)), r
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=2e-12, abs=1e-14)


def test_null_and_nan(spark):
    df = spark.createDataFrame([(1, None), (2, math.nan)], "k int, x double")
    found = {r.k: r.p for r in df.select("k", gaussian.normal_cdf(F.col("x")).alias("p")).collect()}
    assert found[1] is None and math.isnan(found[2])


def test_overlap_needs_no_python(spark):
    columns = "low_mean double, low_std double, high_mean double, high_std double, dT double"
    pairs = spark.createDataFrame([(0.0, 1.0, 0.5, 2.0, 3.0)], columns)
    plan = errors.overlap_probability(pairs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
