"""Tails of distributions against textbook values and finite sums."""

import math

import pytest
from pyspark.sql import functions as F

from stopwise.functions import tails


def finite_sum(x, df):
    """Upper tail of chi-squared for whole degrees of freedom."""
    half = x / 2
    if df % 2 == 0:
        return math.exp(-half) * math.fsum(half**k / math.factorial(k) for k in range(df // 2))
    more = math.fsum(math.exp(-half + (k + 0.5) * math.log(half) - math.lgamma(k + 1.5)) for k in range(df // 2))
    return math.erfc(math.sqrt(half)) + more


def test_chi_squared(spark):
    cases = [(3.84145882069412, 1), (11.0704976935164, 5), (124.342113404004, 100)]
    cases += [(x, df) for df in (1, 2, 3, 7, 24, 150) for x in (1e-6, 0.3, 1.0, 5.0, 24.0, 40.0, 150.0, 400.0)]
    df = spark.createDataFrame([(float(x), n) for x, n in cases], "x double, df int")
    got = df.select("x", "df", tails.chi2_tail(F.col("x"), F.col("df")).alias("p")).collect()
    assert [round(r.p, 9) for r in got[:3]] == [0.05, 0.05, 0.05]
    for r in got:
        assert r.p == pytest.approx(finite_sum(r.x, r.df), rel=1e-8, abs=1e-13)


def test_normal(spark):
    df = spark.createDataFrame([(z,) for z in (0.0, 1e-9, 0.5, -1.959963984540054, 2.5, 8.0, -30.0)], "z double")
    for r in df.select("z", tails.normal_tail(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-8)


def test_odd_values(spark):
    df = spark.createDataFrame([(None, 3), (0.0, 3), (-1.0, 3), (2.0, 0), (5.0, None), (9000.0, 8000)], "x double, df int")
    got = [r.p for r in df.select(tails.chi2_tail(F.col("x"), F.col("df")).alias("p")).collect()]
    assert got[:5] == [None, 1.0, 1.0, None, None] and 0 < got[5] < 1e-13
    gamma = spark.range(1).select(*[tails.log_gamma(F.lit(a)) for a in (0.5, 1.0, 3.5, 200.0)]).first()
    assert list(gamma) == pytest.approx([math.lgamma(a) for a in (0.5, 1.0, 3.5, 200.0)], abs=1e-10)
