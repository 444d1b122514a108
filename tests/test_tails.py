import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from penmark.functions import tails
from penmark.functions.tukey import normal_cdf, studentized_range_tail


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("f, d1, d2, p", [(4.102821, 2, 10, 0.05), (4.964603, 1, 10, 0.05), (2.866081, 4, 20, 0.05),
                                          (161.4476, 1, 1, 0.05), (3.841459, 1, 5_000_000, 0.05), (0.0, 3, 9, 1.0)])
def test_f_tail_table_values(spark, f, d1, d2, p):
    assert value(spark, tails.f_tail(F.lit(f), F.lit(d1), F.lit(d2))) == pytest.approx(p, abs=2e-6)


def test_t_tail(spark):
    assert value(spark, tails.t_tail(F.lit(2.228139), F.lit(10))) == pytest.approx(0.05, abs=1e-6)


def test_normal_tail_and_quantile(spark):
    assert value(spark, tails.normal_tail(F.lit(1.959964))) == pytest.approx(0.025, abs=1e-7)
    assert value(spark, tails.normal_tail(F.lit(-1.0))) == pytest.approx(0.841344746, abs=1e-8)
    for p, z in [(0.5, 0.0), (0.975, 1.959963985), (0.001, -3.090232306), (1e-12, -7.034483825)]:
        assert value(spark, tails.normal_quantile(F.lit(p))) == pytest.approx(z, abs=1e-8)


@pytest.mark.parametrize("yn, ny, p", [(0, 0, 1.0), (5, 1, 0.21875), (1, 5, 0.21875), (10, 0, 2 / 1024)])
def test_mcnemar_exact(spark, yn, ny, p):
    got = value(spark, tails.mcnemar_exact(F.lit(yn).cast("bigint"), F.lit(ny).cast("bigint")))
    assert got == pytest.approx(p, abs=1e-12)


@pytest.mark.parametrize("a, b", [(5200, 5000), (50_200, 49_800), (50_201, 49_800), (2_000_500, 2_000_000)])
def test_mcnemar_large_counts_near_the_normal_form(spark, a, b):
    got = value(spark, tails.mcnemar_exact(F.lit(a).cast("bigint"), F.lit(b).cast("bigint")))
    assert got == pytest.approx(math.erfc((a - b - 1) / math.sqrt(a + b) / math.sqrt(2)), abs=1e-4)


@pytest.mark.parametrize("yn, ny", [(3, 8), (40, 61), (700, 650)])
def test_mcnemar_equals_the_binomial_sum(spark, yn, ny):
    got = value(spark, tails.mcnemar_exact(F.lit(yn).cast("bigint"), F.lit(ny).cast("bigint")))
    want = min(1, 2 * sum(math.comb(yn + ny, i) for i in range(min(yn, ny) + 1)) / 2 ** (yn + ny))
    assert got == pytest.approx(want, abs=1e-10)


@pytest.mark.parametrize("f, d1, d2", [(1.0, 300, 1_000_000), (1.1, 500, 5000), (1.2, 2000, 2000), (1.5, 7, 300_000)])
def test_f_tail_of_many_groups(spark, f, d1, d2):
    v = np.linspace(1e-9, math.pi / 2 - 1e-9, 4_000_001)
    g = (d2 - 1) * np.log(np.cos(v)) + (d1 - 1) * np.log(np.sin(v))
    share = np.exp(g - g.max())
    want = share[v > math.atan(math.sqrt(d1 * f / d2))].sum() / share.sum()
    assert value(spark, tails.f_tail(F.lit(f), F.lit(d1), F.lit(d2))) == pytest.approx(want, abs=2e-4)


@pytest.mark.parametrize("q, k, df", [(3.877, 3, 10), (3.958, 4, 20), (2.772, 2, 100_000), (4.041, 5, 60 - 20), (6.085, 2, 2)])
def test_studentized_range_table_values(spark, q, k, df):
    assert value(spark, studentized_range_tail(F.lit(q), F.lit(float(k)), F.lit(float(df)))) == pytest.approx(0.05, abs=6e-4)


def test_studentized_range_of_two_is_student(spark):
    for q, df in [(1.0, 5), (3.0, 8), (2.0, 40), (9.0, 3), (0.0, 4)]:
        got = value(spark, studentized_range_tail(F.lit(q), F.lit(2.0), F.lit(float(df))))
        assert got == pytest.approx(value(spark, tails.t_tail(F.lit(q / math.sqrt(2)), F.lit(df))), abs=1e-7)


def test_studentized_range_edges(spark):
    undefined = [(None, 3.0, 5.0), (math.nan, 3.0, 5.0), (math.inf, 3.0, 5.0), (2.0, 1.0, 5.0), (2.0, 3.0, 0.0)]
    for q, k, df in undefined:
        assert value(spark, studentized_range_tail(F.lit(q).cast("double"), F.lit(k), F.lit(df))) is None
    assert value(spark, studentized_range_tail(F.lit(200.0), F.lit(20.0), F.lit(50.0))) == pytest.approx(0.0, abs=1e-7)


def test_normal_cdf(spark):
    for x in (-9.0, -7.5, -6.0, -2.0, -0.3, 0.0, 0.4, 1.96, 5.0, 8.0):
        assert value(spark, normal_cdf(F.lit(x))) == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=1e-12)
