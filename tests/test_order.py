"""Order statistics by counting passes against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from penmark.operators import order
from penmark.operators import stats as st

SHARES = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def _check(spark, groups):
    rows = [(g, None if v is None else float(v)) for g, vs in groups.items() for v in vs]
    got = {r.g: r.q for r in order.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", SHARES).collect()}
    full = {g: [v for v in vs if v is not None] for g, vs in groups.items()}
    assert set(got) == {g for g, vs in full.items() if vs}
    for g, q in got.items():
        assert q == pytest.approx(np.quantile(full[g], SHARES), rel=1e-12, abs=0)


def test_percentiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    groups = {
        "one": [3.5], "two": [1, 2], "ties": [1, 1, 1, 2], "equal": [7.0] * 50, "nulls": [None, 4, None, 5, 6], "none": [None, None],
        None: rng.normal(size=101), "wide": [*(10.0 ** rng.uniform(-300, 300, 60)), 0.0, -1e300, 1e308, -1e308], "zeros": [0.0, -0.0, 1.0],
        "normal": rng.normal(size=1000), "near": 1 + np.arange(30) * 2.0**-52,
    }
    _check(spark, groups)
    monkeypatch.setattr(order, "BINS", 3)  # many passes
    _check(spark, {k: groups[k] for k in ("ties", "normal", "near", None)})


def test_one_large_group_of_distinct_doubles(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit("g").alias("g"), F.sqrt(F.col("id").cast("double")).alias("v"))
    q = order.percentiles(rows, ["g"], "v", [0.25, 0.5]).first().q
    for share, got in zip((0.25, 0.5), q):
        low = math.floor((n - 1) * share)
        part = (n - 1) * share - low
        assert got == pytest.approx((1 - part) * math.sqrt(low) + part * math.sqrt(low + 1), rel=1e-12)


def test_plans_hold_no_group(spark):
    rows = spark.createDataFrame([("m", "a", 1.0), ("m", "a", 2.0), ("m", "b", 5.0), ("m", "b", 9.0)], "method string, grp string, f1 double")
    for frame in (st.levene(rows, ["method"]), st.box_summary(rows, ["method"])):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan
