import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import estimators as es
from quillspark.operators import series as s
from tests.golden import PAPERS, SPREAD_VW, TECH_VW, X_STL


def growth():
    lp = np.log(np.array(PAPERS, float))
    g = np.diff(lp)
    mth = (np.arange(1, len(lp)) % 12)
    return g - np.array([g[mth == m].mean() for m in mth])


def test_published_regressions():
    q1, q2 = es.hac_line(np.array(TECH_VW[1:]), growth()), es.hac_line(np.array(SPREAD_VW[1:]), growth())
    assert [round(q1[k], d) for k, d in (("b", 4), ("se", 4), ("t", 2), ("p", 3), ("r2", 3), ("n", 0))] == [0.0701, 0.0331, 2.12, 0.036, 0.029, 107]
    assert [round(q2[k], d) for k, d in (("b", 4), ("se", 4), ("p", 3))] == [0.0466, 0.0285, 0.105]


def test_published_lags():
    x, y = growth(), np.array(TECH_VW[1:])
    found = [es.hac_line(y[k:], x[: len(x) - k]) for k in range(4)]
    assert [round(f["b"], 4) for f in found] == [0.0701, -0.0488, 0.0655, -0.0501]
    assert [round(f["p"], 3) for f in found] == [0.036, 0.160, 0.026, 0.208]


def test_published_break():
    ks, f = es.sup_f(np.array(SPREAD_VW[1:]), growth())
    assert (len(ks), round(float(f.max()), 2)) == (76, 4.36)
    month = int(ks[f.argmax()])  # position 1 is 2017-02
    assert (2017 + month // 12, month % 12 + 1) == (2020, 9)
    draws = np.array(es.sup_f_draws(np.array(SPREAD_VW[1:]), growth(), np.arange(400)))
    assert 0.08 < (draws >= f.max()).mean() < 0.22


def test_published_seasonal_adjustment():
    lp = np.log(np.array(PAPERS, float))
    assert np.allclose(np.diff(lp - es.stl_periodic(lp))[:12], X_STL, atol=1e-10)


def test_prefix_break_statistic_equals_direct():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=60), rng.normal(size=60)
    ks, f = es.sup_f(y, x)
    for k, value in zip(ks, f, strict=True):
        late = (np.arange(1, 61) >= k).astype(float)
        small, large = es.Fit(y, es.with_const(x)), es.Fit(y, np.column_stack([np.ones(60), x, late, late * x]))
        assert math.isclose(value, ((small.rss - large.rss) / 2) / (large.rss / 56), rel_tol=1e-8)


def test_dropped_columns_and_guards():
    x = np.arange(20.0)
    assert es.independent(np.column_stack([np.ones(20), x, 2 * x])) == [0, 1]
    assert es.hac_line(np.ones(50), x.repeat(3)[:50]) is None
    assert es.ardl(x[:10], x[:10]) == []
    assert es.cumulative(x, x) == []
    assert es.granger(x[:5], x[:5]) is None
    assert es.adf(np.ones(50)) is None
    assert es.irf(x, x) == []


def test_ardl_recovers_effects():
    rng = np.random.default_rng(2)
    x = rng.normal(size=2000)
    y = np.zeros(2000)
    for t in range(3, 2000):
        y[t] = 0.5 * x[t] - 0.2 * x[t - 2] + 0.3 * y[t - 1] + 0.1 * rng.normal()
    b = {r["term"]: r["b"] for r in es.ardl(y, x)}
    assert np.allclose([b[i] for i in (0, 1, 2, 3)], [0.5, 0, -0.2, 0], atol=0.02)
    assert math.isclose(b[-1], sum(b[i] for i in range(4)), rel_tol=1e-9)
    assert es.granger(y, x)["p"] < 1e-6 < es.granger(x, y)["p"]


def test_var_order_and_first_response():
    rng = np.random.default_rng(3)
    z = np.zeros((1500, 2))
    for t in range(2, 1500):
        z[t] = [[0.2, 0.0], [0.0, 0.1]] @ z[t - 1] + [[0.0, 0.6], [0.0, 0.3]] @ z[t - 2] + rng.normal(size=2)
    assert es.var_order(z) == 2
    rows = es.irf(z[:, 0], z[:, 1], runs=30)
    assert rows[0]["irf"] == 0
    assert rows[0]["star"] == "*"
    assert abs(rows[2]["irf"] - 0.6) < 0.1


def test_unit_root():
    rng = np.random.default_rng(4)
    e = rng.normal(size=400)
    assert es.adf(e)["p"] == 0.01
    assert es.adf(np.cumsum(e))["p"] > 0.1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(0.0001, 1), min_size=2, max_size=12, unique=True))
def test_bh_is_monotone(p):
    order = sorted(p)
    adjusted = np.minimum.accumulate([min(1, x * len(p) / (i + 1)) for i, x in reversed(list(enumerate(order)))])[::-1]
    assert all(a >= x - 1e-12 for a, x in zip(adjusted, order, strict=True))
    assert list(adjusted) == sorted(adjusted)


def test_windows(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 4, 40.0), ("b", 1, 5.0)], "k string, t int, x double")
    w = s.by(["k"], ["t"])
    out = {(r.k, r.t): r for r in df.select("k", "t", s.calendar_lag("x", "t", w).alias("c"), F.lag("x").over(w).alias("r")).collect()}
    assert (out["a", 2].c, out["a", 4].c, out["a", 4].r) == (10.0, None, 20.0)
    q = s.quantile_bucket(spark.createDataFrame([(1, float(i)) for i in (1, 1, 2, 3, 4, 5)], "g int, x double"), "x", ["g"], 5, "b")
    assert sorted((r.x, r.b) for r in q.collect()) == [(1.0, 1), (1.0, 1), (2.0, 2), (3.0, 3), (4.0, 4), (5.0, 5)]
    m = s.mode_of(spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "g int, v string"), ["g"], "v", "m")
    assert [tuple(r) for r in m.collect()] == [(1, "a")]
    c = df.filter("k = 'b'").agg(s.compounded(F.lit(0.1)).alias("c"), s.weighted_mean(F.col("x"), F.lit(2.0)).alias("w"), s.weighted_mean(F.col("x"), F.lit(None)).alias("n")).first()
    assert (round(c.c, 10), c.w, c.n) == (0.1, 5.0, None)
