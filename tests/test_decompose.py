"""Decomposition by local regression against a point-by-point version."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantlens.operators import decompose
from plantlens.operators.loess import Stl, smooth


def one_fit(y, given, x, low, high, q):
    """A weighted line through the values low..high (from 1), at x."""
    n = len(y)
    h = max(x - low, high - x) + (max(q - n, 0) // 2)
    at = np.arange(low, high + 1)
    r = np.abs(at - x)
    w = np.array([1.0 if d <= 0.001 * h else (1 - (d / h) ** 3) ** 3 if d <= 0.999 * h else 0.0 for d in r]) * given[at - 1]
    if w.sum() <= 0:
        return None
    w = w / w.sum()
    a = (w * at).sum()
    c = (w * (at - a) ** 2).sum()
    if np.sqrt(c) > 0.001 * (n - 1):
        w = w * (1 + (x - a) / c * (at - a))
    return (w * y[at - 1]).sum()


def plain_smooth(y, given, q):
    n, out = len(y), []
    for x in range(1, n + 1):
        low = 1 if q >= n else min(max(x - (q - 1) // 2, 1), n - q + 1)
        found = one_fit(y, given, x, low, min(n, low + q - 1), q)
        out.append(y[x - 1] if found is None else found)
    return np.array(out)


def plain_stl(y, stl):
    n, p = len(y), stl.period
    trend, given = np.zeros(n), np.ones(n)
    for k in range(stl.outer + 1):
        for _ in range(stl.inner):
            cycle = np.zeros(n + 2 * p)
            for j in range(p):
                part, weights, q = (y - trend)[j::p], given[j::p], stl.seasonal
                m = len(part)
                fits = plain_smooth(part, weights, q)
                ends = one_fit(part, weights, 0, 1, min(q, m), q), one_fit(part, weights, m + 1, max(1, m - q + 1), m, q)
                cycle[j::p][:m + 2] = [fits[0] if ends[0] is None else ends[0], *fits, fits[-1] if ends[1] is None else ends[1]]
            low = cycle
            for width in (p, p, 3):
                low = np.convolve(low, np.ones(width) / width, "valid")
            season = cycle[p:-p] - plain_smooth(low, np.ones(n), stl.low_pass)
            trend = plain_smooth(y - season, given, stl.trend)
        if k < stl.outer:
            r = np.abs(y - season - trend)
            scale = 6 * np.median(r)
            given = np.array([1.0 if v <= 0.001 * scale else (1 - (v / scale) ** 2) ** 2 if v <= 0.999 * scale else 0.0 for v in r])
    return trend, season


def series(n, period, seed):
    rng, t = np.random.default_rng(seed), np.arange(n)
    return 5 + 0.02 * t + 2 * np.sin(2 * np.pi * t / period) + rng.normal(0, 0.3, n) + 8 * (rng.random(n) < 0.03)


@pytest.mark.parametrize("q", [3, 7, 41, 99])
def test_smoothing(q):
    rng = np.random.default_rng(q)
    y, given = rng.normal(size=60), rng.random(60)
    assert np.allclose(smooth(y, given, 1, 60, q), plain_smooth(y, given, q))
    inside = smooth(y[10:50], given[10:50], 11, 60, q)
    known = np.isfinite(inside)
    assert np.allclose(inside[known], plain_smooth(y, given, q)[10:50][known]) and (known.sum() == 40 - q + 1 if q < 40 else not known.any())


@pytest.mark.parametrize(("period", "n", "robust"), [(4, 90, False), (7, 61, True), (12, 25, False)])
def test_whole_decomposition(spark, period, n, robust):
    y = series(n, period, period)
    rows = [("a", t, float(v)) for t, v in enumerate(y)] + [(None, t, float(v)) for t, v in enumerate(y[::-1])] + [("a", n, None), ("short", 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, t int, x double").repartition(3)
    out = decompose.stl_decompose(df, "x", period, robust=robust, order_cols=["t"], series_cols=["k"], block_rows=40).toPandas()
    assert len(out) == len(rows)
    name = f"x_stl_p{period}_"
    for k, values in (("a", y), (None, y[::-1])):
        mine = out[(out.k.isna() if k is None else out.k == k) & out.x.notna()].sort_values("t")
        trend, season = plain_stl(values, Stl.of(period, robust=robust))
        assert np.allclose(mine[name + "trend"], trend) and np.allclose(mine[name + "seasonal"], season)
        assert np.allclose(mine[name + "trend"] + mine[name + "seasonal"] + mine[name + "resid"], mine.x)
    assert out[(out.k == "short") | out.x.isna()][name + "trend"].isna().all()


def test_long_series_in_pieces(spark):
    """Many pieces give what one piece gives, with the robustness scale found over all of them."""
    n, period = 1500, 3
    y = series(n, period, 1)
    y[::50] = 0.0
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(n), "x": y})).repartition(4)
    where = {"order_cols": ["t"], "robust": True, "inner": 1, "outer": 2, "seasonal": 5, "trend": 7}
    one = decompose.stl_decompose(df, "x", period, **where).toPandas().sort_values("t")
    many = decompose.stl_decompose(df, "x", period, **where, least_piece=10).toPandas().sort_values("t")
    assert 4 * Stl.of(period, 5, 7, None, True, 1, 2).reach < n / 2
    for part in decompose.PARTS:
        assert np.allclose(one[f"x_stl_p3_{part}"], many[f"x_stl_p3_{part}"], atol=1e-9)


def test_odd_settings(spark):
    with pytest.raises(ValueError):
        Stl.of(12, seasonal=6)
    with pytest.raises(ValueError):
        Stl.of(12, trend=9)
    assert (Stl.of(12).trend, Stl.of(12).low_pass, Stl.of(12).inner, Stl.of(12, robust=True).outer) == (23, 13, 5, 15)
    notes: list[str] = []
    df = spark.createDataFrame([(1, "no")], "t int, x string")
    assert decompose.stl_decompose(df, "x", 4, order_cols=["t"], warnings=notes).columns == ["t", "x"] and len(notes) == 1


def test_parts_are_not_broadcast(spark, monkeypatch):
    """Parts of rows are joined in parts of bounded size, missing series included."""
    rows = spark.range(700).select(F.col("id").alias("t"), F.when(F.col("id") % 2 == 0, F.lit("a")).alias("s"), F.sin("id").alias("x"))
    whole = decompose.stl_decompose(rows, "x", 5, order_cols=["t"], series_cols=["s"])
    monkeypatch.setattr(decompose, "JOIN_ROWS", 50, raising=False)
    found = decompose.stl_decompose(rows, "x", 5, order_cols=["t"], series_cols=["s"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, found.collect()))
    assert found.filter("x_stl_p5_trend IS NULL").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and ", 14), REPARTITION_BY_NUM" in plan
