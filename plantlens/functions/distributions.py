"""Tail areas and quantiles of the distributions the tests and limits need.

All functions are vectorised over numpy arrays. They only ever see small
inputs: one row per compared variable, or a scalar limit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def beta_inc(a, b, x):
    """Regularised incomplete beta I_x(a, b) by the continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z)
                       + _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q)) / p
        tiny = 1e-300
        c = np.ones_like(z)
        d = 1.0 - (p + q) * z / (p + 1.0)
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 2000):
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            for step in (even, odd):
                d = 1.0 + step * d
                d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1.0 + step / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(~np.isfinite(h) | (np.abs(d * c - 1.0) < 1e-15)):
                break
        value = np.where(z <= 0.0, 0.0, front * h)
    out = np.where(swap, 1.0 - value, value)
    return np.where(np.isnan(a) | np.isnan(b) | np.isnan(x), np.nan, out)


def gamma_upper(a, x):
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = ~(np.isnan(a) | np.isnan(x))
    out[ok & (x <= 0)] = 1.0
    low = ok & (x > 0) & (x < a + 1)
    if low.any():
        s, z = a[low], x[low]
        term = 1.0 / s
        total = term.copy()
        for k in range(1, 5000):
            term = term * z / (s + k)
            total = total + term
            if np.all(term <= total * 1e-17):
                break
        out[low] = 1.0 - total * np.exp(-z + s * np.log(z) - _log_gamma(s))
    high = ok & (x >= a + 1) & (x > 0)
    if high.any():
        s, z = a[high], x[high]
        b = z + 1.0 - s
        c = np.full_like(z, 1e300)
        d = 1.0 / b
        h = d.copy()
        for k in range(1, 5000):
            an = -k * (k - s)
            b = b + 2.0
            d = 1.0 / (an * d + b)
            c = b + an / c
            h = h * d * c
            if np.all(np.abs(d * c - 1.0) < 1e-15):
                break
        out[high] = np.exp(-z + s * np.log(z) - _log_gamma(s)) * h
    return out


def t_two_sided(t, df):
    """P(|T| >= |t|) for Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(invalid="ignore", over="ignore"):
        return beta_inc(df / 2.0, 0.5, np.where(np.isinf(t), 0.0, df / (df + t * t)))


def chi2_tail(x, df):
    return gamma_upper(np.asarray(df, float) / 2.0, np.asarray(x, float) / 2.0)


def f_cdf(x: float, d1: float, d2: float) -> float:
    return float(beta_inc(d1 / 2.0, d2 / 2.0, d1 * x / (d1 * x + d2)))


def f_quantile(p: float, d1: float, d2: float) -> float:
    """F quantile by bisection on the beta scale."""
    if not (0.0 < p < 1.0) or d1 <= 0 or d2 <= 0:
        return float("nan")
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if float(beta_inc(d1 / 2.0, d2 / 2.0, mid)) < p:
            lo = mid
        else:
            hi = mid
    z = (lo + hi) / 2.0
    return d2 * z / (d1 * (1.0 - z)) if z < 1.0 else float("inf")


def normal_quantile(p: float) -> float:
    """Standard normal quantile by bisection on erfc."""
    if not 0.0 < p < 1.0:
        return float("nan")
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if 0.5 * math.erfc(-mid / math.sqrt(2.0)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_tail(x.to_numpy(float), df.to_numpy(float)))
