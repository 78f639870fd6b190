"""Series models: likelihood against the dense covariance, fits against simulations, forecasts against plain recursions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from plantlens.operators import arma, forecast
from plantlens.operators.identity import DataError

MODELS = [(arma.Terms(1, 1), [0.6, 0.3]), (arma.Terms(2, 1), [0.5, -0.3, 0.4]), (arma.Terms(1, 1, 1, 1, 12), [0.5, 0.4, 0.3, -0.6]),
          (arma.Terms(0, 1, 0, 1, 4), [0.9, -0.6]), (arma.Terms(3, 0), [0.5, 0.2, -0.1]), (arma.Terms(0, 2), [-0.4, 0.2])]


def dense(model, w):
    """Squares, log determinant and innovations from the whole covariance matrix."""
    m = 4000
    psi = arma.inverse_filter(model.ar, np.pad(model.ma, (0, m)))[:m]
    auto = np.array([psi[:m - k] @ psi[k:] for k in range(len(w))])
    cov = auto[np.abs(np.subtract.outer(np.arange(len(w)), np.arange(len(w))))]
    root = np.linalg.cholesky(cov)
    return w @ np.linalg.solve(cov, w), 2 * np.log(np.diag(root)).sum(), np.linalg.solve(root, w) * np.diag(root)


@pytest.mark.parametrize(("terms", "beta"), MODELS)
def test_likelihood_is_exact(terms, beta):
    model, w, time = terms.model(beta), np.random.default_rng(5).normal(size=300), np.arange(1.0, 301)
    squares, log, innovations = dense(model, w)
    e = arma.residuals(model, w, time)
    more, own_log = arma.correction(model, w, time)
    assert np.isclose(e @ e + more, squares) and np.isclose(own_log, log)
    assert np.allclose(arma.one_step_errors(model, w, time, True)[:250], innovations[:250], atol=1e-9)


@pytest.mark.parametrize(("terms", "beta"), [*MODELS, (arma.Terms(1, 1, 0, 0, 0, (0, 1)), [0.5, -0.4, 0.2, 0.01])])
def test_gradients(terms, beta):
    w, time = np.random.default_rng(6).normal(size=400), np.arange(1.0, 401)
    beta = np.asarray(beta, float)
    model, found = terms.model(beta), []
    for i in range(terms.size):
        up, down = beta.copy(), beta.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        found.append((arma.residuals(terms.model(up), w, time) - arma.residuals(terms.model(down), w, time)) / 2e-5)
    assert np.allclose(arma.gradients(model, w, time, arma.residuals(model, w, time)), found, rtol=1e-5, atol=1e-5)


def test_inverse_filter_over_blocks():
    rng = np.random.default_rng(7)
    u, poly = rng.normal(size=1000), np.array([1, -0.7, 0.2, *[0.0] * 300, 0.1])
    e = np.zeros(1000)
    for t in range(1000):
        e[t] = u[t] - sum(poly[k] * e[t - k] for k in range(1, min(t, 303) + 1))
    assert np.allclose(arma.inverse_filter(poly, u), e)


def simulate(n, ar, ma, seed, const=0.0, drift=0.0):
    e = np.random.default_rng(seed).normal(size=n + 200)
    x = np.zeros(n + 200)
    for t in range(30, n + 200):
        x[t] = const + drift * max(t - 199, 0) - sum(c * x[t - k] for k, c in enumerate(ar) if k) + sum(c * e[t - k] for k, c in enumerate(ma))
    return x[200:]


def exact_loglik(model, w):
    squares, log, _ = dense(model, w)
    n = len(w)
    return -0.5 * (n * np.log(squares / n) + log + n * (1 + np.log(2 * np.pi)))


@pytest.fixture(scope="module")
def series(spark):
    ar = np.convolve([1, -0.6], [1, *[0.0] * 3, -0.4])
    frames = [pd.DataFrame({"k": k, "t": np.arange(len(x)), "x": x}) for k, x in
              (("arma", simulate(800, [1, -0.6], [1, 0.3], 1)), ("season", simulate(1500, ar, [1, 0.5], 2)), (None, simulate(60, [1, -0.2], [1, 0.4], 3)))]
    return pd.concat(frames), spark.createDataFrame(pd.concat(frames), "k string, t long, x double").repartition(5)


@pytest.mark.parametrize(("order", "season"), [([1, 0, 1], None), ([1, 0, 1], [1, 0, 0, 4]), ([0, 1, 1], [0, 0, 1, 4])])
def test_fit_is_the_most_likely(series, order, season):
    """The likelihood is that of the dense covariance, and no nearby parameters do better."""
    frame, df = series
    plan = forecast.Plan.of(order, season)
    for r in forecast.fit_ar(df, "x", order, season, order_cols=["t"], series_cols=["k"], block_rows=400).collect():
        x = frame[frame.k.isna() if r.k is None else frame.k == r.k].x.to_numpy()[:r["size"]]
        w = np.convolve(x, plan.difference, "valid")
        best = exact_loglik(plan.terms.model(np.array(r.coef)), w)
        assert r.n == len(w) and np.isclose(r.loglik, best, atol=1e-5)
        for i in range(len(r.coef)):
            for step in (1e-2, -1e-2):
                beta = np.array(r.coef)
                beta[i] += step
                model = plan.terms.model(beta)
                assert not model.allowed() or exact_loglik(model, w) < best + 1e-5


def test_pieces_do_not_matter(series, monkeypatch):
    _, df = series
    where = {"order_cols": ["t"], "series_cols": ["k"]}
    whole = {r.k: r for r in forecast.fit_ar(df, "x", [1, 0, 1], trend="ct", **where).collect()}
    guess = {(r.k, r.t): r.predicted for r in forecast.forecast_ar(df, "x", [1, 0, 1], trend="ct", **where).collect()}
    for kernel_size in (("PIECE", 300), ("WARM_UP", 200)):
        monkeypatch.setattr(forecast, *kernel_size)
    for r in forecast.fit_ar(df, "x", [1, 0, 1], trend="ct", **where).collect():
        assert np.isclose(r.loglik, whole[r.k].loglik, atol=1e-5)
    for r in forecast.forecast_ar(df, "x", [1, 0, 1], trend="ct", **where).collect():
        assert (r.predicted is None) == (guess[r.k, r.t] is None) and (r.predicted is None or np.isclose(r.predicted, guess[r.k, r.t], atol=0.01))


def test_forecast_is_the_recursion():
    model, difference = arma.Terms(1, 1, 1, 0, 4, (0, 1)).model([0.5, 0.3, 0.2, 0.4, 0.05]), np.array([1.0, -1.0])
    x = np.cumsum(np.random.default_rng(9).normal(size=100))
    w, time = np.diff(x), np.arange(2.0, 101)
    e = arma.residuals(model, w, time)
    state = arma.start_state(model, difference, x, e, 100.0)
    values, errors, level, want = list(w), list(e), x[-1], []
    for h in range(40):
        values.append(0.4 + 0.05 * (101 + h) - sum(model.ar[k] * values[-k] for k in range(1, len(model.ar))) + model.ma[1] * errors[-1])
        errors.append(0.0)
        level += values[-1]
        want.append(level)
    step = arma.step_matrix(model, difference)
    assert np.allclose(arma.ahead(step, state, 0, 40), want) and np.allclose(arma.ahead(step, state, 7, 5), want[7:12])


def test_candidates_share_rows_and_passes(series):
    _, df = series
    grid = {"order": [[1, 0, 0], [1, 0, 1], [0, 0, 1]], "trend": ["n", "c"]}
    found = forecast.suggest_ar_order(df, "x", grid, order_cols=["t"], series_cols=["k"], best_only=False).collect()
    assert len(found) == 18
    best = {r.k: r for r in forecast.suggest_ar_order(df, "x", grid, order_cols=["t"], series_cols=["k"]).collect()}
    assert best["arma"].order == "[1, 0, 1]"
    one = {r.k: r.aic for r in forecast.fit_ar(df, "x", [1, 0, 1], trend="c", order_cols=["t"], series_cols=["k"]).collect()}
    assert all(np.isclose(r.aic, one[r.k], atol=1e-5) for r in found if (r.order, r.trend) == ("[1, 0, 1]", "c"))


def test_odd_series(spark):
    flat = spark.createDataFrame([(t, 5.0) for t in range(40)] + [(40, None)], "t int, x double")
    r = forecast.forecast_ar(flat, "x", [1, 1, 1], order_cols=["t"]).collect()
    assert len(r) == 40 and all(v.predicted is None or abs(v.predicted - 5) < 1e-9 for v in r)
    with pytest.raises(DataError):
        forecast.fit_ar(flat.limit(3), "x", [1, 0, 1], order_cols=["t"])
    with pytest.raises(DataError):
        forecast.fit_ar(flat, "x", [1, 0, 0], trend="q", order_cols=["t"])
