"""Models: known values, identities and small fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from plantlens.functions import distributions as dist
from plantlens.operators import encode, evaluate, forecast, importance, latent, search, supervised
from plantlens.operators.identity import DataError
from plantlens.plans.run import MODEL_KEYS, RunConfig, default_params, model_task, run_model


def test_distributions(spark):
    """Against the library on Spark's own class path."""
    d = spark._jvm.org.apache.commons.math3.distribution
    assert dist.f_quantile(0.99, 2, 26) == pytest.approx(5.5263347, rel=1e-7)
    assert dist.normal_quantile(0.99) == pytest.approx(2.326347874, rel=1e-9)
    for t, nu in ((0.0, 3.0), (0.5, 1.5), (2.1, 12.7), (-7.0, 900.0), (40.0, 5.0)):
        want = 2 * d.TDistribution(nu).cumulativeProbability(-abs(t))
        assert float(dist.t_two_sided(t, nu)) == pytest.approx(want, rel=1e-8, abs=1e-14)
    for x, k in ((0.1, 1.0), (3.0, 2.0), (30.0, 11.0), (500.0, 450.0)):
        want = 1 - d.ChiSquaredDistribution(k).cumulativeProbability(x)
        assert float(dist.chi2_tail(x, k)) == pytest.approx(want, rel=1e-7, abs=1e-13)
    for p, a, b in ((0.9, 1, 5), (0.95, 3, 40), (0.999, 10, 10_000)):
        assert dist.f_quantile(p, a, b) == pytest.approx(d.FDistribution(float(a), float(b)).inverseCumulativeProbability(p), rel=1e-6)


@pytest.fixture(scope="module")
def forty(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"id": [str(i) for i in range(40)], "x1": rng.normal(0, 1, 40), "x2": rng.normal(1, 0.5, 40),
                      "x3": rng.normal(-1, 0.8, 40)})
    return p, spark.createDataFrame(p)


def test_pca_against_numpy(spark, forty):
    p, t = forty
    enc = encode.fit_encoder(t, ["x1", "x2", "x3"])
    data = enc.transform(t)
    model = latent.fit_pca(data, "features", 2, enc.slots)
    z = p[["x1", "x2", "x3"]].to_numpy()
    z = (z - z.mean(0)) / z.std(0)
    _, s, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    assert np.allclose(model.variance, s[:2] ** 2 / 39) and np.allclose(np.abs(model.components), np.abs(vt[:2]))
    out = latent.t2_q_statistics(data, model).toPandas().set_index("id").loc[p.id]
    scores = z @ model.components.T
    assert np.allclose(out.t2, (scores ** 2 / model.variance).sum(1))
    assert np.allclose(out.q, ((z - scores @ model.components) ** 2).sum(1))
    assert out.t2.mean() == pytest.approx(2 * 39 / 40)


def test_limits_over_hundred(forty):
    _, t = forty
    enc = encode.fit_encoder(t, ["x1", "x2", "x3"])
    model = latent.fit_pca(enc.transform(t), "features", 2, enc.slots)
    limits = latent.monitoring_limits(model, (120, 180), (130, 190))
    t2, q = latent.t2_limit(40, 2, 0.9), latent.q_limit(model.eigenvalues, 2, 0.9)
    assert limits["t2_warning_limit"] == pytest.approx(t2 * 120 / 90)
    assert limits["t2_alarm_limit"] == pytest.approx(t2 * 180 / 90)
    assert limits["q_alarm_limit"] == pytest.approx(q * 190 / 90)
    assert latent.percent_pair(99, 95) == (94.0, 95.0) and math.isnan(latent.t2_limit(2, 2, 0.9))


def test_contributions(spark, forty):
    p, t = forty
    cfg = RunConfig(["x1", "x2", "x3"], params={"n_components": 2}, selected=F.col("id").cast("int") <= 5)
    out = run_model(t, "pca_t2q", cfg)
    c = out.tables["contributions"].toPandas()
    assert set(c.statistic) == {"t2", "q"} and set(c.feature) == {"x1", "x2", "x3"}
    scored = out.predictions.filter("cast(id as int) <= 5").toPandas()
    largest = scored.loc[scored.q.idxmax()]
    if "largest" in c[c.statistic == "q"].basis.iloc[0]:
        assert c[c.statistic == "q"].contribution.sum() == pytest.approx(largest.q)


def test_ica_finds_sources(spark):
    rng = np.random.default_rng(3)
    s = np.column_stack([rng.uniform(-1, 1, 3000), rng.laplace(size=3000)])
    x = s @ np.array([[1.0, 0.6], [0.4, 1.0]]).T
    t = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "n": np.arange(3000)}))
    data = encode.fit_encoder(t, ["a", "b"]).transform(t)
    model = latent.fit_ica(data, k=2)
    got = np.vstack(latent.ica_scores(data, model).orderBy("n").toPandas().scores)
    r = np.abs(np.corrcoef(got.T, s.T)[:2, 2:])
    assert (r.max(axis=1) > 0.98).all() and np.allclose(got.std(0), 1, atol=1e-6)


def nipals(x, y, k):
    x, y = (x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean()) / y.std(ddof=1)
    w_all, p_all, q_all, t_all = [], [], [], []
    for _ in range(k):
        w = x.T @ y
        w /= np.linalg.norm(w)
        t = x @ w
        load, q = x.T @ t / (t @ t), y @ t / (t @ t)
        x, y = x - np.outer(t, load), y - q * t
        w_all.append(w), p_all.append(load), q_all.append(q), t_all.append(t @ t)
    w, p, q = np.array(w_all).T, np.array(p_all).T, np.array(q_all)
    ss = np.array(t_all) * q ** 2
    return w @ np.linalg.solve(p.T @ w, q), np.sqrt(len(w) * (w ** 2 @ ss) / ss.sum())


def test_pls_against_rowwise(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=200)
    t = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=list("abcd") + ["y"]).assign(is_train=True))
    fitted = supervised.fit_supervised(t, "pls", list("abcd"), "y", {"n_components": 2})
    coef, vip = nipals(x, y, 2)
    assert np.allclose(fitted.stage.coefficients, coef)
    table = latent.vip_scores(spark, fitted.stage).toPandas().set_index("feature").loc[list("abcd")]
    assert np.allclose(table.vip, vip)


def test_encoder_fills_and_ignores_unseen(spark):
    train = spark.createDataFrame([("1", 1.0, "b", True), ("2", None, "a", False), ("3", 3.0, None, True), ("4", 8.0, "b", None)],
                                  "id string, x double, c string, f boolean")
    enc = encode.fit_encoder(train, ["x", "c", "f"], scale=False)
    assert enc.slots == ("x", "f", "c_a", "c_b") and enc.source_ranges() == [("x", 0, 1), ("f", 1, 1), ("c", 2, 2)]
    new = spark.createDataFrame([("5", None, "new", None)], "id string, x double, c string, f boolean")
    assert list(enc.transform(new).first()["features"]) == [3.0, 1.0, 0.0, 0.0]
    assert list(enc.transform(train).orderBy("id").collect()[2]["features"]) == [3.0, 1.0, 0.0, 1.0]


def test_unseen_label(spark):
    t = spark.createDataFrame([(str(i), i, float(i), c) for i, c in enumerate("ABABCC")], "id string, time bigint, x1 double, label string")
    with pytest.raises(DataError, match="C"):
        run_model(t, "tree_classifier", RunConfig(["x1"], "label", split_method="sequential", train_ratio=0.67, order_cols=["time"]))
    with pytest.raises(DataError):
        supervised.fit_supervised(t.filter("label = 'A'").withColumn("is_train", F.lit(True)), "logistic", ["x1"], "label")


def test_auc_and_roc(spark):
    rng = np.random.default_rng(6)
    y, s = rng.integers(0, 2, 300), np.round(rng.normal(size=300), 1)
    t = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    pairs = s[y == 1][:, None] - s[y == 0][None, :]
    want = ((pairs > 0) + 0.5 * (pairs == 0)).mean()
    for blocks in (None, 10):
        assert evaluate.auc(t, "s", F.col("y") == 1, block_rows=blocks).first()["auc"] == pytest.approx(want)
        roc = evaluate.roc_curve(t, "s", F.col("y") == 1, block_rows=blocks).toPandas().sort_values("threshold", ascending=False)
        assert np.trapezoid(roc.tpr, roc.fpr) == pytest.approx(want)
    grown = t.withColumn("s", F.exp("s"))
    assert evaluate.auc(grown, "s", F.col("y") == 1).first()["auc"] == pytest.approx(want)


def test_r2_edges(spark):
    t = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 2.0, 2.0), ("c", 2.0, 3.0)],
                              "dataset string, y double, p double")
    r2 = {r["dataset"]: r["R2"] for r in evaluate.regression_metrics(t, "y", "p").collect()}
    assert r2 == {"a": 1.0, "b": None, "c": 0.0}


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(7)
    n = 300
    p = pd.DataFrame({"id": [str(i) for i in range(n)], "a": rng.normal(size=n), "b": rng.normal(size=n),
                      "c": rng.choice(["u", "v", "w"], n)})
    p["y"] = 3 * p.a + 0.2 * p.b + (p.c == "u") * 2 + rng.normal(0, 0.1, n)
    p["label"] = np.where(p.y > 2, "high", np.where(p.y < -2, "low", "mid"))
    return spark.createDataFrame(p)


@pytest.mark.parametrize("key,params", [("linear", {}), ("pls", {}), ("gbt_regression", {"n_estimators": 8, "learning_rate": 0.3}),
                                        ("forest_regression", {"n_estimators": 8, "max_depth": 6})])
def test_regressions(mixed, key, params):
    out = run_model(mixed, key, RunConfig(["a", "b", "c"], "y", params, importances=key == "linear"))
    m = {r["dataset"]: r for r in out.metrics.collect()}
    assert m["train"]["n"] == 240 and m["test"]["R2"] > (0.6 if key == "forest_regression" else 0.8)
    if key == "linear":
        top = out.tables["permutation"].toPandas()
        assert top.feature.iloc[0] == "a" and top.importance_mean.iloc[0] > top.importance_mean.iloc[-1] > -0.05
        assert out.tables["coefficients"].first()["feature"] == "a"


@pytest.mark.parametrize("key,params", [("logistic", {}), ("tree_classifier", {"max_depth": 5}),
                                        ("forest_classifier", {"n_estimators": 8, "max_depth": 5}),
                                        ("gbt_classifier", {"n_estimators": 3, "learning_rate": 0.5})])
def test_classifiers(mixed, key, params):
    out = run_model(mixed, key, RunConfig(["a", "b", "c"], "label", params, split_method="stratified_random", importances=False))
    m = {r["dataset"]: r for r in out.metrics.collect()}
    assert m["test"]["accuracy"] > 0.6 and m["test"]["auc"] > 0.75
    grid = out.tables["confusion"].toPandas()
    assert len(grid) == 18 and grid.n.sum() == 300


def test_tree_nodes(spark, mixed, tmp_path):
    t = mixed.withColumn("is_train", F.lit(True))
    fitted = supervised.fit_supervised(t, "tree_classifier", ["a", "b", "c"], "label", {"max_depth": 4}, evaluate=False)
    nodes = importance.tree_nodes(spark, fitted, str(tmp_path / "tree"), max_depth=2).toPandas()
    root = nodes[nodes.id == 0].iloc[0]
    assert root.feature == "a" and root.rows == 300 and nodes.depth.max() == 2


def test_search(mixed):
    best, scores = search.grid_search(mixed, "tree_classifier", ["a", "b"], "label", {"max_depth": [1, 4]}, folds=2)
    assert best == {"max_depth": 4} and scores.count() == 2
    folds = search.assign_folds(mixed, 4, label="label").groupBy("label").pivot("fold").count().toPandas().set_index("label")
    assert (folds.max(axis=1) - folds.min(axis=1)).max() <= 1
    assert search.search_sample(mixed, 0.5, 100, label="label").count() == 100
    assert search.sample_size(10, 0.01) == 2 and search.sample_size(100, 0.5) == 50


def test_workload():
    assert search.combinations(search.GRIDS["forest_regression"]) == 18
    assert search.random_draws(search.GRIDS["gbt_regression"]) == 20
    assert search.search_workload(search.GRIDS["gbt_regression"], 50)["note"] == ""
    assert search.search_workload({"a": list(range(40))}, 10)["note"] == "many fits"


@pytest.fixture(scope="module")
def simulated(spark):
    frames = []
    for name, seed, phi, theta in (("ar1", 1, [0.7], []), ("ar2", 2, [0.5, -0.3], []), ("arma", 3, [0.6], [0.3])):
        e = np.random.default_rng(seed).normal(size=6350)
        x = np.zeros(6350)
        for t in range(2, 6350):
            x[t] = sum(p * x[t - 1 - i] for i, p in enumerate(phi)) + e[t] + sum(q * e[t - 1 - i] for i, q in enumerate(theta))
        frames.append(pd.DataFrame({"k": name, "t": np.arange(6250), "x": x[100:]}))
    return spark.createDataFrame(pd.concat(frames))


@pytest.mark.parametrize("block_rows", [None, 2_000])
def test_arma_parameters(simulated, block_rows):
    where = {"order_cols": ["t"], "series_cols": ["k"], "block_rows": block_rows}
    coef = {r["k"]: r["coef"] for r in forecast.fit_ar(simulated, "x", [2, 0, 0], **where).collect()}
    assert np.allclose(coef["ar2"], [0.5, -0.3], atol=0.05) and np.allclose(coef["ar1"], [0.7, 0], atol=0.05)
    coef = {r["k"]: r["coef"] for r in forecast.fit_ar(simulated, "x", [1, 0, 1], **where).collect()}
    assert np.allclose(coef["arma"], [0.6, 0.3], atol=0.05)


def test_series_models(spark):
    t = np.arange(60)
    df = spark.createDataFrame(pd.DataFrame({"id": t.astype(str), "time": t, "value": 10 + 0.05 * t + np.sin(2 * np.pi * t / 12)}))
    for key in ("arima", "sarima", "ewma", "cusum"):
        out = run_model(df, key, RunConfig(target="value", order_cols=["time"], split_method="sequential"))
        assert {r["dataset"] for r in out.metrics.collect()} == {"train", "test"}
        assert out.predictions.count() == 60
    exact = forecast.forecast_ar(df, "value", [1, 1, 0], [1, 1, 0, 12], order_cols=["time"]).toPandas()
    assert (exact.actual - exact.predicted).abs().max() < 1e-6


def test_keys():
    assert len(MODEL_KEYS) == 15 and model_task("ewma") == "timeseries"
    assert default_params("logistic")["C"] == 1.0
    with pytest.raises(DataError):
        model_task("nothing")


@pytest.mark.parametrize(("p", "k"), [(40, 3), (2_100, 4)])
def test_wide_pca(spark, p, k):
    """Products with few vectors give the dense components; the sums left out are near the dense ones."""
    rng = np.random.default_rng(p)
    n = 250
    x = rng.normal(size=(n, 12)) @ (rng.normal(size=(12, p)) * np.linspace(6, 1, 12)[:, None]) + 5 + 0.3 * rng.normal(size=(n, p))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").select(array_to_vector("features").alias("features")).repartition(4)
    model = latent.wide_pca(df, k=k) if p < latent.WIDE_SLOTS else latent.fit_pca(df, k=k)
    assert model.rest is not None and model.components.shape == (k, p)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    values = s ** 2 / (n - 1)
    assert np.allclose(model.variance, values[:k], rtol=1e-8) and np.allclose(np.abs(model.components), np.abs(vt[:k]), atol=1e-6)
    assert np.allclose(model.ratio, values[:k] / values.sum(), rtol=1e-8) and np.isclose(model.rest[0], values[k:].sum())
    assert np.isclose(model.rest[1], (values[k:] ** 2).sum(), rtol=0.5) and np.isclose(model.rest[2], (values[k:] ** 3).sum(), rtol=0.8)
    dense = latent.q_limit(values, k, 0.95)
    assert np.isclose(latent.monitoring_limits(model)["q_warning_limit"], dense, rtol=0.1)


def test_permutation_in_parts(spark, monkeypatch):
    """Small parts give what one join gives; the copies carry no decimals through the shuffle and are not sorted."""
    rows = spark.range(600).select(F.col("id").cast("string").alias("id"), F.sin("id").alias("a"), F.when(F.col("id") % 7 > 0, F.cos("id")).alias("b"),
                                   (F.sin("id") * 3 + F.rand(1)).alias("y"), (F.col("id") % 5 > 0).alias("is_train"))
    fitted = supervised.fit_supervised(rows, "linear", ["a", "b"], "y", evaluate=False)
    whole = importance.permutation_importance(fitted, rows).collect()
    plans, score = [], type(fitted).score

    def scored(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return score(self, df)

    monkeypatch.setattr(type(fitted), "score", scored)
    monkeypatch.setattr(importance, "JOIN_ROWS", 50, raising=False)
    found = importance.permutation_importance(fitted, rows).collect()
    assert [r.feature for r in found] == [r.feature for r in whole] == ["a", "b"]
    for r, w in zip(found, whole):
        assert abs(r.importance_mean - w.importance_mean) < 1e-9 and abs(r.importance_sd - w.importance_sd) < 1e-9
    assert "ShuffledHashJoin" in plans[0] and "SortMergeJoin" not in plans[0] and ", 12), REPARTITION_BY_NUM" in plans[0]
