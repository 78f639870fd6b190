"""Models and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.functions.lineage import cut, scratch_path
from plantlens.operators import encode, evaluate, forecast, importance, latent, search, splits, supervised
from plantlens.plans.prepare import PrepareConfig
from plantlens.plans.run import RunConfig, run_model
from plantlens.queries.base import Query, rounded, table
from plantlens.sources.model_store import load_model, save_model


def _lines(spark, d):
    """Order lines with a target that depends on the features, and a clear early/late split."""
    t = table(spark, d, "lineitem")
    return t.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), "l_quantity", "l_discount", "l_tax",
        "l_extendedprice", "l_returnflag", "l_linestatus", (F.col("l_extendedprice") + 500 * F.col("l_quantity")).alias("cost"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000 + 8 * F.col("l_tax")).alias("net"),
        (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")).alias("is_train"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _encoded(spark, d, features):
    t = _lines(spark, d).drop("net")
    enc = encode.fit_encoder(t.filter("is_train"), features)
    data = enc.transform(t).withColumn("dataset", F.when(F.col("is_train"), F.lit("train")).otherwise(F.lit("test")))
    return data, enc


# Slots of an embedding.
SLOTS = 64


def _vectors(spark, d):
    """Embeddings as rows of numbers."""
    t = table(spark, d, "embeddings")
    return t.select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("label"),
                    *[F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in range(SLOTS)])


# ---- encoding and scores -------------------------------------------------------------------

def q_encode(spark, d):
    """Share of set slots and mean of the scaled numbers, per slot."""
    data, enc = _encoded(spark, d, ["l_quantity", "l_discount", "l_returnflag"])
    slots = latent.slots_of(data, "features")
    names = F.array(*[F.lit(s) for s in enc.slots])
    long = data.select(F.posexplode(slots).alias("i", "v"))
    return rounded(long.groupBy(F.get(names, F.col("i")).alias("slot")).agg(F.avg("v").alias("mean"),
                                                                          F.count(F.lit(1)).alias("n")))


def q_linear_one(spark, d):
    """One feature: predictions are the least-squares line."""
    fitted = supervised.fit_supervised(_lines(spark, d), "linear", ["l_quantity"], "net", flag="is_train")
    m = fitted.predictions.groupBy("dataset").agg(F.avg("predicted").alias("mean_predicted"),
                                                  F.max("predicted").alias("max_predicted"))
    return rounded(fitted.metrics.join(m, "dataset"), 5)


def q_linear(spark, d):
    return rounded(supervised.fit_supervised(_lines(spark, d), "linear", [*NUMBERS, "l_returnflag"], "net").metrics)


def q_regression_metrics(spark, d):
    t = _lines(spark, d).withColumns({"guess": F.col("l_extendedprice") / 1050, "dataset": F.when(
        F.col("is_train"), F.lit("train")).otherwise(F.lit("test"))})
    return rounded(evaluate.regression_metrics(t, "net", "guess"))


def q_prediction_table(spark, d):
    t = _lines(spark, d).withColumn("guess", F.col("l_extendedprice") / 1050)
    return rounded(evaluate.prediction_table(t, "id", "net", "guess", "is_train"), 9)


def _guesses(spark, d):
    """A fixed guess of the return flag from the price, to be scored as a classifier would be."""
    t = _lines(spark, d)
    guess = F.when(F.col("l_extendedprice") > 60000, "A").when(F.col("l_quantity") > 25, "N").otherwise("R")
    return t.withColumns({"guess": guess, "dataset": F.when(F.col("is_train"), F.lit("train")).otherwise(F.lit("test"))})


def q_confusion(spark, d):
    return evaluate.confusion_matrix(_guesses(spark, d), "l_returnflag", "guess", ["A", "N", "R", "never"], ["dataset"])


def q_accuracy(spark, d):
    return rounded(evaluate.accuracy(_guesses(spark, d), "l_returnflag", "guess"))


def q_roc(spark, d):
    t = table(spark, d, "orders").withColumn("score", F.floor(F.col("o_totalprice") / 5000).cast("double"))
    return rounded(evaluate.roc_curve(t, "score", F.col("o_orderstatus") == "F"))


def q_roc_blocks(spark, d):
    t = table(spark, d, "orders")
    return rounded(evaluate.roc_curve(t, "o_totalprice", F.col("o_orderstatus") == "F", block_rows=2_000))


def q_roc_classes(spark, d):
    """Curves of three classes against the rest, per priority."""
    t = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.array(
        F.floor(F.col("o_totalprice") / 20000).cast("double"), F.pmod("o_custkey", F.lit(7)).cast("double"),
        -F.floor(F.col("o_totalprice") / 20000).cast("double")).alias("scores"))
    return rounded(evaluate.roc_one_vs_rest(t, "scores", "o_orderstatus", ["F", "O", "P"], ["o_orderpriority"]))


def q_auc(spark, d):
    t = table(spark, d, "orders").withColumn("score", F.floor(F.col("o_totalprice") / 5000).cast("double"))
    return rounded(evaluate.auc(t, "score", F.col("o_orderstatus") == "F", ["o_orderpriority"]))


def q_macro_auc(spark, d):
    t = table(spark, d, "orders").select("o_orderstatus", F.array(
        F.col("o_totalprice"), F.pmod("o_custkey", F.lit(97)).cast("double"), -F.col("o_totalprice")).alias("scores"))
    return rounded(evaluate.macro_auc(t, "scores", "o_orderstatus", ["F", "O", "P"]))


# ---- models without a target ---------------------------------------------------------------

def q_pca(spark, d):
    data, enc = _encoded(spark, d, NUMBERS)
    model = latent.fit_pca(data.filter("is_train"), "features", 2, enc.slots, enc.source_ranges())
    return rounded(latent.reconstruction(latent.t2_q_statistics(data, model), enc.width), 5)


def q_pca_variance(spark, d):
    """Total variance, and the trace of the covariance it must equal, on the embeddings."""
    v = _vectors(spark, d)
    enc = encode.fit_encoder(v, [f"v{i}" for i in range(SLOTS)], scale=False)
    model = latent.fit_pca(enc.transform(v), "features", SLOTS, enc.slots)
    return rounded(latent.pca_table(spark, model).agg(F.sum("variance").alias("total_variance"),
                                                      F.max("cumulative").alias("cumulative")))


def q_loadings(spark, d):
    v = _vectors(spark, d)
    enc = encode.fit_encoder(v, [f"v{i}" for i in range(SLOTS)])
    return rounded(latent.loadings_squared(spark, latent.fit_pca(enc.transform(v), "features", 3, enc.slots)))


def _pair(spark, d):
    """Two correlated columns with early rows as training data: the components are known in closed form."""
    data, enc = _encoded(spark, d, ["l_extendedprice", "cost"])
    return data, latent.fit_pca(data.filter("is_train"), "features", 2, enc.slots, enc.source_ranges())


def q_pca_pair(spark, d):
    return rounded(latent.pca_table(spark, _pair(spark, d)[1]))


def q_loadings_pair(spark, d):
    return rounded(latent.loadings_squared(spark, _pair(spark, d)[1]))


def q_t2_means(spark, d):
    """Mean T2 per data set; for the training rows it is k (n - 1) / n."""
    data, model = _pair(spark, d)
    return rounded(latent.t2_q_statistics(data, model).groupBy("dataset").agg(F.avg("t2").alias("t2_mean")))


def q_t2_q(spark, d):
    """T2 and Q of a full-rank model: T2 is the Mahalanobis distance and Q is 0."""
    v = _vectors(spark, d)
    enc = encode.fit_encoder(v, ["v0", "v1"], scale=False)
    data = enc.transform(v)
    model = latent.fit_pca(data, "features", 2, enc.slots)
    return rounded(latent.t2_q_statistics(data, model).select("id", "t2", "q"), 5)


def _t2q(spark, d):
    selected = F.col("l_extendedprice") > 90_000
    return run_model(_lines(spark, d).drop("net", "cost", "is_train"), "pca_t2q", RunConfig(
        features=[*NUMBERS, "l_returnflag"], params={"n_components": 3, "t2_limits": (95, 120)},
        split_method="stratified_random", stratify_col="l_returnflag", selected=selected))


def q_t2_q_report(spark, d):
    return rounded(_t2q(spark, d).metrics)


def q_contributions(spark, d):
    return rounded(_t2q(spark, d).tables["contributions"])


def q_suggest_components(spark, d):
    data, _ = _encoded(spark, d, NUMBERS)
    k = latent.suggest_components(data.filter("is_train"), threshold=0.9)
    return data.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).withColumn("n_components", F.lit(k))


def q_ica(spark, d):
    data, enc = _encoded(spark, d, ["l_quantity", "l_extendedprice", "l_discount"])
    model = latent.fit_ica(data.filter("is_train"), "features", 3, 200, slots=enc.slots)
    return rounded(latent.reconstruction(latent.ica_scores(data, model), enc.width), 5)


def q_suggest_ica(spark, d):
    data, _ = _encoded(spark, d, ["l_quantity", "l_extendedprice", "l_discount"])
    k = latent.suggest_ica_components(data.filter("is_train"), most=3, max_iter=50)
    return data.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).withColumn("n_components", F.lit(k))


# ---- models with a target ------------------------------------------------------------------

def q_pls(spark, d):
    """With one component per feature PLS is least squares."""
    fitted = supervised.fit_supervised(_lines(spark, d), "pls", ["l_quantity"], "net", {"n_components": 1})
    return rounded(fitted.metrics, 5)


def q_pls_two(spark, d):
    """Two components of four numbers."""
    return rounded(supervised.fit_supervised(_lines(spark, d), "pls", NUMBERS, "net", {"n_components": 2}).metrics)


def q_linear_numbers(spark, d):
    return rounded(supervised.fit_supervised(_lines(spark, d), "linear", NUMBERS, "net").metrics)


def q_vip(spark, d):
    fitted = supervised.fit_supervised(_lines(spark, d), "pls", NUMBERS, "net", evaluate=False)
    return rounded(latent.vip_scores(spark, fitted.stage))


def q_gbt_regression(spark, d):
    """All 300 trees of the default."""
    return rounded(supervised.fit_supervised(_lines(spark, d), "gbt_regression", NUMBERS, "net").metrics)


def _one_tree(spark, d):
    return supervised.fit_supervised(_lines(spark, d), "gbt_regression", ["l_quantity", "l_discount", "l_tax"], "net",
                                     {"n_estimators": 1, "learning_rate": 1.0, "num_leaves": 4})


def q_boosted_tree(spark, d):
    """One tree of four leaves at full rate: rows and means of its leaves."""
    p = _one_tree(spark, d).predictions
    return p.groupBy(F.round("predicted", 6).alias("predicted"), "dataset").agg(F.count(F.lit(1)).alias("n"))


def q_boosted_nodes(spark, d):
    """Where the tree's splits are and how many rows they part."""
    t = importance.tree_nodes(spark, _one_tree(spark, d), "")
    return t.filter("feature is not null").select("feature", F.col("rows").cast("bigint").alias("n"))


def q_forest_regression(spark, d):
    return rounded(supervised.fit_supervised(_lines(spark, d), "forest_regression", NUMBERS, "net",
                                             {"n_estimators": 10, "max_depth": 6}).metrics)


def _documents(spark, d):
    """Quality labels with simple measures of the whole texts, measured once and stored."""
    docs = table(spark, d, "documents").select(
        "doc_id", "lang", "source", "n_chars", F.size(F.split("text", r"\s+")).alias("words"),
        F.length(F.regexp_replace("text", r"[^0-9]", "")).alias("digits"),
        F.length(F.regexp_replace("text", r"[^\n]", "")).alias("lines"))
    rows = docs.join(table(spark, d, "labels"), "doc_id").withColumn("id", F.col("doc_id").cast("string"))
    return splits.split_stratified(cut(rows), "quality", 0.7)


DOC_FEATURES = ["n_chars", "words", "digits", "lines", "lang", "source"]


def _classifier(key, **params):
    def run(spark, d):
        return rounded(supervised.fit_supervised(_documents(spark, d), key, DOC_FEATURES, "quality", params).metrics)
    return run


def q_multi_class(spark, d):
    v = splits.split_stratified(_vectors(spark, d), "label", 0.7)
    return rounded(supervised.fit_supervised(v, "logistic", [f"v{i}" for i in range(SLOTS)], "label").metrics)


def q_run_model(spark, d):
    """The common entry: split, fit, scores, confusion and importances."""
    rows = _documents(spark, d).select("id", "quality", *DOC_FEATURES)
    r = run_model(rows, "tree_classifier", RunConfig(DOC_FEATURES, "quality", {"max_depth": 4},
                                                     split_method="stratified_random"))
    return r.tables["confusion"]


def q_run_model_lags(spark, d):
    """Lags are prepared before the split, which is then sequential although a random one is asked for."""
    t = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), "event_id", "ts", "event_type", "value")
    r = run_model(t, "linear", RunConfig(["value_lag1"], "value", split_method="random", importances=False, series_cols=["event_type"],
                                         prepare=PrepareConfig(lags={"value": [1]}, order_cols=["ts", "event_id"])))
    return rounded(r.predictions.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg("actual").alias("mean_actual"),
                                                        F.min("event_id").alias("least"), F.max("event_id").alias("most")))


def q_coefficients(spark, d):
    fitted = supervised.fit_supervised(_lines(spark, d), "linear", NUMBERS, "net", evaluate=False)
    return rounded(importance.coefficient_importance(spark, fitted), 5)


def q_permutation(spark, d):
    t = _lines(spark, d)
    fitted = supervised.fit_supervised(t, "linear", NUMBERS, "net", evaluate=False)
    return rounded(importance.permutation_importance(fitted, t.filter("not is_train")))


def q_tree_importance(spark, d):
    fitted = supervised.fit_supervised(_documents(spark, d), "tree_classifier", DOC_FEATURES, "quality",
                                       {"max_depth": 5}, evaluate=False)
    return rounded(importance.tree_importance(spark, fitted))


def q_tree_nodes(spark, d):
    fitted = supervised.fit_supervised(_documents(spark, d), "tree_classifier", DOC_FEATURES, "quality",
                                       {"max_depth": 5}, evaluate=False)
    return rounded(importance.tree_nodes(spark, fitted, scratch_path(spark, "tree")))


def q_model_round_trip(spark, d):
    """A stored and reloaded model scores as the line it was fitted to."""
    t = _lines(spark, d)
    path = scratch_path(spark, "model")
    save_model(supervised.fit_supervised(t, "linear", ["l_quantity"], "net"), path)
    scored = load_model(spark, path).score(t)
    scored = scored.withColumn("dataset", F.when(F.col("is_train"), F.lit("train")).otherwise(F.lit("test")))
    return rounded(evaluate.regression_metrics(scored, "net", "predicted"), 5)


def q_grid_search(spark, d):
    """The whole PLS grid over five given folds."""
    t = _lines(spark, d).withColumn("part", F.pmod(F.split("id", "-")[0].cast("bigint"), F.lit(5)))
    _, scores = search.grid_search(t, "pls", NUMBERS, "net", fold_col="part")
    return rounded(scores)


def q_grid_search_linear(spark, d):
    """Both linear candidates over five given folds, numbers only: without an intercept the target is taken from its mean."""
    t = _lines(spark, d).withColumn("part", F.pmod(F.split("id", "-")[0].cast("bigint"), F.lit(5)))
    _, scores = search.grid_search(t, "linear", ["l_quantity"], "net", fold_col="part")
    return rounded(scores)


def q_random_search(spark, d):
    t = _documents(spark, d).filter("is_train").select("id", "quality", *DOC_FEATURES)
    _, scores = search.random_search(t, "logistic", DOC_FEATURES, "quality", {"C": [0.1, 1.0]}, folds=2)
    return rounded(scores)


def q_workload(spark, d):
    """Rows a search would fit: fits times the rows of a fold's training part."""
    load = search.search_workload(search.GRIDS["forest_regression"], 5)
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(load["candidates"]).alias("candidates"), F.lit(load["fits"]).alias("fits"), F.lit(load["note"]).alias("note"),
        (F.col("rows") * load["fits"] * 4 / 5).cast("bigint").alias("rows_fitted"))


# ---- forecasts -----------------------------------------------------------------------------

BY = {"order_cols": ["ts", "event_id"], "series_cols": ["event_type"]}


def q_forecast(spark, d):
    t = forecast.forecast_ar(table(spark, d, "events"), "value", [1, 0, 0], trend="c", **BY)
    return rounded(t.select("event_type", "event_id", "dataset", "actual", "predicted"), 5)


def q_fit_ar(spark, d):
    t = forecast.fit_ar(table(spark, d, "events"), "value", [2, 1, 0], **BY)
    return rounded(t.select("event_type", "n", F.get("coef", F.lit(0)).alias("ar1"), F.get("coef", F.lit(1)).alias("ar2"),
                            "s2", "aic"), 5)


def _trend(trend):
    def run(spark, d):
        t = forecast.fit_ar(table(spark, d, "events"), "value", [1, 0, 0], trend=trend, **BY)
        names = ["ar1", "const", "drift"] if trend == "ct" else ["ar1", "drift"]
        return rounded(t.select("event_type", "n", *[F.get("coef", F.lit(i)).alias(x) for i, x in enumerate(names)], "s2", "loglik"), 7)
    return run


def q_forecast_trend(spark, d):
    """Forecasts with a line in time, up to a fixed horizon in SQL."""
    t = forecast.forecast_ar(table(spark, d, "events"), "value", [0, 0, 0], trend="ct", **BY)
    return rounded(t.select("event_type", "event_id", "dataset", "actual", "predicted"), 5)


def q_forecast_arma(spark, d):
    predicted, fit = forecast.fit_and_forecast(table(spark, d, "events"), "value", [1, 1, 1], **BY)
    return rounded(forecast.forecast_metrics(predicted, fit, ["event_type"]), 5)


def q_sarima(spark, d):
    t = forecast.fit_ar(table(spark, d, "events"), "value", [1, 1, 0], [1, 0, 1, 12], **BY)
    return rounded(t.select("event_type", "n", "s2", "aic", "bic"), 5)


def q_suggest_order(spark, d):
    """The whole default grid."""
    return rounded(forecast.suggest_ar_order(table(spark, d, "events"), "value", **BY), 5)


_L = ("l AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_quantity, l_discount, l_tax, "
      "l_extendedprice, l_returnflag, l_extendedprice + 500 * l_quantity AS cost, l_extendedprice * (1 - l_discount) / 1000 + 8 * l_tax AS net, "
      "l_shipdate < TIMESTAMP '1999-01-01' AS is_train, CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END "
      "AS dataset FROM lineitem)")


def _metrics_sql(source, y, p, digits=6):
    return (f"SELECT dataset, count(*) AS n, round(1 - avg(pow({y} - {p}, 2)) / var_pop({y}), {digits}) AS R2, "
            f"round(sqrt(avg(pow({y} - {p}, 2))), {digits}) AS RMSE, round(avg(abs({y} - {p})), {digits}) AS MAE FROM {source} "
            "GROUP BY dataset")


_LINE = (f"{_L}, c AS (SELECT regr_slope(net, l_quantity) AS b, regr_intercept(net, l_quantity) AS a FROM l WHERE is_train), "
         "p AS (SELECT l.*, a + b * l_quantity AS predicted FROM l, c)")
_GUESS = (f"{_L}, g AS (SELECT *, CASE WHEN l_extendedprice > 60000 THEN 'A' WHEN l_quantity > 25 THEN 'N' ELSE 'R' END AS guess FROM l)")


def _auc_parts(name: str, score: str, positive: str, by: str = "'x'") -> str:
    """Rank-sum AUC per key as a chain of CTEs ending in `name`."""
    return f"""{name}_r AS (SELECT {by} AS k, {positive} AS pos, rank() OVER (PARTITION BY {by} ORDER BY {score}) +
  (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS rk FROM orders),
{name} AS (SELECT k, (sum(rk) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0)
  / (count(*) FILTER (WHERE pos) * CAST(count(*) FILTER (WHERE NOT pos) AS DOUBLE)) AS auc FROM {name}_r GROUP BY k)"""


def _roc_sql(score: str) -> str:
    return f"""WITH s AS (SELECT CAST({score} AS DOUBLE) AS threshold, count(*) FILTER (WHERE o_orderstatus = 'F') AS p,
  count(*) FILTER (WHERE o_orderstatus <> 'F') AS n FROM orders GROUP BY 1)
SELECT round(threshold, 6) AS threshold, round(sum(n) OVER w / CAST(sum(n) OVER () AS DOUBLE), 6) AS fpr,
  round(sum(p) OVER w / CAST(sum(p) OVER () AS DOUBLE), 6) AS tpr FROM s WINDOW w AS (ORDER BY threshold DESC)
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0"""


def _roc_classes_sql() -> str:
    scores = {"F": "floor(o_totalprice / 20000)", "O": "o_custkey % 7", "P": "-floor(o_totalprice / 20000)"}
    rows = " UNION ALL ".join(f"SELECT o_orderpriority AS k, '{c}' AS class, CAST({s} AS DOUBLE) AS threshold, o_orderstatus = '{c}' AS pos FROM orders"
                              for c, s in scores.items())
    return f"""WITH s AS (SELECT k, class, threshold, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM ({rows}) GROUP BY ALL)
SELECT k AS o_orderpriority, class, round(threshold, 6) + 0.0 AS threshold, round(sum(n) OVER w / CAST(sum(n) OVER a AS DOUBLE), 6) AS fpr,
  round(CASE WHEN sum(p) OVER a > 0 THEN sum(p) OVER w / CAST(sum(p) OVER a AS DOUBLE) END, 6) AS tpr
FROM s WINDOW w AS (PARTITION BY k, class ORDER BY threshold DESC), a AS (PARTITION BY k, class)
UNION ALL SELECT k, class, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM s GROUP BY k, class"""


_LAG_SPLIT = """WITH e AS (SELECT event_id, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY event_type) AS n
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT CASE WHEN rn <= round_even(n * 0.8, 0) THEN 'train' ELSE 'test' END AS dataset, count(*) AS n, round(avg(value), 6) AS mean_actual,
  min(event_id) AS least, max(event_id) AS most FROM e GROUP BY 1"""

_DIFF = """e AS (SELECT event_type, event_id, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY event_type) AS n,
  value - lag(value) OVER w AS w0 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
t AS (SELECT *, lag(w0, 1) OVER w AS w1, lag(w0, 2) OVER w AS w2 FROM e
  WHERE rn <= round_even(n * 0.8, 0) WINDOW w AS (PARTITION BY event_type ORDER BY rn)),
g AS (SELECT event_type, count(*) AS n, sum(w1 * w1) AS a, sum(w1 * w2) AS b, sum(w2 * w2) AS c, sum(w1 * w0) AS u, sum(w2 * w0) AS v,
  sum(w0 * w0) AS y FROM t WHERE w2 IS NOT NULL GROUP BY event_type),
h AS (SELECT *, (u * c - v * b) / (a * c - b * b) AS ar1, (v * a - u * b) / (a * c - b * b) AS ar2 FROM g),
f AS (SELECT *, (y - ar1 * u - ar2 * v) / n AS s2 FROM h)"""

def _split_sql(step: int) -> str:
    """The best split of all leaves over all features and values, and the rows behind it."""
    before = f"s{step - 1}"
    return f"""
u{step} AS (SELECT leaf, f, x, count(*) AS n, sum(net) AS y FROM (SELECT leaf, net, unnest(['l_quantity', 'l_discount', 'l_tax']) AS f,
    unnest([l_quantity, l_discount, l_tax]) AS x FROM {before} WHERE is_train) GROUP BY ALL),
c{step} AS (SELECT leaf, f, x, sum(n) OVER w AS nl, sum(y) OVER w AS yl, sum(n) OVER a AS n, sum(y) OVER a AS y FROM u{step}
    WINDOW w AS (PARTITION BY leaf, f ORDER BY x), a AS (PARTITION BY leaf, f)),
b{step} AS (SELECT leaf AS split_leaf, f, x, n FROM c{step} WHERE nl >= 20 AND n - nl >= 20
    ORDER BY yl * yl / nl + (y - yl) * (y - yl) / (n - nl) - y * y / n DESC LIMIT 1),
s{step} AS (SELECT s.* REPLACE (CASE WHEN leaf = split_leaf THEN leaf || CASE WHEN CASE f WHEN 'l_quantity' THEN l_quantity
    WHEN 'l_discount' THEN l_discount ELSE l_tax END <= x THEN 'L' ELSE 'R' END ELSE leaf END AS leaf) FROM {before} s, b{step})"""


_GROWN = (f"WITH {_L}, s0 AS (SELECT l_quantity, l_discount, l_tax, net, is_train, dataset, '' AS leaf FROM l),"
          + ",".join(_split_sql(i) for i in (1, 2, 3)))
_LEAVES = (f"{_GROWN}, m AS (SELECT leaf, avg(net) AS predicted FROM s3 WHERE is_train GROUP BY leaf) "
           "SELECT round(predicted, 6) AS predicted, dataset, count(*) AS n FROM s3 JOIN m USING (leaf) GROUP BY 1, 2")
_SPLITS = f"{_GROWN} " + " UNION ALL ".join(f"SELECT f AS feature, CAST(n AS BIGINT) AS n FROM b{i}" for i in (1, 2, 3))

def _pls_ctes(x: list[str], y: str, part: str, held_out: str, most: int) -> list[str]:
    """CTEs s1, s2, ...: PLS fits on the rows of `r` outside part f, by deflation of their correlations. Row f has means m, deviations d,
    coefficients c on the scaled columns, and the weights w and explained sums ss of each component."""
    n, pairs = range(len(x)), [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    a = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    dot = lambda u, v: " + ".join(f"{u}{i} * {v}{i}" for i in n)
    ctes = [f"{_L}, r AS (SELECT *, {part} AS part FROM l), k AS (SELECT unnest({held_out}) AS f)",
            "s0 AS (SELECT f, count(*) AS n, " + ", ".join(
                [f"corr({x[i]}, {x[j]}) * (count(*) - 1) AS {a(i, j)}" for i, j in pairs] + [f"corr({x[i]}, {y}) * (count(*) - 1) AS b{i}" for i in n]
                + [f"avg({x[i]}) AS m{i}, stddev_samp({x[i]}) AS d{i}, 0.0 AS c{i}" for i in n] + [f"avg({y}) AS my, stddev_samp({y}) AS dy"])
            + " FROM k JOIN r ON part <> f GROUP BY f)"]
    for s in range(1, most + 1):
        ctes += [f"w{s} AS (SELECT *, " + ", ".join(f"b{i} / sqrt({dot('b', 'b')}) AS w{s}_{i}" for i in n) + f" FROM s{s - 1})",
                 f"v{s} AS (SELECT *, " + ", ".join("(" + " + ".join(f"{a(i, j)} * w{s}_{j}" for j in n) + f") AS v{i}" for i in n) + f" FROM w{s})",
                 f"t{s} AS (SELECT *, {dot(f'w{s}_', 'v')} AS tt, {dot(f'w{s}_', 'b')} AS wb FROM v{s})",
                 f"p{s} AS (SELECT *, wb * wb / tt AS ss{s}, " + ", ".join(f"v{i} / tt AS p{s}_{i}" for i in n) + f" FROM t{s})",
                 f"r{s} AS (SELECT *, " + ", ".join(f"w{s}_{i}" + "".join(f" - ({dot(f'p{c}_', f'w{s}_')}) * r{c}_{i}" for c in range(1, s)) + f" AS r{s}_{i}"
                                                    for i in n) + f" FROM p{s})",
                 f"s{s} AS (SELECT * EXCLUDE (tt, wb, {', '.join(f'v{i}' for i in n)}) REPLACE (" + ", ".join(
                     [f"{a(i, j)} - tt * p{s}_{i} * p{s}_{j} AS {a(i, j)}" for i, j in pairs] + [f"b{i} - wb * p{s}_{i} AS b{i}" for i in n]
                     + [f"c{i} + wb / tt * r{s}_{i} AS c{i}" for i in n]) + f") FROM r{s})"]
    return ctes


def _pls_guess(x: list[str]) -> str:
    return "(my + dy * (" + " + ".join(f"c{i} * ({v} - m{i}) / d{i}" for i, v in enumerate(x)) + "))"


def _pls_grid_sql(x: list[str], y: str, folds: int, most: int) -> str:
    """Mean error of 1, 2, ... components over the folds left out."""
    ctes = _pls_ctes(x, y, f"CAST(split_part(id, '-', 1) AS BIGINT) % {folds}", f"range({folds})", most)
    ctes += [f"e{s} AS (SELECT f, sqrt(avg(pow({y} - {_pls_guess(x)}, 2))) AS e FROM s{s} JOIN r ON part = f GROUP BY f)" for s in range(1, most + 1)]
    return "WITH " + ",\n".join(ctes) + " " + " UNION ALL ".join(
        f"SELECT CAST({s - 1} AS INTEGER) AS candidate, '{{''n_components'': {s}}}' AS params, round(avg(e), 6) AS rmse, CAST({folds} AS INTEGER) AS folds "
        f"FROM e{s}" for s in range(1, most + 1))


def _pls_fit_sql(x: list[str], y: str, k: int, then: str) -> str:
    """A query on s, the fit with k components on the training rows, and p, all rows with their prediction."""
    ctes = _pls_ctes(x, y, "CASE WHEN is_train THEN 0 ELSE 1 END", "[1]", k)
    return "WITH " + ",\n".join([*ctes, f"s AS (SELECT * FROM s{k})", f"p AS (SELECT r.*, {_pls_guess(x)} AS predicted FROM r, s)"]) + " " + then


_PLS_TWO = _pls_fit_sql(NUMBERS, "net", 2, _metrics_sql("p", "net", "predicted"))
# as many components as numbers are least squares
_LEAST_SQUARES = _pls_fit_sql(NUMBERS, "net", len(NUMBERS), _metrics_sql("p", "net", "predicted"))
_COEFFICIENTS = _pls_fit_sql(NUMBERS, "net", len(NUMBERS), " UNION ALL ".join(
    f"SELECT '{v}' AS feature, round(c{i}, 5) + 0.0 AS beta, round(abs(c{i}), 5) AS abs_beta FROM s" for i, v in enumerate(NUMBERS)))
_VIP = _pls_fit_sql(NUMBERS, "net", 2, " UNION ALL ".join(
    f"SELECT '{v}' AS feature, round(sqrt({len(NUMBERS)} * (w1_{i} * w1_{i} * ss1 + w2_{i} * w2_{i} * ss2) / (ss1 + ss2)), 6) AS vip FROM s"
    for i, v in enumerate(NUMBERS)))


# a number that is scaled to mean 0 leaves the intercept to the mean of the target
_LINEAR_GRID = f"""WITH {_L}, r AS (SELECT *, CAST(split_part(id, '-', 1) AS BIGINT) % 5 AS part FROM l),
c AS (SELECT f, regr_slope(net, l_quantity) AS b, regr_intercept(net, l_quantity) AS a FROM (SELECT unnest(range(5)) AS f) JOIN r ON part <> f GROUP BY f),
e AS (SELECT f, sqrt(avg(pow(net - a - b * l_quantity, 2))) AS e FROM c JOIN r ON part = f GROUP BY f)
SELECT CAST(0 AS INTEGER) AS candidate, '{{''fit_intercept'': True}}' AS params, round(avg(e), 6) AS rmse, CAST(5 AS INTEGER) AS folds FROM e
UNION ALL SELECT CAST(1 AS INTEGER), '{{''fit_intercept'': False}}', round(avg(e), 6), CAST(5 AS INTEGER) FROM e"""

_TRAINED = """e AS (SELECT event_type, event_id, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY event_type) AS m, lag(value) OVER w AS prev
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
t AS (SELECT *, CAST(rn AS DOUBLE) / round_even(m * 0.8, 0) AS u FROM e WHERE rn <= round_even(m * 0.8, 0) AND prev IS NOT NULL)"""

# the lagged value and time, without a constant and with one (both measured from their means)
_TREND = f"""WITH {_TRAINED},
g AS (SELECT event_type, count(*) AS n, max(round_even(m * 0.8, 0)) AS size, sum(prev * prev) AS a, sum(prev * u) AS b, sum(u * u) AS c,
  sum(prev * value) AS p, sum(u * value) AS q, sum(value * value) AS y FROM t GROUP BY event_type),
f AS (SELECT *, (p * c - q * b) / (a * c - b * b) AS ar1, (q * a - p * b) / (a * c - b * b) AS slope FROM g),
s AS (SELECT *, (y - ar1 * p - slope * q) / n AS s2 FROM f)
SELECT event_type, n, round(ar1, 7) AS ar1, round(slope / size, 7) AS drift, round(s2, 7) AS s2, round(-0.5 * n * (ln(s2) + 1 + ln(2 * pi())), 7) AS loglik FROM s"""
_CONST_TREND = f"""WITH {_TRAINED},
d AS (SELECT *, prev - avg(prev) OVER k AS x, u - avg(u) OVER k AS z, value - avg(value) OVER k AS v FROM t WINDOW k AS (PARTITION BY event_type)),
g AS (SELECT event_type, count(*) AS n, max(round_even(m * 0.8, 0)) AS size, sum(x * x) AS a, sum(x * z) AS b, sum(z * z) AS c, sum(x * v) AS p, sum(z * v) AS q,
  sum(v * v) AS y, avg(prev) AS mx, avg(u) AS mz, avg(value) AS mv FROM d GROUP BY event_type),
f AS (SELECT *, (p * c - q * b) / (a * c - b * b) AS ar1, (q * a - p * b) / (a * c - b * b) AS slope FROM g),
s AS (SELECT *, (y - ar1 * p - slope * q) / n AS s2 FROM f)
SELECT event_type, n, round(ar1, 7) AS ar1, round(mv - ar1 * mx - slope * mz, 7) AS const, round(slope / size, 7) AS drift, round(s2, 7) AS s2,
  round(-0.5 * n * (ln(s2) + 1 + ln(2 * pi())), 7) AS loglik FROM s"""
_LINE_IN_TIME = """WITH e AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn,
  count(*) OVER (PARTITION BY event_type) AS m FROM events),
x AS (SELECT *, rn <= round_even(m * 0.8, 0) AS train FROM e),
c AS (SELECT event_type, regr_slope(value, rn) AS b, regr_intercept(value, rn) AS a FROM x WHERE train GROUP BY 1)
SELECT x.event_type, event_id, CASE WHEN train THEN 'train' ELSE 'test' END AS dataset, round(value, 5) AS actual, round(a + b * rn, 5) AS predicted
FROM x JOIN c ON c.event_type = x.event_type"""

_FORECAST = """WITH RECURSIVE e AS (SELECT event_type, event_id, value, row_number() OVER w AS rn, lag(value) OVER w AS prev,
  count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
x AS (SELECT *, rn <= round_even(n * 0.8, 0) AS train FROM e),
c AS (SELECT event_type, regr_slope(value, prev) AS b, regr_intercept(value, prev) AS a FROM x WHERE train AND prev IS NOT NULL GROUP BY 1),
r AS (SELECT x.event_type, rn, value AS f FROM x WHERE rn = round_even(n * 0.8, 0)
  UNION ALL SELECT r.event_type, r.rn + 1, a + b * r.f FROM r JOIN c ON c.event_type = r.event_type
  JOIN x ON x.event_type = r.event_type AND x.rn = r.rn + 1)
SELECT x.event_type, event_id, CASE WHEN train THEN 'train' ELSE 'test' END AS dataset, round(value, 5) AS actual,
  round(CASE WHEN train THEN a + b * prev ELSE r.f END, 5) AS predicted
FROM x JOIN c ON c.event_type = x.event_type LEFT JOIN r ON r.event_type = x.event_type AND r.rn = x.rn"""

_V = "v AS (SELECT CAST(vec_id AS VARCHAR) AS id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS v{i}" for i in range(SLOTS)) + " FROM embeddings)"

QUERIES = [
    Query("feature_encoding", q_encode, f"""WITH {_L}, m AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md,
  stddev_pop(l_discount) AS sd FROM l WHERE is_train)
SELECT 'l_quantity' AS slot, round(avg((l_quantity - mq) / sq), 6) + 0.0 AS mean, count(*) AS n FROM l, m
UNION ALL SELECT 'l_discount', round(avg((l_discount - md) / sd), 6) + 0.0, count(*) FROM l, m
UNION ALL SELECT 'l_returnflag_' || f, round(avg(CASE WHEN l_returnflag = f THEN 1.0 ELSE 0.0 END), 6), count(*) FROM l,
  (VALUES ('A'), ('N'), ('R')) q(f) GROUP BY f"""),
    Query("linear_regression_line", q_linear_one, f"WITH {_LINE}, m AS ({_metrics_sql('p', 'net', 'predicted', 5)}), "
          "q AS (SELECT dataset, round(avg(predicted), 5) AS mean_predicted, round(max(predicted), 5) AS max_predicted FROM p GROUP BY 1) "
          "SELECT m.*, mean_predicted, max_predicted FROM m JOIN q ON m.dataset = q.dataset"),
    Query("linear_regression", q_linear),
    Query("regression_metrics", q_regression_metrics, f"WITH {_L}, g AS (SELECT *, l_extendedprice / 1050 AS guess FROM l) "
          + _metrics_sql("g", "net", "guess")),
    Query("prediction_table", q_prediction_table,
          f"WITH {_L} SELECT id, round(net, 9) AS actual, round(l_extendedprice / 1050, 9) AS predicted, dataset FROM l"),
    Query("confusion_matrix", q_confusion, f"""WITH {_GUESS}, k AS (SELECT unnest(['A', 'N', 'R', 'never']) AS c),
d AS (SELECT DISTINCT dataset FROM g)
SELECT d.dataset, a.c AS actual, b.c AS predicted, count(g.id) AS n FROM d CROSS JOIN k a CROSS JOIN k b
LEFT JOIN g ON g.dataset = d.dataset AND g.l_returnflag = a.c AND g.guess = b.c GROUP BY ALL"""),
    Query("accuracy", q_accuracy, f"WITH {_GUESS} SELECT dataset, count(*) AS n, "
          "round(avg(CASE WHEN guess = l_returnflag THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM g GROUP BY 1"),
    Query("roc_curve", q_roc, _roc_sql("floor(o_totalprice / 5000)")),
    Query("roc_one_vs_rest", q_roc_classes, _roc_classes_sql()),
    Query("roc_curve_blocks", q_roc_blocks, _roc_sql("o_totalprice")),
    Query("auc", q_auc, f"WITH {_auc_parts('u', 'floor(o_totalprice / 5000)', chr(39).join(['o_orderstatus = ', 'F', '']), 'o_orderpriority')} "
          "SELECT k AS o_orderpriority, round(auc, 6) AS auc FROM u"),
    Query("auc_one_vs_rest", q_macro_auc, "WITH " + ", ".join(
        _auc_parts(f"u{i}", s, f"o_orderstatus = '{c}'") for i, (s, c) in enumerate(
            (("o_totalprice", "F"), ("o_custkey % 97", "O"), ("-o_totalprice", "P"))))
          + " SELECT round((u0.auc + u1.auc + u2.auc) / 3, 6) AS auc FROM u0, u1, u2"),
    Query("pca", q_pca),
    Query("pca_variance", q_pca_variance, f"WITH {_V} SELECT round({' + '.join(f'var_samp(v{i})' for i in range(SLOTS))}, 6) AS total_variance, "
          "CAST(1.0 AS DOUBLE) AS cumulative FROM v"),
    Query("loadings_squared", q_loadings),
    Query("pca_pair", q_pca_pair, f"WITH {_L}, c AS (SELECT abs(corr(l_extendedprice, cost)) AS r, CAST(count(*) AS DOUBLE) AS n FROM l WHERE is_train) "
          "SELECT 'PC1' AS component, round((1 + r) * n / (n - 1), 6) AS variance, round((1 + r) / 2, 6) AS ratio, round((1 + r) / 2, 6) "
          "AS cumulative FROM c UNION ALL SELECT 'PC2', round((1 - r) * n / (n - 1), 6), round((1 - r) / 2, 6), CAST(1.0 AS DOUBLE) FROM c"),
    Query("loadings_pair", q_loadings_pair, f"WITH {_L}, c AS (SELECT abs(corr(l_extendedprice, cost)) AS r, CAST(count(*) AS DOUBLE) AS n FROM l "
          "WHERE is_train) SELECT f AS feature, round((1 + r) / 2 * n / (n - 1), 6) AS PC1, round((1 - r) / 2 * n / (n - 1), 6) AS PC2, "
          "round(n / (n - 1), 6) AS loading_sq_sum FROM c, (VALUES ('l_extendedprice'), ('cost')) v(f)"),
    Query("t2_means", q_t2_means, f"""WITH {_L}, m AS (SELECT avg(l_extendedprice) AS ma, avg(cost) AS mb, var_samp(l_extendedprice) AS a,
  covar_samp(l_extendedprice, cost) AS b, var_samp(cost) AS c FROM l WHERE is_train)
SELECT dataset, round(avg((c * pow(l_extendedprice - ma, 2) - 2 * b * (l_extendedprice - ma) * (cost - mb) + a * pow(cost - mb, 2))
  / (a * c - b * b)), 6) AS t2_mean FROM l, m GROUP BY dataset"""),
    Query("t2_q_statistics", q_t2_q, f"""WITH {_V}, m AS (SELECT avg(v0) AS m0, avg(v1) AS m1, var_samp(v0) AS a, covar_samp(v0, v1) AS b,
  var_samp(v1) AS c FROM v)
SELECT id, round((c * pow(v0 - m0, 2) - 2 * b * (v0 - m0) * (v1 - m1) + a * pow(v1 - m1, 2)) / (a * c - b * b), 5) + 0.0 AS t2,
  CAST(0.0 AS DOUBLE) AS q FROM v, m"""),
    Query("t2_q_report", q_t2_q_report),
    Query("t2_q_contributions", q_contributions),
    Query("suggest_components", q_suggest_components),
    Query("ica", q_ica, f"WITH {_L} SELECT DISTINCT dataset, CAST(0.0 AS DOUBLE) AS reconstruction_rmse FROM l"),
    Query("suggest_ica_components", q_suggest_ica),
    Query("pls_regression", q_pls, f"WITH {_LINE} " + _metrics_sql("p", "net", "predicted", 5)),
    Query("pls_two_components", q_pls_two, _PLS_TWO),
    Query("linear_regression_numbers", q_linear_numbers, _LEAST_SQUARES),
    Query("vip_scores", q_vip, _VIP),
    Query("gbt_regression", q_gbt_regression),
    Query("boosted_tree", q_boosted_tree, _LEAVES),
    Query("boosted_nodes", q_boosted_nodes, _SPLITS),
    Query("forest_regression", q_forest_regression),
    Query("logistic_regression", _classifier("logistic")),
    Query("gbt_classifier", _classifier("gbt_classifier", n_estimators=50)),
    Query("tree_classifier", _classifier("tree_classifier", max_depth=5)),
    Query("forest_classifier", _classifier("forest_classifier", n_estimators=10, max_depth=5)),
    Query("multi_class", q_multi_class),
    Query("run_model", q_run_model),
    Query("run_model_lags", q_run_model_lags, _LAG_SPLIT),
    Query("coefficient_importance", q_coefficients, _COEFFICIENTS),
    Query("permutation_importance", q_permutation),
    Query("tree_importance", q_tree_importance),
    Query("tree_nodes", q_tree_nodes),
    Query("model_round_trip", q_model_round_trip, f"WITH {_LINE} " + _metrics_sql("p", "net", "predicted", 5)),
    Query("grid_search", q_grid_search, _pls_grid_sql(NUMBERS, "net", 5, 4)),
    Query("grid_search_linear", q_grid_search_linear, _LINEAR_GRID),
    Query("random_search", q_random_search),
    Query("search_workload", q_workload,
          "SELECT count(*) AS rows, CAST(18 AS INTEGER) AS candidates, CAST(90 AS INTEGER) AS fits, '' AS note, "
          "CAST(count(*) * 90 * 4 / 5 AS BIGINT) AS rows_fitted FROM lineitem"),
    Query("forecast_ar", q_forecast, _FORECAST),
    Query("fit_ar", q_fit_ar, f"WITH {_DIFF} SELECT event_type, n, round(ar1, 5) AS ar1, round(ar2, 5) AS ar2, round(s2, 5) AS s2, "
          "round(n * ln(s2) + 6, 5) AS aic FROM f"),
    Query("fit_ar_trend", _trend("t"), _TREND),
    Query("fit_ar_const_trend", _trend("ct"), _CONST_TREND),
    Query("forecast_trend", q_forecast_trend, _LINE_IN_TIME),
    Query("forecast_arma", q_forecast_arma),
    Query("fit_sarima", q_sarima),
    Query("suggest_ar_order", q_suggest_order),
]

