"""One entry for every model: rows, split, fit, scores, tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.columns import col
from plantlens.functions.lineage import scratch_path
from plantlens.operators import charts, forecast, importance, latent
from plantlens.operators.encode import fit_encoder
from plantlens.operators.evaluate import confusion_matrix, prediction_table, roc_one_vs_rest
from plantlens.operators.filters import require_any_feature, require_rows, require_target
from plantlens.operators.identity import DataError
from plantlens.operators.selection import Selection, flag_selected
from plantlens.operators.splits import split
from plantlens.operators.supervised import CLASSIFIERS, DEFAULTS, REGRESSIONS, fit_supervised
from plantlens.plans.prepare import PrepareConfig, prepare

# Default parameters of the models without a target, and of the series models.
OTHER_DEFAULTS: dict[str, dict] = {
    "pca": {"n_components": 2},
    "pca_t2q": {"n_components": 2, "t2_limits": (95.0, 99.0), "q_limits": (95.0, 99.0)},
    "ica": {"n_components": 2, "max_iter": 500, "tol": 1e-4},
    "arima": {"order": [1, 1, 1], "trend": "n"},
    "sarima": {"order": [1, 1, 1], "seasonal_order": [1, 0, 1, 12], "trend": "n"},
    "ewma": {"alpha": 0.2, "limit_sigma": 3.0},
    "cusum": {"k": 0.5, "h": 5.0},
}
UNSUPERVISED = ("pca", "pca_t2q", "ica")
SERIES = ("arima", "sarima", "ewma", "cusum")
TREES = ("gbt_regression", "forest_regression", "gbt_classifier", "tree_classifier", "forest_classifier")
MODEL_KEYS = (*UNSUPERVISED, *SERIES, *REGRESSIONS, *CLASSIFIERS)


def model_task(key: str) -> str:
    for task, keys in (("unsupervised", UNSUPERVISED), ("timeseries", SERIES), ("regression", REGRESSIONS),
                       ("classification", CLASSIFIERS)):
        if key in keys:
            return task
    raise DataError(f"unknown model {key!r}; known: {', '.join(MODEL_KEYS)}")


def default_params(key: str) -> dict:
    model_task(key)
    return dict(DEFAULTS.get(key) or OTHER_DEFAULTS[key])


@dataclass
class ModelResult:
    key: str
    task: str
    params: dict
    metrics: DataFrame
    predictions: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    model: object = None
    notes: list[str] = field(default_factory=list)


@dataclass
class RunConfig:
    features: Sequence[str] = ()
    target: str | None = None
    params: Mapping = field(default_factory=dict)
    split_method: str = "random"
    train_ratio: float = 0.8
    seed: int = 42
    stratify_col: str | None = None
    order_cols: Sequence[str] = ()
    series_cols: Sequence[str] = ()
    scale: bool = True
    id_col: str = "id"
    selected: Selection | None = None
    importances: bool = True
    prepare: PrepareConfig | None = None


def _prepared(df: DataFrame, c: RunConfig) -> tuple[DataFrame, RunConfig, list[str]]:
    """Rows with the prepared columns, and the configuration to go on with: columns that look back in time force the sequential
    split, and added columns join the chosen features."""
    plan = replace(c.prepare, id_col=c.id_col, order_cols=c.prepare.order_cols or c.order_cols, series_cols=c.prepare.series_cols or c.series_cols,
                   split_method=c.split_method, train_ratio=c.train_ratio, seed=c.seed, stratify_col=c.stratify_col)
    done = prepare(df, plan, for_model=True)
    added = [x for kind in ("lags", "features", "sma", "ema") for x in done.added.get(kind, [])]
    features = list(dict.fromkeys([*c.features, *added])) if c.features else ()
    notes = [] if plan.model_split == c.split_method else [f"columns that look back in time: {plan.model_split} split"]
    return done.data.drop(done.flag), replace(c, prepare=None, features=features, split_method=plan.model_split, order_cols=plan.order_cols,
                                              series_cols=plan.series_cols), notes + done.warnings


def run_model(df: DataFrame, key: str, config: RunConfig) -> ModelResult:
    """Prepare the rows if asked, merge default parameters, dispatch by task."""
    task = model_task(key)
    if config.prepare is not None:
        rows, plain, notes = _prepared(df, config)
        out = run_model(rows, key, plain)
        return replace(out, notes=notes + list(out.notes))
    params = {**default_params(key), **{k: v for k, v in config.params.items() if v is not None}}
    run: dict[str, Callable] = {"unsupervised": _run_unsupervised, "timeseries": _run_series}
    return run.get(task, _run_supervised)(df, key, task, params, config)


def _flagged(df: DataFrame, c: RunConfig, warnings: list[str], stratify: str | None) -> DataFrame:
    return split(df, c.split_method, c.train_ratio, c.seed, stratify, c.order_cols, c.series_cols, c.id_col,
                 "is_train", warnings)


def _run_supervised(df, key, task, params, c: RunConfig) -> ModelResult:
    if not c.target or c.target not in df.columns:
        raise DataError("choose a target column")
    features = [f for f in c.features if f in df.columns and f not in (c.id_col, c.target)]
    features = features or [x for x in df.columns if x not in (c.id_col, c.target)]
    rows = require_rows(require_target(df, c.target, task), task)
    notes: list[str] = []
    stratify = c.stratify_col or (c.target if task == "classification" else None)
    fitted = fit_supervised(_flagged(rows, c, notes, stratify), key, features, c.target, params, "is_train", c.seed, c.scale)
    p = fitted.predictions
    spark = df.sparkSession
    tables: dict[str, DataFrame] = {}
    if task == "classification":
        y = p.withColumn("_y", col(c.target).cast("string"))
        tables["confusion"] = confusion_matrix(y, "_y", "predicted", fitted.classes, ["dataset"])
        tables["roc"] = roc_one_vs_rest(y.select("dataset", "_y", "scores"), "scores", "_y", fitted.classes, ["dataset"])
    if key in TREES:
        tables["nodes"] = importance.tree_nodes(spark, fitted, scratch_path(spark, "tree"))
    if c.importances:
        if key in ("linear", "pls", "logistic"):
            tables["coefficients"] = importance.coefficient_importance(spark, fitted)
        if key == "pls":
            tables["vip"] = latent.vip_scores(spark, fitted.stage)
        if key not in ("linear", "pls", "logistic"):
            tables["gain"] = importance.tree_importance(spark, fitted)
        test = p.filter("dataset = 'test'").drop("predicted", "scores", "dataset")
        tables["permutation"] = importance.permutation_importance(fitted, test, c.id_col, seed=c.seed)
    predictions = prediction_table(p, c.id_col, c.target, "predicted", "is_train", c.order_cols)
    return ModelResult(key, task, params, fitted.metrics, predictions, tables, fitted, notes + fitted.notes)


def _run_unsupervised(df, key, task, params, c: RunConfig) -> ModelResult:
    features = [f for f in c.features if f in df.columns and f != c.id_col]
    features = features or [x for x in df.columns if x != c.id_col]
    notes: list[str] = []
    rows = require_rows(require_any_feature(df, features), task)
    flagged = _flagged(rows, c, notes, c.stratify_col)
    kept = flagged.filter("is_train").select(*[col(f) for f in features]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _unsupervised(df, flagged, kept, features, key, task, params, c, notes)
    finally:
        kept.unpersist()


def _unsupervised(df, flagged, kept, features, key, task, params, c: RunConfig, notes: list[str]) -> ModelResult:
    encoder = fit_encoder(kept, features, c.scale)
    if encoder.width < 2:
        raise DataError("models without a target need two feature slots")
    data = encoder.transform(flagged).withColumn("dataset", F.when(F.col("is_train"), F.lit("train")).otherwise(F.lit("test")))
    train, spark = encoder.transform(kept), df.sparkSession
    k = min(max(2, int(params["n_components"])), encoder.width)
    params = {**params, "n_components": k}
    if key == "ica":
        model = latent.fit_ica(train, "features", k, int(params["max_iter"]), float(params["tol"]), c.seed, encoder.slots)
        scored = latent.ica_scores(data, model)
        metrics = latent.reconstruction(scored, encoder.width)
        return ModelResult(key, task, params, metrics, scored.drop("features"),
                           {"mixing": latent.mixing_table(spark, model)}, (encoder, model), notes)
    model = latent.fit_pca(train, "features", k, encoder.slots, encoder.source_ranges())
    scored = latent.t2_q_statistics(data, model)
    tables = {"variance": latent.pca_table(spark, model), "loadings": latent.loadings_squared(spark, model)}
    metrics = latent.reconstruction(scored, encoder.width)
    if key == "pca_t2q":
        limits = latent.monitoring_limits(model, params["t2_limits"], params["q_limits"])
        metrics = latent.t2_q_report(scored, model, limits)
        tables["over_limit"] = latent.over_limit(scored, limits).drop("features")
        if c.selected is not None:
            focus = flag_selected(scored, c.selected, c.id_col, "_focus").filter("_focus").drop("_focus")
            tables["contributions"] = latent.t2_q_contributions(focus, model, limits, c.id_col)
        else:
            notes.append("no rows selected: contributions left out")
    return ModelResult(key, task, params, metrics, scored.drop("features"), tables, (encoder, model), notes)


def _run_series(df, key, task, params, c: RunConfig) -> ModelResult:
    if not c.target or c.target not in df.columns:
        raise DataError("choose a target column")
    notes = [] if c.split_method == "sequential" else ["series models always use the sequential split"]
    rows = require_rows(require_target(df, c.target), task)
    order = [o for o in c.order_cols if o in df.columns]
    placed = {"order_cols": list(dict.fromkeys([*order, c.id_col])), "series_cols": list(c.series_cols)}
    if key == "ewma":
        chart = charts.ewma_chart(rows, c.target, params["alpha"], params["limit_sigma"], c.train_ratio, **placed)
        return ModelResult(key, task, params, charts.ewma_report(chart, c.series_cols), chart, notes=notes)
    if key == "cusum":
        chart = charts.cusum_chart(rows, c.target, params["k"], params["h"], c.train_ratio, **placed)
        return ModelResult(key, task, params, charts.cusum_report(chart, c.series_cols), chart, notes=notes)
    args = (rows, c.target, params["order"], params.get("seasonal_order"), params["trend"], c.train_ratio)
    predicted, fit = forecast.fit_and_forecast(*args, **placed)
    return ModelResult(key, task, params, forecast.forecast_metrics(predicted, fit, c.series_cols), predicted,
                       {"parameters": fit}, notes=notes)
