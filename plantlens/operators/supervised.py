"""Regression and classification on encoded features, fitted by Spark ML; boosting by `boosting`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.columns import as_number, col
from plantlens.functions.lineage import stored
from plantlens.operators import boosting
from plantlens.operators.boosting import Boosting
from plantlens.operators.encode import FEATURES, Encoder, fit_encoder
from plantlens.operators.evaluate import MAX_CLASSES, accuracy, macro_auc, regression_metrics
from plantlens.operators.identity import DataError
from plantlens.operators.latent import Pls, fit_pls, pls_predict

LABEL = "_label"
DEEPEST = 30
# Default parameters per model.
DEFAULTS: dict[str, dict] = {
    "linear": {"fit_intercept": True},
    "pls": {"n_components": 2},
    "gbt_regression": {"n_estimators": 300, "learning_rate": 0.05, "num_leaves": 31},
    "forest_regression": {"n_estimators": 400, "max_depth": None, "min_samples_leaf": 1},
    "logistic": {"C": 1.0, "max_iter": 1000},
    "gbt_classifier": {"n_estimators": 300, "learning_rate": 0.05, "num_leaves": 31},
    "tree_classifier": {"criterion": "entropy", "max_depth": None, "min_samples_leaf": 1},
    "forest_classifier": {"n_estimators": 400, "max_depth": None, "min_samples_leaf": 1},
}
REGRESSIONS = ("linear", "pls", "gbt_regression", "forest_regression")
CLASSIFIERS = ("logistic", "gbt_classifier", "tree_classifier", "forest_classifier")


def _depth(params: Mapping) -> int:
    depth = params.get("max_depth")
    return max(1, min(DEEPEST if depth is None else int(depth), DEEPEST))


def _tree(params: Mapping, seed: int) -> dict:
    return {"minInstancesPerNode": max(1, int(params.get("min_samples_leaf", 1))), "seed": seed}


def build_estimator(key: str, params: Mapping, seed: int, n_train: int):
    """The Spark ML estimator of a model key, reading FEATURES and LABEL."""
    cols = {"featuresCol": FEATURES, "labelCol": LABEL}
    if key == "linear":
        return LinearRegression(**cols, regParam=0.0, fitIntercept=bool(params.get("fit_intercept", True)),
                                standardization=False)
    if key == "forest_regression":
        return RandomForestRegressor(**cols, numTrees=int(params["n_estimators"]), maxDepth=_depth(params),
                                     featureSubsetStrategy="all", **_tree(params, seed))
    if key == "logistic":
        # C weighs the summed loss, Spark the mean loss
        return LogisticRegression(**cols, maxIter=int(params.get("max_iter", 1000)), elasticNetParam=0.0,
                                  regParam=1.0 / (float(params["C"]) * n_train), standardization=False)
    if key == "tree_classifier":
        return DecisionTreeClassifier(**cols, impurity=params.get("criterion", "entropy"), maxDepth=_depth(params),
                                      **_tree(params, seed))
    if key == "forest_classifier":
        return RandomForestClassifier(**cols, numTrees=int(params["n_estimators"]), maxDepth=_depth(params),
                                      featureSubsetStrategy="sqrt", **_tree(params, seed))
    raise DataError(f"unknown model {key!r}")


@dataclass
class Fitted:
    """A fitted model with the means to score new rows."""

    key: str
    task: str
    params: dict
    features: tuple[str, ...]
    target: str
    encoder: Encoder
    stage: object
    classes: tuple[str, ...] = ()
    y_mean: float = 0.0
    y_scale: float = 1.0
    predictions: DataFrame | None = None
    metrics: DataFrame | None = None
    notes: list[str] = field(default_factory=list)

    def score(self, df: DataFrame) -> DataFrame:
        """Add `predicted` (and `scores` per class) to any table with the feature columns."""
        return score_stage(self, self.encoder.transform(df))

    def pipeline(self) -> PipelineModel:
        """Encoding and model in one storable pipeline (PLS and boosting have no Spark ML stage)."""
        return PipelineModel([*self.encoder.model.stages, *([] if isinstance(self.stage, (Pls, Boosting)) else [self.stage])])


def score_stage(fitted: Fitted, encoded: DataFrame) -> DataFrame:
    if isinstance(fitted.stage, Pls):
        return pls_predict(encoded, fitted.stage).drop(FEATURES)
    if isinstance(fitted.stage, Boosting):
        found = fitted.stage.scores(F.col(FEATURES))
        if fitted.task == "regression":
            return encoded.withColumn("predicted", F.get(found, F.lit(0)) * fitted.y_scale + fitted.y_mean).drop(FEATURES)
        labels = F.array(*[F.lit(c) for c in fitted.classes])
        best = F.array_position("scores", F.array_max("scores")).cast("int")
        return encoded.withColumn("scores", found).withColumn("predicted", F.element_at(labels, best)).drop(FEATURES)
    raw = fitted.stage.transform(encoded)
    scratch = [FEATURES, "prediction", "rawPrediction", "probability"]
    if fitted.task == "regression":
        return raw.withColumn("predicted", F.col("prediction") * fitted.y_scale + fitted.y_mean).drop(*scratch)
    names = F.array(*[F.lit(c) for c in fitted.classes])
    vector = "probability" if "probability" in raw.columns else "rawPrediction"
    return (raw.withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1))
            .withColumn("scores", vector_to_array(vector)).drop(*scratch))


def classes_of(train: DataFrame, target: str) -> list[str]:
    """Training labels in order; two at least."""
    found = (train.select(col(target).cast("string").alias("c")).filter("c is not null")
             .distinct().limit(MAX_CLASSES + 1).collect())
    if len(found) > MAX_CLASSES:
        raise DataError(f"more than {MAX_CLASSES} classes")
    if len(found) < 2:
        raise DataError("classification needs two classes in the training rows")
    return sorted(r["c"] for r in found)


def check_labels(df: DataFrame, target: str, classes: Sequence[str]) -> None:
    """A label outside the training classes is an error that names up to five."""
    unseen = (df.select(col(target).cast("string").alias("c"))
              .filter("c is not null").filter(~F.col("c").isin(list(classes))).distinct().limit(5).collect())
    if unseen:
        raise DataError(f"labels not seen in training: {sorted(r['c'] for r in unseen)}")


def _boosted(rows: DataFrame, params: Mapping, n_classes: int = 0) -> Boosting:
    return boosting.fit_boosting(rows, FEATURES, LABEL, n_classes, int(params["n_estimators"]), float(params["learning_rate"]),
                                 int(params["num_leaves"]), int(params.get("min_samples_leaf", boosting.LEAST_ROWS)))


def _fit(df: DataFrame, train: DataFrame, key: str, features: tuple[str, ...], target: str, used: dict, seed: int,
         scale: bool) -> Fitted:
    encoder = fit_encoder(train, features, scale)
    encoded = encoder.transform(train)
    if key in REGRESSIONS:
        y = as_number(target)
        row = train.agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("s")).first()
        m, s = float(row["m"]), float(row["s"] or 0.0) or 1.0
        if key == "pls":
            fitted_stage = fit_pls(encoded.withColumn(LABEL, y), LABEL, FEATURES, int(used["n_components"]), encoder.slots)
        else:
            rows = encoded.withColumn(LABEL, (y - m) / s).select(FEATURES, LABEL)
            fitted_stage = _boosted(rows, used) if key == "gbt_regression" else build_estimator(key, used, seed, 0).fit(rows)
        out = Fitted(key, "regression", used, tuple(features), target, encoder, fitted_stage, (), m, s)
    else:
        classes = classes_of(train, target)
        check_labels(df, target, classes)
        indexed = StringIndexerModel.from_labels(classes, inputCol="_text", outputCol=LABEL)
        rows = indexed.transform(encoded.withColumn("_text", col(target).cast("string"))).select(FEATURES, LABEL)
        if key == "gbt_classifier":
            fitted_stage = _boosted(rows, used, len(classes))
        else:
            fitted_stage = build_estimator(key, used, seed, train.count() if key == "logistic" else 0).fit(rows)
        out = Fitted(key, "classification", used, tuple(features), target, encoder, fitted_stage, tuple(classes))
    return out


def fit_supervised(df: DataFrame, key: str, features: Sequence[str], target: str, params: Mapping | None = None,
                   flag: str = "is_train", seed: int = 42, scale: bool = True, evaluate: bool = True) -> Fitted:
    """Fit on the flagged rows; with `evaluate`, score and measure all of them."""
    if key not in DEFAULTS:
        raise DataError(f"unknown model {key!r}")
    used = {**DEFAULTS[key], **(params or {})}
    # the training columns are read by every step of the fit
    train = (df.filter(col(flag)).select(*[col(c) for c in dict.fromkeys([*features, target])])
             .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        out = _fit(df, train, key, tuple(features), target, used, seed, scale)
    finally:
        train.unpersist()
    if out.encoder.dropped:
        out.notes.append(f"columns without training values left out: {list(out.encoder.dropped)}")
    if evaluate:
        out.predictions = out.score(df).withColumn(
            "dataset", F.when(col(flag), F.lit("train")).otherwise(F.lit("test")))
        out.metrics = metrics_of(out)
    return out


def metrics_of(fitted: Fitted) -> DataFrame:
    p = fitted.predictions
    if fitted.task == "regression":
        return regression_metrics(p.withColumn("_y", as_number(fitted.target)), "_y", "predicted")
    # the measures read their rows several times; the model scores them once
    p = stored(p.select("dataset", col(fitted.target).cast("string").alias("_y"), "predicted", "scores"), "scored")
    acc = accuracy(p, "_y", "predicted")
    area = macro_auc(p.select("dataset", "_y", "scores"), "scores", "_y", fitted.classes, ["dataset"])
    return acc.join(F.broadcast(area), "dataset", "left")


