"""Fitted models on disk: Spark pipelines plus one metadata row."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from plantlens.operators.boosting import Boosting
from plantlens.operators.encode import Encoder
from plantlens.operators.latent import Pls
from plantlens.operators.supervised import Fitted


def save_model(fitted: Fitted, path: str, overwrite: bool = True) -> None:
    """Write encoder, model, labels, metrics and metadata under `path`."""
    spark = SparkSession.getActiveSession()
    mode = "overwrite" if overwrite else "errorifexists"

    def put(model: PipelineModel, name: str) -> None:
        writer = model.write()
        (writer.overwrite() if overwrite else writer).save(f"{path}/{name}")

    put(fitted.encoder.model, "encoder")
    is_pls = isinstance(fitted.stage, Pls)
    if isinstance(fitted.stage, Boosting):
        boosted = [(json.dumps(fitted.stage.told()),)]
        spark.createDataFrame(boosted, "model string").coalesce(1).write.mode(mode).text(f"{path}/boosting")
    elif not is_pls:
        put(PipelineModel([fitted.stage]), "model")
    e = fitted.encoder
    meta = {"key": fitted.key, "task": fitted.task, "params": fitted.params, "features": list(fitted.features),
            "target": fitted.target, "classes": list(fitted.classes), "y_mean": fitted.y_mean,
            "y_scale": fitted.y_scale, "notes": fitted.notes, "slots": list(e.slots), "sources": list(e.sources),
            "dropped": list(e.dropped)}
    if is_pls:
        s = fitted.stage
        meta["pls"] = {"mean": s.mean.tolist(), "scale": s.scale.tolist(), "y_mean": s.y_mean, "y_scale": s.y_scale,
                       "weights": s.weights.tolist(), "coefficients": s.coefficients.tolist(),
                       "explained": s.explained.tolist(), "slots": list(s.slots)}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(mode).text(f"{path}/meta")
    if fitted.metrics is not None:
        fitted.metrics.write.mode(mode).parquet(f"{path}/metrics")


def load_model(spark: SparkSession, path: str) -> Fitted:
    """Read a stored model back; it scores new rows, and its metrics come as they were stored."""
    meta = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/meta").collect()))
    encoder = Encoder(PipelineModel.load(f"{path}/encoder"), tuple(meta["features"]), tuple(meta["slots"]),
                      tuple(meta["sources"]), tuple(meta["dropped"]))
    if "pls" in meta:
        p = meta["pls"]
        stage = Pls(np.array(p["mean"]), np.array(p["scale"]), p["y_mean"], p["y_scale"], np.array(p["weights"]),
                    np.array(p["coefficients"]), np.array(p["explained"]), tuple(p["slots"]))
    elif meta["key"].startswith("gbt_"):
        stage = Boosting.read(json.loads("".join(r["value"] for r in spark.read.text(f"{path}/boosting").collect())))
    else:
        stage = PipelineModel.load(f"{path}/model").stages[0]
    out = Fitted(meta["key"], meta["task"], meta["params"], tuple(meta["features"]), meta["target"], encoder, stage,
                 tuple(meta["classes"]), meta["y_mean"], meta["y_scale"], notes=list(meta["notes"]))
    try:
        out.metrics = spark.read.parquet(f"{path}/metrics")
    except Exception:  # stored without evaluation
        out.metrics = None
    return out
