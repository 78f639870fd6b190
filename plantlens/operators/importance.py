"""What a fitted model pays attention to."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions.columns import as_number, col
from plantlens.functions.lineage import stored
from plantlens.operators.boosting import Boosting
from plantlens.operators.evaluate import macro_auc, regression_metrics
from plantlens.operators.identity import DataError
from plantlens.operators.ordered import number_rows
from plantlens.operators.splits import shuffle_key
from plantlens.operators.supervised import Fitted

# Rows whose values a task holds while a permutation is joined.
JOIN_ROWS = 100_000


def _table(spark: SparkSession, names: Sequence[str], values, column: str) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, f"feature string, {column} double")


def coefficient_importance(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """Standardised coefficients; for several classes the mean absolute value over them."""
    if fitted.key == "linear":
        beta = fitted.stage.coefficients.toArray()
    elif fitted.key == "pls":
        beta = fitted.stage.coefficients
    elif fitted.key == "logistic":
        m = fitted.stage.coefficientMatrix.toArray()
        beta = m[0] if len(m) == 1 else np.abs(m).mean(axis=0)
    else:
        raise DataError(f"{fitted.key} has no coefficients")
    t = _table(spark, fitted.encoder.slots, beta, "beta").withColumn("abs_beta", F.abs("beta"))
    return t.orderBy(F.col("abs_beta").desc(), "feature")


def tree_importance(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """Share of each slot in the impurity gain, or in the gain of a boosting's loss."""
    boosted = isinstance(fitted.stage, Boosting)
    gain = fitted.stage.importances() if boosted else fitted.stage.featureImportances.toArray()
    return _table(spark, fitted.encoder.slots, gain, "gain").orderBy(F.col("gain").desc(), "feature")


def _coprime_steps(n: int, count: int, seed: int) -> list[tuple[int, int]]:
    """(step, offset) pairs; position -> (step x position + offset) mod n is a permutation."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < count:
        step = int(rng.integers(1, max(2, n)))
        if math.gcd(step, n) == 1:
            out.append((step, int(rng.integers(0, max(1, n)))))
    return out


def permutation_importance(fitted: Fitted, rows: DataFrame, id_col: str = "id", n_repeats: int = 10,
                           seed: int = 42, block_rows: int | None = None) -> DataFrame:
    """Loss of score when one raw column is shuffled, mean and sd over the repeats.

    Rows are numbered in hash order once; a repeat maps the numbers by an affine
    permutation, so a shuffle is a join on unique numbers. All columns and repeats
    are stacked and scored by one job: RMSE for numbers, AUC for classes.
    """
    features = list(fitted.features)
    target = as_number(fitted.target) if fitted.task == "regression" else col(fitted.target).cast("string")
    base = rows.select(*[col(f).alias(f"f{i}") for i, f in enumerate(features)], target.alias("_y"),
                       shuffle_key(id_col, seed).alias("_h"), col(id_col).cast("string").alias("_id"))
    base = base.filter("_y is not null")
    n = base.count()
    if n < 2:
        raise DataError("permutation importance needs two rows")
    values = [f"f{i}" for i in range(len(features))]
    base = number_rows(base, ["_h", "_id"], "_pos", block_rows=block_rows)
    base = stored(base.select((F.col("_pos") - 1).alias("_pos"), *values, "_y"), "numbered")
    steps = _coprime_steps(n, n_repeats, seed)

    def target_of(a: int, b: int) -> Column:
        place = F.lit(a).cast("decimal(38,0)") * F.col("_pos").cast("decimal(19,0)") + F.lit(b).cast("decimal(38,0)")
        return F.pmod(place, F.lit(n).cast("decimal(38,0)")).cast("bigint")

    # only what is scored goes through the shuffle; a task holds a bounded part of the values in a hash table and sorts nothing
    repeats = F.array(*[F.struct(F.lit(r).alias("repeat"), target_of(a, b).alias("to")) for r, (a, b) in enumerate(steps)])
    fan = base.select(F.explode(repeats).alias("_r"), *values, "_y").select(
        F.col("_r.repeat").alias("_repeat"), F.col("_r.to").alias("_to"), *values, "_y")
    other = base.select(F.col("_pos").alias("_to"), *[F.col(f).alias(f"g{i}") for i, f in enumerate(values)])
    n_parts = -(-n // JOIN_ROWS)
    if n_parts > 1:
        fan, other = fan.repartition(n_parts, "_to"), other.repartition(n_parts, "_to").hint("shuffle_hash")
    joined = fan.join(other, "_to")
    stacked = joined.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    shuffled = stacked.select(
        F.col("_j"), "_repeat", "_y",
        *[F.when(F.col("_j") == i, F.col(f"g{i}")).otherwise(F.col(f"f{i}")).alias(f) for i, f in enumerate(features)])
    plain = base.select(F.lit(-1).alias("_j"), F.lit(0).alias("_repeat"), "_y",
                        *[F.col(f"f{i}").alias(f) for i, f in enumerate(features)])
    scored = fitted.score(shuffled.unionByName(plain))
    by = ["_j", "_repeat"]
    if fitted.task == "regression":
        score = regression_metrics(scored, "_y", "predicted", by).select(*by, (-F.col("RMSE")).alias("s"))
    else:
        score = macro_auc(scored.select(*by, "_y", "scores"), "scores", "_y", fitted.classes, by).select(
            *by, F.col("auc").alias("s"))
    # (columns x repeats + 1) scores in all
    found = {(r["_j"], r["_repeat"]): r["s"] for r in score.collect()}
    start = found[(-1, 0)]
    out = []
    for i, f in enumerate(features):
        drops = np.array([np.nan if start is None or found.get((i, r)) is None else start - found[(i, r)]
                          for r in range(n_repeats)], float)
        out.append((f, float(drops.mean()), float(drops.std())))
    spark = rows.sparkSession
    return (spark.createDataFrame(out, "feature string, importance_mean double, importance_sd double")
            .orderBy(F.col("importance_mean").desc(), "feature"))


def _boosted_nodes(spark: SparkSession, fitted: Fitted, max_depth: int, tree: int) -> DataFrame:
    """Nodes of one tree of a boosting; trees are numbered round by round. A leaf's prediction is what it adds to the score."""
    trees = [t for r in fitted.stage.rounds for t in r]
    if not 0 <= tree < len(trees):
        raise DataError(f"there are {len(trees)} trees")
    t, rows, level = trees[tree], [], [0]
    for depth in range(max_depth + 1):
        for i in level:
            inner = t.slot[i] >= 0
            rows.append((int(i), depth, fitted.encoder.slots[t.slot[i]] if inner else None, float(t.threshold[i]) if inner else None,
                         float(t.gain[i]) if inner else None, None, float(t.rows[i]), str(float(t.value[i])),
                         int(t.left[i]) if inner else None, int(t.right[i]) if inner else None))
        level = [c for i in level if t.slot[i] >= 0 for c in (t.left[i], t.right[i])]
    return spark.createDataFrame(rows, "id int, depth int, feature string, threshold double, gain double, impurity double, rows double, "
                                 "prediction string, left int, right int")


def tree_nodes(spark: SparkSession, fitted: Fitted, path: str, max_depth: int = 3, tree: int = 0) -> DataFrame:
    """Nodes of a fitted tree down to a depth, read from the stored model.

    `path` is a folder every executor can reach; the model is written there.
    """
    stage = fitted.stage
    if isinstance(stage, Boosting):
        return _boosted_nodes(spark, fitted, max_depth, tree)
    stage.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.filter(F.col("treeID") == tree).select("nodeData.*")
    # parents down to max_depth, one level per step over the small node table
    level = data.filter("id = 0").withColumn("depth", F.lit(0))
    out = level
    for depth in range(1, max_depth + 1):
        kids = level.filter("leftChild >= 0").select(F.explode(F.array("leftChild", "rightChild")).alias("id"))
        level = data.join(kids, "id", "left_semi").withColumn("depth", F.lit(depth))
        out = out.unionByName(level)
    names = F.array(*[F.lit(s) for s in fitted.encoder.slots])
    count = F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b) if fitted.task == "classification" \
        else F.get("impurityStats", F.lit(0))
    leaf = F.col("leftChild") < 0
    if fitted.task == "classification":
        value = F.element_at(F.array(*[F.lit(c) for c in fitted.classes]), F.col("prediction").cast("int") + 1)
    else:
        value = (F.col("prediction") * fitted.y_scale + fitted.y_mean).cast("string")
    return out.select(
        "id", "depth", F.when(~leaf, F.get(names, F.col("split.featureIndex"))).alias("feature"),
        F.when(~leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(~leaf, F.col("gain")).alias("gain"), "impurity", count.alias("rows"), value.alias("prediction"),
        F.when(~leaf, F.col("leftChild")).alias("left"), F.when(~leaf, F.col("rightChild")).alias("right"))
