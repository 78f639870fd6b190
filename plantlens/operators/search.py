"""Parameter search by cross-validation, and the size of what is searched."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions.columns import col
from plantlens.operators.crossval import MOST_COLUMNS, read_columns, search_by_moments
from plantlens.operators.identity import DataError
from plantlens.operators.ordered import SERIES_BROADCAST_LIMIT, lay_out
from plantlens.operators.splits import rank_threshold, shuffle_key
from plantlens.operators.supervised import DEFAULTS, REGRESSIONS, fit_supervised

# Candidate grids per model, random draws, and the workload notes.
GRIDS: dict[str, dict[str, list]] = {
    "linear": {"fit_intercept": [True, False]},
    "pls": {"n_components": [1, 2, 3, 4]},
    "gbt_regression": {"n_estimators": [100, 300, 500], "learning_rate": [0.03, 0.05, 0.1], "num_leaves": [15, 31, 63]},
    "forest_regression": {"n_estimators": [200, 400], "max_depth": [None, 6, 12], "min_samples_leaf": [1, 3, 5]},
    "logistic": {"C": [0.1, 1.0, 10.0]},
    "gbt_classifier": {"n_estimators": [100, 300, 500], "learning_rate": [0.03, 0.05, 0.1], "num_leaves": [15, 31, 63]},
    "tree_classifier": {"criterion": ["entropy"], "max_depth": [None, 4, 8, 12], "min_samples_leaf": [1, 3, 5]},
    "forest_classifier": {"n_estimators": [200, 400], "max_depth": [None, 6, 12], "min_samples_leaf": [1, 3, 5]},
}
RANDOM_DRAWS = 20
MANY_FITS, VERY_MANY_FITS = 300, 1000


def candidates(grid: Mapping[str, Sequence]) -> list[dict]:
    keys = [k for k, v in grid.items() if v]
    return [dict(zip(keys, values)) for values in product(*(grid[k] for k in keys))] if keys else []


def combinations(grid: Mapping[str, Sequence] | None) -> int:
    sizes = [len(v) for v in (grid or {}).values() if v]
    return math.prod(sizes) if sizes else 0


def random_draws(grid: Mapping[str, Sequence] | None, default: int = RANDOM_DRAWS) -> int:
    return min(combinations(grid), max(1, default))


def folds_of(value) -> int:
    return max(2, min(int(value), 10))


def search_workload(grid: Mapping[str, Sequence], folds: int = 5, method: str = "grid") -> dict:
    """Candidates, fits, and a note when that is a lot."""
    n = random_draws(grid) if method == "random" else combinations(grid)
    fits = n * folds_of(folds)
    note = "very many fits" if fits >= VERY_MANY_FITS else "many fits" if fits >= MANY_FITS else ""
    return {"candidates": n, "folds": folds_of(folds), "fits": fits, "note": note}


def sample_size(n: int, ratio: float | None = 1.0, max_rows: int | None = None) -> int:
    """Rows of a search: a share from 5 to 100 percent, at most max_rows, never under two of those there are."""
    share = 1.0 if ratio is None else sorted((0.05, float(ratio), 1.0))[1]
    limits = [n * share, *([int(max_rows)] if max_rows and int(max_rows) > 0 else [])]
    return max(0, min(n, max(2, math.floor(min(limits)))))


def search_sample(train: DataFrame, ratio: float | None = 1.0, max_rows: int | None = None, id_col: str = "id",
                  label: str | None = None, seed: int = 42, block_rows: int | None = None) -> DataFrame:
    """A sub-sample of exact size by hash order, for the search only.

    With a label whose classes all have two rows every class keeps its share; the
    sizes are rounded by largest remainder so that they add up.
    """
    n = train.count()
    target = sample_size(n, ratio, max_rows)
    if target >= n:
        return train
    if label:
        counts = train.groupBy(col(label).cast("string").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
        facts = counts.agg(F.count("_c").alias("classes"), F.min("_n").alias("least"), F.count(F.when(F.col("_c").isNull(), 1)).alias("missing"),
                           F.sum(F.floor(F.col("_n") * F.lit(target) / F.lit(n))).alias("sure")).first()
        if facts["classes"] >= 2 and facts["least"] >= 2 and not facts["missing"]:
            share = F.col("_n") * F.lit(target)
            by_rest = Window.orderBy(F.pmod(share, F.lit(n)).desc(), "_c")
            size = counts.select("_c", (F.floor(share / F.lit(n)) + F.when(
                F.row_number().over(by_rest) <= target - facts["sure"], 1).otherwise(0)).alias("_size"))
            work = train.withColumns({"_lab": col(label).cast("string"), "_h": shuffle_key(id_col, seed)})
            numbered = lay_out(work, ["_lab"], ["_h", id_col], block_rows).with_position("_pos").result()
            side = F.broadcast(size) if facts["classes"] <= SERIES_BROADCAST_LIMIT else size
            return numbered.join(side, F.col("_lab") == F.col("_c")).filter("_pos <= _size").drop("_lab", "_h", "_pos", "_c", "_size")
    h = shuffle_key(id_col, seed)
    cut = rank_threshold(train.select(h.alias("h"), col(id_col).cast("string").alias("id")), target)
    return train.filter((h < cut[0]) | ((h == cut[0]) & (col(id_col).cast("string") <= cut[1])))


def assign_folds(train: DataFrame, folds: int, id_col: str = "id", label: str | None = None, seed: int = 42,
                 out: str = "fold", block_rows: int | None = None) -> DataFrame:
    """Fold 0..k-1 of even size by hash order, within every class for classifiers."""
    work = train.withColumn("_h", shuffle_key(id_col, seed))
    series = []
    if label:
        work, series = work.withColumn("_lab", col(label).cast("string")), ["_lab"]
    numbered = lay_out(work, series, ["_h", id_col], block_rows).with_position("_pos").result()
    return numbered.withColumn(out, F.pmod("_pos", F.lit(int(folds))).cast("int")).drop("_h", "_pos", "_lab")


def search(train: DataFrame, key: str, features: Sequence[str], target: str, grid: Mapping[str, Sequence] | None = None,
           folds: int = 5, method: str = "grid", id_col: str = "id", seed: int = 42, parallelism: int = 4,
           ratio: float | None = 1.0, max_rows: int | None = None, base: Mapping | None = None,
           fold_col: str | None = None) -> tuple[dict, DataFrame]:
    """Best parameters and a table of mean scores: RMSE for numbers, AUC for classes.

    The encoding is learned anew inside every fold, so nothing leaks from the rows
    a candidate is judged on. Linear and PLS candidates are all scored from one pass of moments; fits of other candidates
    and folds run side by side. `fold_col` names a column with folds 0, 1, ... to be used instead of new ones.
    """
    regression = key in REGRESSIONS
    grid = grid or GRIDS[key]
    trials = candidates(grid)
    if method == "random":
        picks = np.random.default_rng(seed).permutation(len(trials))[:random_draws(grid)]
        trials = [trials[i] for i in sorted(picks)]
    if not trials:
        raise DataError("the grid is empty")
    label = None if regression else target
    rows = search_sample(train, ratio, max_rows, id_col, label, seed)
    k = folds_of(folds)
    if regression:
        k = min(k, rows.limit(k).count())
    else:
        smallest = rows.groupBy(col(target)).count().agg(F.min("count").alias("m"), F.count(F.lit(1)).alias("c")).first()
        if smallest["c"] < 2 or smallest["m"] < 2:
            raise DataError("cross-validation needs two classes with two rows each")
        k = max(2, min(k, smallest["m"]))
    if fold_col:
        k = int(rows.agg(F.max(col(fold_col))).first()[0]) + 1
        rows = rows.withColumn("fold", col(fold_col).cast("int"))
    else:
        rows = assign_folds(rows, k, id_col, label, seed)
    rows = rows.select(*[col(c) for c in dict.fromkeys([id_col, *features, target])], "fold").persist(StorageLevel.MEMORY_AND_DISK)

    def one(job: tuple[int, int]) -> tuple[int, int, float | None]:
        i, fold = job
        split = rows.withColumn("_train", F.col("fold") != fold)
        fitted = fit_supervised(split, key, features, target, {**(base or {}), **trials[i]}, "_train", seed)
        row = fitted.metrics.filter("dataset = 'test'").first()
        return i, fold, row["RMSE" if regression else "auc"]

    try:
        columns = read_columns(rows, features) if key in ("linear", "pls") else None
        if columns is not None and len(columns) <= MOST_COLUMNS:
            by_trial = search_by_moments(rows, key, features, target, [{**DEFAULTS[key], **(base or {}), **t} for t in trials], range(k), columns)
            done = [(i, f, s) for i, scores in enumerate(by_trial) for f, s in enumerate(scores)]
        else:
            with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
                done = list(pool.map(one, [(i, f) for i in range(len(trials)) for f in range(k)]))
    finally:
        rows.unpersist()
    means = []
    for i, trial in enumerate(trials):
        values = [s for j, _, s in done if j == i and s is not None]
        means.append((i, str(trial), float(np.mean(values)) if values else None, k))
    usable = [m for m in means if m[2] is not None]
    if not usable:
        raise DataError("no candidate could be scored")
    best = min(usable, key=lambda m: (m[2] if regression else -m[2], m[0]))
    table = train.sparkSession.createDataFrame(
        means, f"candidate int, params string, {'rmse' if regression else 'auc'} double, folds int")
    return trials[best[0]], table


def grid_search(*args, **kwargs) -> tuple[dict, DataFrame]:
    return search(*args, **kwargs, method="grid")


def random_search(*args, **kwargs) -> tuple[dict, DataFrame]:
    return search(*args, **kwargs, method="random")
