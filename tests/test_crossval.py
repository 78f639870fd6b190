"""Searches by moments against a fit on the rows of every fold."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantlens.operators import search
from plantlens.operators.supervised import fit_supervised


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    n = 240
    p = pd.DataFrame({"id": np.arange(n).astype(str), "a": rng.normal(1e6, 3, n), "b": rng.normal(size=n), "flag": rng.random(n) < 0.3,
                      "kind": rng.choice(["x", "y", "z", None], n), "rare": np.where(np.arange(n) == 7, "once", "often"), "empty": np.nan})
    p["y"] = 2 * (p.a - 1e6) - p.b + 3 * p.flag + (p.kind == "y") * 4 + rng.normal(0, 0.5, n)
    p.loc[::9, "b"] = np.nan
    p.loc[5, "y"] = np.nan
    p["part"] = np.arange(n) % 3
    return spark.createDataFrame(p).withColumn("b", F.when(~F.isnan("b"), F.col("b"))).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).cache()


@pytest.mark.parametrize(("key", "grid"), [("linear", {"fit_intercept": [True, False]}), ("pls", {"n_components": [1, 2, 6]})])
def test_equals_fits_of_the_folds(rows, key, grid):
    # a level that a training part lacks leaves a linear model's constant undetermined, so only PLS gets one
    features = ["a", "b", "flag", "kind", "empty"] + ["rare"] * (key == "pls")
    best, table = search.grid_search(rows, key, features, "y", grid, fold_col="part")
    found = {r.candidate: r.rmse for r in table.collect()}
    whole = rows.filter("y is not null")
    for i, trial in enumerate(search.candidates(grid)):
        errors = []
        for f in range(3):
            fitted = fit_supervised(whole.withColumn("is_train", F.col("part") != f), key, features, "y", trial)
            errors.append(fitted.metrics.filter("dataset = 'test'").first()["RMSE"])
        assert np.isclose(found[i], np.mean(errors), rtol=1e-5)
    assert best == search.candidates(grid)[min(found, key=lambda i: (found[i], i))]


def test_own_folds(rows):
    _, table = search.grid_search(rows, "pls", ["a", "b"], "y", folds=4)
    assert [r.folds for r in table.collect()] == [4] * 4
