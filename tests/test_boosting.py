"""Leaf-wise boosting against a plain best-first version on small tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from plantlens.operators import boosting
from plantlens.operators.boosting import Boosting, fit_boosting, probabilities
from plantlens.operators.identity import DataError

ROWS = T.StructType([T.StructField("v", VectorUDT()), T.StructField("y", T.DoubleType())])


def plain_tree(x, g, h, leaves, least):
    """Best-first growth by trying every split of every leaf."""
    def best(rows):
        top = (0.0, None)
        for j in range(x.shape[1]):
            values = np.unique(x[rows, j])
            for cut in (values[:-1] + values[1:]) / 2:
                left = rows[x[rows, j] <= cut]
                right = rows[x[rows, j] > cut]
                if min(len(left), len(right)) >= least and min(h[left].sum(), h[right].sum()) >= boosting.LEAST_HESSIAN:
                    gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[rows].sum() ** 2 / h[rows].sum()
                    if gain > top[0] + 1e-9:
                        top = (gain, (left, right))
        return top

    open_leaves = [(np.arange(len(x)), best(np.arange(len(x))))]
    while len(open_leaves) < leaves:
        at = max(range(len(open_leaves)), key=lambda i: open_leaves[i][1][0])
        gain, parts = open_leaves[at][1]
        if parts is None:
            break
        open_leaves[at:at + 1] = [(p, best(p)) for p in parts]
    out = np.zeros(len(x))
    for rows, _ in open_leaves:
        out[rows] = -g[rows].sum() / h[rows].sum()
    return out


def plain_boosting(x, y, classes, rounds, rate, leaves, least):
    if classes == 0:
        raw = np.full((1, len(y)), y.mean())
    else:
        share = np.bincount(y.astype(int), minlength=classes) / len(y)
        raw = np.repeat((np.log(share) if classes > 2 else np.log(share[1:] / share[0]))[:, None], len(y), axis=1)
    for _ in range(rounds):
        if classes == 0:
            gh = [(raw[0] - y, np.ones(len(y)))]
        elif classes == 2:
            p = 1 / (1 + np.exp(-raw[0]))
            gh = [(p - y, p * (1 - p))]
        else:
            p = np.exp(raw) / np.exp(raw).sum(axis=0)
            gh = [(p[k] - (y == k), classes / (classes - 1) * p[k] * (1 - p[k])) for k in range(classes)]
        raw = raw + rate * np.stack([plain_tree(x, g, h, leaves, least) for g, h in gh])
    return raw


@pytest.mark.parametrize(("classes", "leaves"), [(0, 2), (0, 6), (2, 5), (3, 4)])
def test_equals_the_plain_version(spark, classes, leaves, monkeypatch):
    monkeypatch.setattr(boosting, "_REFRESH", 2)
    rng = np.random.default_rng(classes * 10 + leaves)
    x = np.column_stack([rng.integers(0, 12, 300), rng.normal(size=300).round(1), rng.integers(0, 2, 300)]).astype(float)
    signal = x[:, 0] * (x[:, 1] > 0) + 3 * x[:, 2] + rng.normal(size=300)
    y = signal if not classes else np.digitize(signal, np.quantile(signal, np.arange(1, classes) / classes)).astype(float)
    df = spark.createDataFrame([(Vectors.dense(r), float(v)) for r, v in zip(x, y)] + [(Vectors.dense([0, 0, 0]), None)], ROWS).repartition(3)
    model = fit_boosting(df, "v", "y", classes, 5, 0.3, leaves, 10)
    assert len(model.rounds) == 5 and all((t.slot < 0).sum() <= leaves for r in model.rounds for t in r)
    assert np.allclose(model.raw(x).T, plain_boosting(x, y, classes, 5, 0.3, leaves, 10), atol=1e-6)
    assert np.isclose(model.importances().sum(), 1)
    scored = df.filter("y is not null").select("v", model.scores(df["v"]).alias("s")).toPandas()
    assert np.allclose(np.stack(scored.s), probabilities(model.loss, model.raw(np.stack([v.toArray() for v in scored.v])).T).T)
    assert np.allclose(Boosting.read(model.told()).raw(x), model.raw(x))


def test_many_values_are_binned(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.sign(x) + 0.1 * rng.normal(size=4000)}))
    from plantlens.operators.encode import fit_encoder

    data = fit_encoder(df, ["x"], scale=False).transform(df)
    edges = boosting.bin_edges(data, "features", 4000, 1)[0]
    assert len(edges) <= boosting.MOST_BINS and np.diff(np.searchsorted(np.sort(x), edges)).max() <= 40
    model = fit_boosting(data, "features", "y", n_estimators=20, learning_rate=0.5)
    assert np.mean((model.raw(x[:, None])[:, 0] - np.sign(x)) ** 2) < 0.02


def test_nothing_to_split(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0]), 2.0)] * 50, ROWS)
    model = fit_boosting(df, "v", "y", n_estimators=3)
    assert model.rounds == () and np.allclose(model.raw(np.ones((2, 1))), 2.0)
    with pytest.raises(DataError):
        fit_boosting(df.limit(0), "v", "y")


def test_borders_come_from_all_rows_and_rows_stay_off_the_driver(spark, monkeypatch):
    """Many, few and heavy values over several ranges; nothing but the borders is collected."""
    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(size=4000), rng.integers(0, 9, 4000) / 10, np.where(rng.random(4000) < 0.97, 9.0, rng.normal(size=4000)),
                  np.where(rng.random(4000) < 0.97, 1.0, rng.integers(0, 256, 4000)), np.zeros(4000)], axis=1)
    data = spark.createDataFrame([(Vectors.dense(r), 0.0) for r in x], ROWS).repartition(6)
    monkeypatch.setattr(boosting, "SAMPLE_CELLS", 100, raising=False)
    monkeypatch.setattr(type(data), "collect", lambda self: pytest.fail("rows were collected"))
    found = boosting.bin_edges(data, "v", 4000, 5)
    for j, edges in enumerate(found):
        values, counts = np.unique(x[:, j], return_counts=True)
        last = np.arange(len(values) - 1)
        if len(values) > boosting.MOST_BINS:
            share = np.cumsum(counts) / 4000 * boosting.MOST_BINS
            last = np.unique(np.minimum(np.searchsorted(share, np.arange(1, boosting.MOST_BINS)), len(values) - 2))
        assert np.array_equal(edges, (values[last] + values[last + 1]) / 2)


def test_driver_gets_one_histogram_whatever_the_partitions(spark, monkeypatch):
    """Cells that reach the driver are the same for 2 and 12 partitions, and only of bins in use; so are the trees."""
    rng = np.random.default_rng(6)
    x = np.stack([rng.integers(0, 50, 6000), rng.integers(0, 2, 6000), rng.integers(0, 3, 6000)], axis=1).astype(float)
    data = spark.createDataFrame([(Vectors.dense(r), float(r @ [1, 30, 8])) for r in x], ROWS)
    kind = type(data.rdd)
    plain, seen = kind.collect, []

    def collect(self):
        out = plain(self)
        seen.append(sum(np.size(a) for row in out for a in (row if isinstance(row, tuple) else [row]) if isinstance(a, np.ndarray)))
        return out

    fits = []
    for n in (2, 12):
        parts = data.repartition(n)
        monkeypatch.setattr(kind, "collect", collect)
        found = fit_boosting(parts, "v", "y", n_estimators=2, num_leaves=6)
        monkeypatch.setattr(kind, "collect", plain)
        fits.append((list(seen), [[t.slot.tolist() for t in r] for r in found.rounds]))
        seen.clear()
    assert fits[0] == fits[1]
    assert max(fits[0][0]) <= 3 * 5 * (50 + 2 + 3)


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_passes_equal_the_task(spark, classes, monkeypatch):
    """Cells over many tasks give the trees of cells in one task, with values that are no whole numbers and rows that come twice."""
    monkeypatch.setattr(boosting, "_REFRESH", 2)
    rng = np.random.default_rng(classes)
    x = np.repeat(np.column_stack([rng.integers(0, 9, 400), rng.normal(size=400).round(1)]), 2, axis=0)
    signal = x[:, 0] / 3 - x[:, 1] ** 2 + rng.normal(size=800)
    y = signal if not classes else np.digitize(signal, np.quantile(signal, np.arange(1, classes) / classes)).astype(float)
    df = spark.createDataFrame([(Vectors.dense(r), float(v)) for r, v in zip(x, y)], ROWS).repartition(3)
    alone = fit_boosting(df, "v", "y", classes, 5, 0.3, 6, 10)
    monkeypatch.setattr(boosting, "TASK_BYTES", 0)
    many = fit_boosting(df, "v", "y", classes, 5, 0.3, 6, 10)
    assert [[t.slot.tolist() for t in r] for r in alone.rounds] == [[t.slot.tolist() for t in r] for r in many.rounds]
    assert len(many.rounds) == 5 and np.allclose(alone.raw(x), many.raw(x), atol=1e-12)
    assert np.allclose(alone.raw(x).T, plain_boosting(x, y, classes, 5, 0.3, 6, 10), atol=1e-6)


def test_equal_rows_are_one_cell(spark):
    """Cells follow the bins in use and not the rows, and their sums are those of the labels."""
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 5, 3000), rng.integers(0, 3, 3000)]).astype(float)
    y = rng.normal(size=3000) * 1e3
    df = spark.createDataFrame([(Vectors.dense(r), float(v)) for r, v in zip(x, y)], ROWS).repartition(7)
    cells = boosting._cells(df, "v", "y", [np.arange(4) + 0.5, np.arange(2) + 0.5], "squares", 1, 30).orderBy("bins").toArrow()
    bins, n, sums = boosting._arrays(cells, 2, "squares", 30)
    want = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}).groupby(["a", "b"]).y.agg(["size", "sum"]).reset_index()
    assert (bins == want[["a", "b"]].to_numpy().T).all() and (n == want["size"]).all()
    assert np.allclose(sums[0], want["sum"], rtol=0, atol=1e-9)


def test_rounds_are_no_jobs(spark):
    """A table whose cells fit into a task is fitted in as many jobs for 30 trees as for 3."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 20, (500, 2)).astype(float)
    df = spark.createDataFrame([(Vectors.dense(r), float(v)) for r, v in zip(x, x[:, 0] * x[:, 1] + rng.normal(size=500))], ROWS)
    jobs = []
    for n in (3, 30):
        spark.sparkContext.setJobGroup(f"boosting {n}", "")
        assert len(fit_boosting(df, "v", "y", n_estimators=n).rounds) == n
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosting {n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[0] == jobs[1] < 30


@pytest.mark.parametrize("leaves", [1, 2, 31, 64, 70])
def test_values_without_a_walk(leaves):
    """Rows leave a tree where a walk takes them, with missing values and values on a threshold."""
    rng = np.random.default_rng(leaves)
    nodes, ends = [[-1, 0.0, -1, -1]], [0]
    while len(ends) < leaves:
        at = ends.pop(rng.integers(len(ends)))
        nodes[at] = [int(rng.integers(3)), float(rng.integers(20)), len(nodes), len(nodes) + 1]
        ends += [len(nodes), len(nodes) + 1]
        nodes += [[-1, 0.0, -1, -1], [-1, 0.0, -1, -1]]
    slot, threshold, left, right = (np.array(c) for c in zip(*nodes))
    zero = np.zeros(len(nodes), int)
    tree = boosting.Tree(slot, zero, threshold, left, right, rng.normal(size=len(nodes)), zero, zero)
    x = rng.integers(-1, 21, (2000, 3)).astype(float)
    x[rng.random(x.shape) < 0.05] = np.nan
    model = Boosting("squares", np.array([0.25]), ((tree,), (tree,)), 3)
    value = tree.value[tree.leaves_of_values(x)]
    assert (model.raw(x)[:, 0] == 0.25 + value + value).all()


def test_query_grows_all_trees(spark, monkeypatch):
    """gbt_regression leaves the number of trees at the default."""
    from plantlens.operators import supervised
    from plantlens.queries import BY_NAME

    class Told(Exception):
        pass

    def fit(rows, vector, label, n_classes, n_estimators, *rest):
        raise Told(n_estimators, *rest[:2])

    monkeypatch.setattr(boosting, "fit_boosting", fit)
    with pytest.raises(Told) as told:
        BY_NAME["gbt_regression"].run(spark, "/root/testdata/sf0.001")
    assert told.value.args == (300, 0.05, 31) == tuple(supervised.DEFAULTS["gbt_regression"].values())
