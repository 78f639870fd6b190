"""Ordered operators against pandas and plain loops, in one block and in many."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantlens.operators import charts, features, ordered, quantiles, splits, tags
from plantlens.plans.prepare import PrepareConfig, prepare

BLOCKS = [None, 13]


@pytest.fixture(scope="module")
def frame():
    """Three series of uneven size, one with most rows; NULL runs, ties in the order column."""
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for k, n in (("big", 150), ("mid", 40), ("one", 1)):
        for t in range(n):
            missing = 20 <= t < 45 and k == "big" or t < 3 and k == "mid" or rng.random() < 0.1
            rows.append((k, f"{i:04d}", t // 2, None if missing else float(np.round(rng.normal(10, 3), 3))))
            i += 1
    rng.shuffle(rows)
    return pd.DataFrame(rows, columns=["k", "id", "t", "x"]).astype({"t": int})


@pytest.fixture(scope="module")
def table(spark, frame):
    rows = [tuple(None if v is None or v != v else v for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "k string, id string, t bigint, x double").repartition(5)


def ordered_pdf(frame, series=True):
    p = frame.assign(x=pd.to_numeric(frame.x)).sort_values(["k", "t", "id"] if series else ["t", "id"])
    return p, (p.groupby("k").x if series else p.groupby(np.zeros(len(p), int)).x)


def same(df, column, p, want):
    got = df.toPandas().set_index("id")[column].astype(float)
    pd.testing.assert_series_equal(got.loc[p.id.values].reset_index(drop=True),
                                   pd.Series(np.asarray(want, float)), check_names=False, atol=1e-9, rtol=1e-9)


def placed(series, block_rows):
    return {"order_cols": ["t", "id"], "series_cols": ["k"] if series else [], "block_rows": block_rows}


@pytest.mark.parametrize("block_rows", BLOCKS)
@pytest.mark.parametrize("series", [True, False])
def test_position(table, frame, block_rows, series):
    p, g = ordered_pdf(frame, series)
    out = ordered.number_rows(table, ["t", "id"], "n", ["k"] if series else [], block_rows)
    same(out, "n", p, g.cumcount() + 1)


@pytest.mark.parametrize("block_rows", BLOCKS)
@pytest.mark.parametrize("series", [True, False])
def test_lags(table, frame, block_rows, series):
    p, g = ordered_pdf(frame, series)
    out = features.add_lags(table, {"x": [1, 30]}, ["t", "id"], ["k"] if series else [], block_rows)
    same(out, "x_lag1", p, g.shift(1))
    same(out, "x_lag30", p, g.shift(30))


@pytest.mark.parametrize("block_rows", BLOCKS)
@pytest.mark.parametrize("center", [False, True])
@pytest.mark.parametrize("window", [4, 31])
def test_sma(table, frame, block_rows, center, window):
    p, g = ordered_pdf(frame)
    out = features.add_sma(table, "x", window, 2, center, **placed(True, block_rows))
    same(out, f"x_sma{window}", p, g.transform(lambda v: v.rolling(window, min_periods=2, center=center).mean()))


@pytest.mark.parametrize("block_rows", BLOCKS)
@pytest.mark.parametrize("adjust", [False, True])
@pytest.mark.parametrize("span", [1, 2, 9, 200])
def test_ema(table, frame, block_rows, adjust, span):
    p, g = ordered_pdf(frame)
    out = features.add_ema(table, "x", span, 2, adjust, **placed(True, block_rows))
    same(out, f"x_ema{span}", p, g.transform(lambda v: v.ewm(span=span, min_periods=2, adjust=adjust).mean()))


@pytest.mark.parametrize("block_rows", BLOCKS)
@pytest.mark.parametrize("alpha", [0.05, 0.95])
def test_charts(table, frame, block_rows, alpha):
    p, _ = ordered_pdf(frame, False)
    p = p.dropna(subset=["x"])
    v = p.x.to_numpy()
    k = round(len(v) * 0.8)
    mean, sd = v[:k].mean(), v[:k].std()
    e, ewma, cp, cm, plus, minus = mean, [], 0.0, 0.0, [], []
    for x in v:
        e = alpha * x + (1 - alpha) * e
        z = (x - mean) / sd
        cp, cm = max(0.0, cp + z - 0.5), min(0.0, cm + z + 0.5)
        ewma.append(e), plus.append(cp), minus.append(cm)
    chart = charts.ewma_chart(table, "x", alpha, **placed(False, block_rows))
    same(chart, "ewma", p, ewma)
    i = np.arange(1, len(v) + 1)
    same(chart, "ucl", p, mean + 3 * sd * np.sqrt(alpha / (2 - alpha) * (1 - (1 - alpha) ** (2 * i))))
    cusum = charts.cusum_chart(table, "x", **placed(False, block_rows))
    same(cusum, "c_plus", p, plus)
    same(cusum, "c_minus", p, minus)


def test_short_series_keeps_its_rows(table, frame):
    chart = charts.ewma_chart(table, "x", **placed(True, None))
    assert chart.count() == frame.x.notna().sum()
    assert chart.filter("k = 'one' and ewma is not null").count() == 0


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_decomposition_adds_up(table, frame, block_rows):
    out = features.seasonal_decompose(table, "x", 6, **placed(True, block_rows)).toPandas()
    assert len(out) == len(frame)
    done = out.dropna(subset=["x_season_p6_trend"])
    total = done.x_season_p6_trend + done.x_season_p6_seasonal + done.x_season_p6_resid
    assert len(done) > 100 and np.allclose(total, done.x.astype(float))
    assert out[out.k == "one"].x_season_p6_trend.isna().all()


def test_hot_series_is_cut(table):
    """A series with most of the rows spans many blocks; none holds more than a few times the limit."""
    blocks = ordered.lay_out(table, ["k"], ["t", "id"], 13)
    sizes = [r["count"] for r in blocks.data.groupBy("_blk").count().collect()]
    assert blocks.n_blocks > 8 and max(sizes) < 13 * 4
    assert sum(sizes) == table.count()


def test_same_time_everywhere(spark):
    """One order value for all rows: the id keeps the blocks apart."""
    t = spark.range(500).select(F.lit(7).alias("t"), F.format_string("%05d", "id").alias("id"))
    out = ordered.number_rows(t, ["t", "id"], "n", block_rows=40).toPandas().sort_values("id")
    assert list(out.n) == list(range(1, 501))


def test_small_blocks_share_tasks(spark):
    """Tasks follow the rows and not the blocks, however few rows a block may have."""
    t = spark.range(6_000).select((F.col("id") % 7).alias("t"), "id")
    blocks = ordered.lay_out(t, [], ["t", "id"], 10).with_position("n")
    assert blocks.n_blocks > 300
    assert blocks.data.rdd.getNumPartitions() <= max(ordered.OWN_TASKS, spark.sparkContext.defaultParallelism)
    assert [r["n"] for r in blocks.data.orderBy("t", "id").collect()] == list(range(1, 6_001))


def test_blocks_share_a_task_up_to_its_rows(spark):
    """No task holds more than `blockRows` rows, by the mean size of a block."""
    t = spark.range(4_000)
    spark.conf.set(ordered.BLOCK_ROWS_CONF, "100")
    try:
        blocks = ordered.lay_out(t, [], ["id"], 20).in_tasks()
        n = blocks.data.rdd.getNumPartitions()
        assert n < blocks.n_blocks and -(-blocks.n_blocks // n) * 4_000 <= 100 * blocks.n_blocks
        whole = blocks.data.select("_blk", F.spark_partition_id().alias("p")).distinct().groupBy("_blk").count()
        assert whole.agg(F.max("count")).first()[0] == 1
        assert ordered.lay_out(t, [], ["id"], 300).in_tasks().data.rdd.getNumPartitions() == 14
    finally:
        spark.conf.unset(ordered.BLOCK_ROWS_CONF)


def test_many_bounds(spark):
    """Blocks past the decision tree are still stretches of the order, with missing keys, repeated rows and a join on the block."""
    rng = np.random.default_rng(3)
    rows = [(None if i % 11 == 0 else f"s{i % 3}", None if i % 13 == 0 else float(rng.integers(40)) / 4, i // 2) for i in range(4_000)]
    t = spark.createDataFrame(rows, "k string, t double, id bigint").repartition(3)
    blocks = ordered.lay_out(t, ["k"], ["t", "id"], 2)
    assert blocks.n_blocks > 1_000
    key = lambda r: (r["k"] is not None, r["k"] or "", r["t"] is None, r["t"] or 0.0, r["id"])
    found = sorted(blocks.data.collect(), key=key)
    numbers = [r["_blk"] for r in found]
    assert numbers == sorted(numbers) and len(set(numbers)) == blocks.n_blocks and max(numbers) == blocks.n_blocks - 1
    assert all(a["_blk"] == b["_blk"] for a, b in zip(found, found[1:]) if key(a) == key(b))
    placed = sorted(blocks.with_position("n").data.collect(), key=lambda r: (*key(r)[:2], r["n"]))
    assert [key(r) for r in placed] == [key(r) for r in found]


def test_long_block_keeps_precision(spark):
    n = 60_000
    x = np.random.default_rng(0).normal(50, 5, n)
    t = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": x}))
    out = features.add_ema(t, "x", 3, order_cols=["id"]).toPandas().sort_values("id")
    assert np.abs(out.x_ema3 - pd.Series(x).ewm(span=3, adjust=False).mean()).max() < 1e-9


def test_lookahead_refused(spark):
    t = spark.createDataFrame([(str(i), i, 10.0 + i, 2.0 * i) for i in range(6)], "id string, time bigint, temp double, pressure double")
    out = prepare(t, PrepareConfig(lags={"temp": [1], "pressure": [-1]}, features=[("temp_diff", "temp - temp_lag1")],
                                   split_method="sequential", train_ratio=0.5, order_cols=["time"]))
    assert {"temp_lag1", "temp_diff"} <= set(out.data.columns) and "pressure_lag-1" not in out.data.columns
    assert any("refused" in w for w in out.warnings)
    assert tuple(out.counts().first()) == (3, 3)


def test_train_scaling(spark):
    values = [10, 12, 14, 16, 50, 52, 54, 56]
    t = spark.createDataFrame([(str(i), i, float(v)) for i, v in enumerate(values)], "id string, time bigint, value double")
    out = prepare(t, PrepareConfig(split_method="sequential", train_ratio=0.5, order_cols=["time"], standardize=True))
    row = out.data.filter("is_train").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).first()
    assert row["m"] == pytest.approx(0) and row["s"] == pytest.approx(1)


def test_expressions(spark):
    t = spark.createDataFrame([("1", 4.0, 2.0), ("2", 1.0, 0.0), ("3", -1.0, 3.0)], "id string, a double, b double")
    warnings: list[str] = []
    out = features.add_features(t, [("r", "a / b"), ("l", "ln(a)"), ("bad", "nothing + 1"), ("sub", "(select 1)")], warnings)
    rows = {r["id"]: r for r in out.collect()}
    assert rows["1"]["r"] == 2.0 and rows["2"]["r"] is None and rows["3"]["l"] is None
    assert len(warnings) == 2 and "bad" not in out.columns


@pytest.mark.parametrize("ratio", [0.05, 0.5, 0.8, 0.99])
def test_random_split_is_exact(table, ratio):
    out = splits.split_random(table, ratio, 3)
    assert out.filter("is_train").count() == splits.train_size(191, ratio)
    again = splits.split_random(table.repartition(2), ratio, 3)
    assert {r["id"] for r in out.filter("is_train").collect()} == {r["id"] for r in again.filter("is_train").collect()}


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_stratified_split_is_exact(table, block_rows):
    out = splits.split_stratified(table, "k", 0.7, block_rows=block_rows).groupBy("k").agg(F.count_if("is_train").alias("n"))
    assert {r["k"]: r["n"] for r in out.collect()} == {"big": 105, "mid": 28, "one": 1}


def test_sizes():
    assert [splits.train_size(n, 0.5) for n in (1, 2, 3, 5, 7)] == [1, 1, 2, 2, 4]
    assert splits.clamp_ratio(2) == 0.95 and splits.clamp_ratio("x") == 0.8
    assert splits.effective_split("random", True) == "sequential"


@pytest.mark.parametrize("state_rows", [1_000_000, 50])
def test_quantiles(spark, state_rows):
    rng = np.random.default_rng(2)
    a, b = rng.exponential(5, 4000), np.repeat([1.0, 2.0, 3.0, 9.0], [100, 2500, 1300, 100])
    t = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(t, {"a": F.col("a"), "b": F.col("b"), "none": F.lit(None)}, probs, state_rows)
    assert np.allclose(got["a"], np.quantile(a, probs)) and np.allclose(got["b"], np.quantile(b, probs))
    assert got["none"] == [None] * 5


@pytest.mark.parametrize("values", [[0.0] * 500 + [1.0] * 500, [0.0] * 499 + [1.0] * 501, [5.0] * 1000, [0.0, 1e-300, 1.0] * 300])
def test_quantiles_at_borders(spark, values):
    t = spark.createDataFrame(pd.DataFrame({"x": values}))
    probs = [0.0, 0.25, 1 / 3, 0.5, 0.499, 2 / 3, 1.0]
    got = quantiles.exact_quantiles(t, {"x": F.col("x")}, probs, 20)
    assert np.allclose(got["x"], np.quantile(values, probs))


@pytest.mark.parametrize("block_rows", [None, 7])
def test_interpolation(spark, block_rows):
    rows = [("p", f"2024-01-01 00:{m:02d}:00", v, g) for m, v, g in
            ((10, 1.0, True), (20, 3.0, True), (25, 99.0, False), (40, 7.0, True), (45, None, True))]
    t = spark.createDataFrame(rows, "tag string, ts string, value double, is_good boolean") \
        .withColumn("timestamp", F.to_timestamp_ntz("ts")).drop("ts")
    out = tags.tag_interpolated(t, "2024-01-01 00:05:00", "2024-01-01 00:45:00", "5min", block_rows=block_rows)
    got = [r["value"] for r in out.orderBy("timestamp").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, None]


def test_names():
    assert tags.name_list("tag_a\ntag_b,tag_c; tag_b") == ("tag_a", "tag_b", "tag_c")
    assert tags.name_list("ＴＡＧ１、tag1，Ｂ；") == ("TAG1", "B")
    assert tags.summary_functions(["std", "COUNT"]) == ("count", "std") and tags.summary_functions([]) == tags.DEFAULT_SUMMARIES
    assert tags.max_rows_of(10**9) == 10**9 and tags.max_rows_of(None) is None
    assert tags.seconds_of("1h") == 3600


def test_event_frames_without_case_or_width(spark):
    t = spark.createDataFrame([("e1", "Ｓｔｏｐ", ["Ｌｉｎｅ Check"], "el"), ("e2", "other", ["x"], "el"), ("e3", "", ["line"], "el")],
                              "event_frame string, template string, analyses array<string>, element string") \
        .withColumns({"start_time": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
                      "end_time": F.lit("2024-01-01 00:01:30").cast("timestamp_ntz")})
    out = tags.event_frames(t, "STOP", analyses=["LINE"]).orderBy("event_frame").collect()
    assert [r["event_frame"] for r in out] == ["e1", "e3"] and out[0]["duration_sec"] == 90.0


@pytest.mark.parametrize("step", ["lags", "sma"])
def test_halo_joins_on_equal_keys(table, step):
    """Rows reach over block edges by a join with keys, not by comparing all rows with all blocks."""
    order = ["t", "id"]
    if step == "lags":
        out = features.add_lags(table, {"x": [1, 5]}, order, ["k"], block_rows=13)
    else:
        out = features.add_sma(table, "x", 7, center=True, order_cols=order, series_cols=["k"], block_rows=13)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_blocks_have_tasks_of_their_own(spark):
    """No task holds more than a block, through positions and scans, and the numbers are those of one block."""
    rows = spark.range(6000).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("kind"), F.rand(3).alias("value"))
    blocks = ordered.lay_out(rows, ["kind"], ["event_id"], 400).with_position("_pos")
    blocks = ordered.affine_scan(blocks, F.lit(0.1), F.col("value"), "_e")
    where = blocks.data.withColumn("_task", F.spark_partition_id())
    assert where.groupBy("_task").agg(F.countDistinct("_blk").alias("n")).filter("n > 1").count() == 0
    assert blocks.n_blocks > 10 and where.select("_task").distinct().count() == blocks.n_blocks
    whole = ordered.affine_scan(ordered.lay_out(rows, ["kind"], ["event_id"], 10_000).with_position("_pos"), F.lit(0.1), F.col("value"), "_e").result()
    far = whole.alias("a").join(blocks.result().alias("b"), "event_id").filter("a._pos <> b._pos OR abs(a._e - b._e) > 1e-9")
    assert whole.count() == blocks.result().count() == 6000 and far.count() == 0


def test_default_blocks_are_bounded(spark):
    assert ordered.lay_out(spark.range(900_000), [], ["id"]).n_blocks >= 2
