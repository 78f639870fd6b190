"""EWMA and CUSUM charts over ordered series, with limits from the train part."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions.columns import as_number, col
from plantlens.operators.identity import DataError
from plantlens.operators.ordered import Blocks, affine_scan, lay_out
from plantlens.operators.splits import train_size_column

# Candidate settings and the wanted share of signals in the train part.
EWMA_GRID = {"alpha": [0.1, 0.2, 0.3], "limit_sigma": [2.5, 3.0, 3.5]}
CUSUM_GRID = {"k": [0.25, 0.5, 0.75], "h": [4.0, 5.0, 6.0]}
WANTED_SIGNAL_RATIO = 0.01
LEAST_ROWS = 6


def _baseline(df: DataFrame, value: str, order_cols: Sequence[str], series_cols: Sequence[str], ratio: float,
              block_rows: int | None) -> Blocks:
    """Rows with a value, their position, the train part and its mean and sd (divisor n).

    A series too short for a chart keeps its rows with missing statistics.
    """
    rows = df.withColumn("_x", as_number(value)).filter("_x is not null")
    blocks = lay_out(rows, series_cols, order_cols, block_rows).with_position("position")
    if blocks.n_rows < LEAST_ROWS:
        raise DataError(f"a series needs at least {LEAST_ROWS} values")
    by = [col(s) for s in series_cols]
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    data = blocks.join_series(blocks.data, sizes)
    size = train_size_column(F.col("_n"), ratio, F.when(F.col("_n") >= 5, F.lit(4)).otherwise(
        F.greatest(F.lit(2), F.col("_n") - 1)))
    data = data.withColumn("_train", F.col("position") <= size)
    x = F.when(F.col("_train") & (F.col("_n") >= LEAST_ROWS), F.col("_x"))
    stats = data.groupBy(*by).agg(F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_sd"))
    data = blocks.join_series(data, stats)
    data = data.withColumn("_sd", F.when(F.col("_sd") > 0, F.col("_sd")).when(F.col("_mean").isNotNull(), F.lit(1.0)))
    return blocks.with_data(data)


def _keep(df: DataFrame, order_cols: Sequence[str], series_cols: Sequence[str]) -> list[Column]:
    return [col(c) for c in dict.fromkeys([*series_cols, *order_cols])]


def _dataset() -> Column:
    return F.when(F.col("_train"), F.lit("train")).otherwise(F.lit("test")).alias("dataset")


def _ewma(blocks: Blocks, alpha: float, out: str) -> Blocks:
    """The average starts at the train mean, so its deviation from the mean starts at 0."""
    return affine_scan(blocks, F.lit(-math.log(1.0 - alpha)), F.lit(alpha) * (F.col("_x") - F.col("_mean")), out)


def _half_width(alpha: float, sigma: float) -> Column:
    decay = F.pow(F.lit(1.0 - alpha), 2.0 * F.col("position"))
    return sigma * F.col("_sd") * F.sqrt(F.lit(alpha / (2.0 - alpha)) * (1.0 - decay))


def _clamp(value, low: float, high: float = math.inf) -> float:
    return min(max(float(value), low), high)


def ewma_chart(df: DataFrame, value: str, alpha: float = 0.2, limit_sigma: float = 3.0, ratio: float = 0.8, *,
               order_cols: Sequence[str], series_cols: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    alpha, limit_sigma = _clamp(alpha, 0.01, 0.95), _clamp(limit_sigma, 0.1)
    blocks = _ewma(_baseline(df, value, order_cols, series_cols, ratio, block_rows), alpha, "_e")
    half = _half_width(alpha, limit_sigma)
    center = F.col("_mean")
    return (blocks.data.withColumn("_h", half)
            .select(*_keep(df, order_cols, series_cols), "position", F.col("_x").alias("value"), _dataset(),
                    (center + F.col("_e")).alias("ewma"), center.alias("center"),
                    (center + F.col("_h")).alias("ucl"), (center - F.col("_h")).alias("lcl"),
                    (F.abs("_e") > F.col("_h")).alias("signal")))


def _cusum(blocks: Blocks, k: float, tag: str = "") -> Blocks:
    """One-sided sums from running sums and running extremes.

    Inside a block C+ = S - min(0, running min S). Across blocks the incoming C
    either dies out or adds to the running sum: C+ = max(local, C_in + S).
    """
    z = (F.col("_x") - F.col("_mean")) / F.col("_sd")
    names = [f"_sp{tag}", f"_sn{tag}", f"c_plus{tag}", f"c_minus{tag}"]
    run = blocks.running()
    data = blocks.data.withColumns({names[0]: F.sum(z - k).over(run), names[1]: F.sum(z + k).over(run)})
    data = data.withColumns({
        names[2]: F.col(names[0]) - F.least(F.lit(0.0), F.min(names[0]).over(run)),
        names[3]: F.col(names[1]) - F.greatest(F.lit(0.0), F.max(names[1]).over(run))})
    if blocks.n_blocks > 1:
        ends = data.groupBy(*[col(c) for c in blocks.keys]).agg(
            *[F.max_by(n, "position").alias(n) for n in names])
        part = [col(s) for s in blocks.series] or [F.lit(0)]
        upto = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)
        ends = ends.withColumns({"_tp": F.sum(names[0]).over(upto), "_tn": F.sum(names[1]).over(upto)})
        carry = blocks.carry(ends, {
            "_cp": lambda w: F.last("_tp").over(w) + F.max(F.col(names[2]) - F.col("_tp")).over(w),
            "_cn": lambda w: F.last("_tn").over(w) + F.min(F.col(names[3]) - F.col("_tn")).over(w)})
        data = blocks.attach(data, carry)
        data = data.withColumns({
            names[2]: F.greatest(F.col(names[2]), F.col("_cp") + F.col(names[0])),
            names[3]: F.least(F.col(names[3]), F.col("_cn") + F.col(names[1]))}).drop("_cp", "_cn")
    return blocks.with_data(data.drop(*names[:2]))


def cusum_chart(df: DataFrame, value: str, k: float = 0.5, h: float = 5.0, ratio: float = 0.8, *,
                order_cols: Sequence[str], series_cols: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    k, h = _clamp(k, 0.05), _clamp(h, 0.5)
    blocks = _cusum(_baseline(df, value, order_cols, series_cols, ratio, block_rows), k)
    return blocks.data.select(
        *_keep(df, order_cols, series_cols), "position", F.col("_x").alias("value"), _dataset(),
        ((F.col("_x") - F.col("_mean")) / F.col("_sd")).alias("z"), "c_plus", "c_minus",
        (F.col("c_plus") > h).alias("signal_high"), (F.col("c_minus") < -h).alias("signal_low"))


def ewma_report(chart: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """Mean, sd, signals and their share per series and data set."""
    return chart.groupBy(*[col(s) for s in series_cols], "dataset").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.count_if("signal").alias("signal_count"),
        F.avg(F.col("signal").cast("double")).alias("signal_ratio"))


def cusum_report(chart: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    either = (F.col("signal_high") | F.col("signal_low")).cast("double")
    return chart.groupBy(*[col(s) for s in series_cols], "dataset").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.count_if("signal_high").alias("positive_signal_count"),
        F.count_if("signal_low").alias("negative_signal_count"), F.avg(either).alias("signal_ratio"))


def suggest_chart_params(df: DataFrame, value: str, kind: str = "ewma", grid: dict[str, list[float]] | None = None,
                         ratio: float = 0.8, *, order_cols: Sequence[str], series_cols: Sequence[str] = (),
                         block_rows: int | None = None, best_only: bool = True) -> DataFrame:
    """The candidate whose share of train signals is nearest 1 %, per series.

    All candidates are columns over one layout of the series; the data is not
    multiplied by the grid. Of equal candidates the first in grid order wins.
    """
    grid = grid or (EWMA_GRID if kind == "ewma" else CUSUM_GRID)
    blocks = _baseline(df, value, order_cols, series_cols, ratio, block_rows)
    cells, first, second = [], *list(grid)
    for i, a in enumerate(grid[first]):
        if kind == "ewma":
            blocks = _ewma(blocks, _clamp(a, 0.01, 0.95), f"_e{i}")
        else:
            blocks = _cusum(blocks, _clamp(a, 0.05), f"_{i}")
        for j, b in enumerate(grid[second]):
            if kind == "ewma":
                signal = F.abs(f"_e{i}") > _half_width(_clamp(a, 0.01, 0.95), _clamp(b, 0.1))
            else:
                signal = (F.col(f"c_plus_{i}") > _clamp(b, 0.5)) | (F.col(f"c_minus_{i}") < -_clamp(b, 0.5))
            cells.append((len(cells), float(a), float(b), signal))
    train = blocks.data.filter("_train")
    wide = train.groupBy(*[col(s) for s in series_cols]).agg(
        *[F.avg(sig.cast("double")).alias(f"r{n}") for n, _, _, sig in cells])
    rows = F.array(*[F.struct(F.lit(n).alias("candidate"), F.lit(a).alias(first), F.lit(b).alias(second),
                              F.col(f"r{n}").alias("signal_ratio")) for n, a, b, _ in cells])
    by = [col(s) for s in series_cols]
    table = wide.select(*by, F.explode(rows).alias("c")).select(*by, "c.*")
    table = table.withColumn("score", F.abs(F.col("signal_ratio") - WANTED_SIGNAL_RATIO))
    if not best_only:
        return table
    best = table.groupBy(*by).agg(F.min_by(F.struct(first, second, "signal_ratio", "score"),
                                           F.struct("score", "candidate")).alias("b"))
    return best.select(*by, "b.*")
