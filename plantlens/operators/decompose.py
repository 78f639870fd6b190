"""Decomposition of many series into trend, season and rest by local regression.

A value's parts depend on a bounded stretch around it (`Stl.reach`), so a series is packed into pieces with that stretch at both
sides, once, and a piece goes through all rounds on its own. Only the scale of the robustness weights is a fact of the whole
series: a series of one piece finds it inside its task, for longer ones the two middle residuals are found by counting in
narrowing brackets, and the pieces keep their state from round to round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.functions.columns import as_number, col
from plantlens.functions.lineage import stored
from plantlens.operators.loess import Stl, robust_weights
from plantlens.operators.ordered import join_per_series, lay_out

LEAST_PIECE = 16_384
# Rows that a task joins to their parts.
JOIN_ROWS = 200_000
# Counts of a narrowing step, and steps until a bracket is as narrow as a double.
_BRACKETS, _NARROWINGS = 1_024, 6
PARTS = ("trend", "seasonal", "resid")


def _scale(residual: np.ndarray) -> float:
    """Six medians of the absolute residuals."""
    return 6.0 * float(np.median(np.abs(residual)))


def _pieces(rows: DataFrame, series_cols: Sequence[str], stl: Stl, least: int) -> tuple[DataFrame, int]:
    """start, n, first and xs for every piece: values behind position `start`, with `reach` values around them."""
    size = max(least, 4 * stl.reach)
    own = F.floor((F.col("_pos") - 1) / size)
    into = (F.col("_pos") - 1) % size
    also = F.filter(F.array(own, F.when(into < stl.reach, own - 1), F.when(into >= size - stl.reach, own + 1)), lambda k: k >= 0)
    by = [col(s) for s in series_cols]
    packed = (rows.withColumn("_piece", F.explode(also)).groupBy(*by, "_piece")
              .agg(F.max("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_pos", "_x"))).alias("_v"))
              .filter(F.col("_piece") * size < F.col("n")))
    return packed.select(*by, (F.col("_piece") * size).alias("start"), "n", F.col("_v")[0]["_pos"].alias("first"), F.col("_v._x").alias("xs")), size


def _mapped(data: DataFrame, series_cols: Sequence[str], keep: Sequence[str], columns: str, kernel) -> DataFrame:
    """Rows of a kernel for each piece, with the series columns and `keep` in front."""
    out = T.StructType([*[data.schema[c] for c in (*series_cols, *keep)], *T.StructType.fromDDL(columns).fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([[*(r[c] for c in (*series_cols, *keep)), *found] for r in f.to_dict("records") for found in kernel(r)], columns=out.names)

    return data.mapInPandas(run, out)


def _own(r: dict, size: int) -> slice:
    """The piece's own values in its arrays."""
    return slice(r["start"] + 1 - r["first"], min(r["start"] + size, r["n"]) - r["first"] + 1)


_FOUND = "first_own bigint, trend array<double>, seasonal array<double>, resid array<double>"


def _shown(r: dict, size: int, season: np.ndarray, trend: np.ndarray) -> tuple:
    at = _own(r, size)
    y = np.asarray(r["xs"], float)[at]
    return r["start"] + 1, trend[at], season[at], y - season[at] - trend[at]


def _alone(pieces: DataFrame, series_cols: Sequence[str], stl: Stl, size: int) -> DataFrame:
    """Series of one piece, or without robustness rounds: everything inside a task."""
    def kernel(r):
        y = np.asarray(r["xs"], float)
        given, trend = np.ones(len(y)), np.zeros(len(y))
        for k in range(stl.outer + 1):
            season, trend = stl.rounds(y, given, trend, r["first"], r["n"])
            if k < stl.outer:
                rest = y - season - trend
                given = robust_weights(rest, _scale(rest))
        yield _shown(r, size, season, trend)

    return _mapped(pieces, series_cols, [], _FOUND, kernel)


def _middles(state: DataFrame, series_cols: Sequence[str], size: int) -> DataFrame:
    """scale per series, from the two middle absolute residuals: counts in brackets that narrow around both."""
    def rest(r) -> np.ndarray:
        at = _own(r, size)
        return np.abs(np.asarray(r["xs"], float) - np.asarray(r["seasonal"], float) - np.asarray(r["trend"], float))[at]

    by = [col(s) for s in series_cols]
    tops = _mapped(state, series_cols, ["n"], "top double", lambda r: [(float(rest(r).max()),)])
    level = stored(tops.groupBy(*by).agg(F.max("top").alias("top"), F.max("n").alias("n")).select(
        *by, F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))).alias("rank"), F.lit(0.0).alias("low"),
        F.col("top").alias("width")).withColumn("rank", F.col("rank").cast("bigint")).withColumn("which", F.monotonically_increasing_id()), "middles")
    for _ in range(_NARROWINGS):
        asked = level.groupBy(*by).agg(F.collect_list(F.struct("which", "low", "width")).alias("asked"))

        def count(r):
            values = rest(r)
            for a in r["asked"]:
                # values below the bracket count as well, in a cell of their own
                if a["width"] > 0:
                    cell = np.clip(np.ceil((values - a["low"]) / a["width"] * _BRACKETS), 0, _BRACKETS + 1).astype(np.int64)
                    cells, n = np.unique(cell, return_counts=True)
                    for c, k in zip(cells.tolist(), n.tolist()):
                        yield a["which"], c, k

        counts = (_mapped(join_per_series(state, asked, series_cols), series_cols, [], "of bigint, cell bigint, k bigint", count)
                  .groupBy("of", "cell").agg(F.sum("k").alias("k")).groupBy("of").agg(F.array_sort(F.collect_list(F.struct("cell", "k"))).alias("cells")))
        # a value at place rank is in the first cell whose running count exceeds it; at most a thousand cells
        summed = F.aggregate("cells", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(-1).cast("bigint").alias("cell")), lambda a, x: F.struct(
            (a["seen"] + x["k"]).alias("seen"), F.when(a["cell"] >= 0, a["cell"]).when(a["seen"] + x["k"] > F.col("rank"), x["cell"]).otherwise(-1).cast("bigint").alias("cell")))
        placed = level.join(counts, F.col("which") == F.col("of"), "left").withColumn("cell", summed["cell"])
        inside = F.col("cell").isNotNull() & F.col("cell").between(1, _BRACKETS)
        step = F.col("width") / _BRACKETS
        level = stored(placed.select(*by, "rank", F.when(inside, F.col("low") + (F.col("cell") - 1) * step).otherwise(F.col("low")).alias("low"),
                                     F.when(inside, step).when(F.col("cell") == 0, F.lit(0.0)).otherwise(F.col("width")).alias("width"), "which"), "middles")
    return level.groupBy(*by).agg((6.0 * F.avg(F.col("low") + F.col("width"))).alias("scale"))


def _together(pieces: DataFrame, series_cols: Sequence[str], stl: Stl, size: int) -> DataFrame:
    """Robustness rounds of series of many pieces: a pass for each, the scale between them."""
    keep = ["start", "n", "first", "xs"]
    arrays = "seasonal array<double>, trend array<double>"

    def kernel(r):
        y = np.asarray(r["xs"], float)
        trend = np.zeros(len(y)) if r.get("trend") is None else np.asarray(r["trend"], float)
        given = np.ones(len(y)) if r.get("scale") is None else robust_weights(y - np.asarray(r["seasonal"], float) - trend, r["scale"])
        yield stl.rounds(y, given, trend, r["first"], r["n"])

    state = stored(_mapped(pieces, series_cols, keep, arrays, kernel), "decomposed")
    for _ in range(stl.outer):
        scaled = join_per_series(state, _middles(state, series_cols, size), series_cols)
        state = stored(_mapped(scaled, series_cols, keep, arrays, kernel), "decomposed")
    return _mapped(state, series_cols, [], _FOUND, lambda r: [_shown(r, size, np.asarray(r["seasonal"], float), np.asarray(r["trend"], float))])


def stl_decompose(df: DataFrame, column: str, period: int = 12, seasonal: int | None = None, trend: int | None = None,
                  low_pass: int | None = None, robust: bool = False, *, order_cols: Sequence[str], series_cols: Sequence[str] = (),
                  block_rows: int | None = None, warnings: list[str] | None = None, inner: int | None = None,
                  outer: int | None = None, least_piece: int = LEAST_PIECE) -> DataFrame:
    """`{col}_stl_p{period}_trend`, `_seasonal` and `_resid`, for display: they look ahead, so never model inputs.

    `seasonal`, `trend` and `low_pass` are odd window widths (7; the next odd number from 1.5 period / (1 - 1.5 / seasonal); the one
    above the period). Missing values keep their place out of the series; a series under max(2 x period, 7) values gets nothing.
    """
    stl = Stl.of(int(period), seasonal, trend, low_pass, robust, inner, outer)
    names = [f"{column}_stl_p{stl.period}_{part}" for part in PARTS]
    if column not in df.columns or not df.filter(as_number(column).isNotNull()).limit(1).count():
        if warnings is not None:
            warnings.append(f"decomposition: '{column}' has no numbers, skipped")
        return df
    by = [col(s) for s in series_cols]
    valid = df.withColumn("_x", as_number(column)).filter("_x is not null")
    blocks = lay_out(valid, series_cols, order_cols, block_rows).with_position("_pos")
    sizes = valid.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = blocks.join_series(blocks.data, sizes)
    pieces, size = _pieces(rows.filter(F.col("_n") >= max(2 * stl.period, 7)), series_cols, stl, least_piece)
    pieces = stored(pieces, "pieces")
    if stl.outer and pieces.filter(f"n > {size}").limit(1).count():
        found = _alone(pieces.filter(f"n <= {size}"), series_cols, stl, size).unionByName(_together(pieces.filter(f"n > {size}"), series_cols, stl, size))
    else:
        found = _alone(pieces, series_cols, stl, size)
    # values in a struct are equal where both are missing, so one key will do; both sides in parts of bounded size, as Spark would
    # judge arrays of rows by the size of their files and broadcast them
    n_parts = -(-blocks.n_rows // JOIN_ROWS)
    key = lambda at: F.struct(F.coalesce(at, F.lit(0)).alias("p"), *by)
    each = found.select(*by, "first_own", F.posexplode(F.arrays_zip(*PARTS)).alias("_i", "_f"))
    each = each.select(key(F.col("first_own") + F.col("_i")).alias("_p"),
                       *[F.col(f"_f.{part}").alias(n) for part, n in zip(PARTS, names)])
    placed = rows.withColumn("_at", key(F.col("_pos")))
    if n_parts > 1:
        each, placed = each.repartition(n_parts, "_p"), placed.repartition(n_parts, "_at")
    joined = placed.join(each.hint("merge"), F.col("_at") == F.col("_p"), "left").select(*[col(c) for c in df.columns], *[col(n) for n in names])
    return joined.unionByName(df.filter(as_number(column).isNull()), allowMissingColumns=True)
