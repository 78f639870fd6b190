"""Feature columns: lags, expressions, moving and exponential averages, seasonal parts."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions.columns import as_number, col, fresh, is_floating
from plantlens.operators.ordered import affine_scan, lay_out


def add_lags(df: DataFrame, lags: Mapping[str, Sequence[int]], order_cols: Sequence[str],
             series_cols: Sequence[str] = (), block_rows: int | None = None,
             warnings: list[str] | None = None) -> DataFrame:
    """`{col}_lag{k}` for k >= 1; a lag that looks ahead is refused because it leaks the future."""
    wanted = []
    for column, ks in (lags or {}).items():
        for k in dict.fromkeys(int(k) for k in ks):
            if column not in df.columns:
                _warn(warnings, f"lag: unknown column '{column}'")
            elif k < 1:
                _warn(warnings, f"lag {k} of '{column}' refused: only past values may be used")
            else:
                wanted.append((column, k))
    if not wanted:
        return df
    blocks = lay_out(df, series_cols, order_cols, block_rows)
    blocks = blocks.with_halo(max(k for _, k in wanted), 0, [c for c, _ in wanted])
    w = blocks.window()
    data = blocks.data.withColumns({f"{c}_lag{k}": F.lag(col(c), k).over(w) for c, k in wanted})
    return blocks.with_data(data).without_halo().result()


def _warn(warnings: list[str] | None, text: str) -> None:
    if warnings is not None:
        warnings.append(text)


def add_features(df: DataFrame, features: Iterable[tuple[str, str | Column]],
                 warnings: list[str] | None = None) -> DataFrame:
    """Computed columns by Spark SQL text or Column; later ones see earlier ones.

    A repeated name keeps the last definition. Text is resolved without ANSI errors,
    so division by zero and values that cannot be read give missing, as do
    logarithms of non-positive numbers. A definition that does not resolve, or that
    is not a plain row expression, is skipped with a warning.
    """
    last: dict[str, str | Column] = {}
    for key, expr in features or ():
        last.pop(key, None)
        last[key] = expr
    for key, expr in last.items():
        try:
            if isinstance(expr, str):
                with _lenient(df):
                    trial = df.withColumn(key, F.expr(_row_expression(df, expr)))
            else:
                trial = df.withColumn(key, expr)
            dtype = trial.schema[key].dataType
            if is_floating(dtype):
                value = F.when(~F.isnan(col(key)), col(key))
                trial = trial.withColumn(key, value)
        except (AnalysisException, ParseException, ValueError) as exc:
            _warn(warnings, f"feature '{key}' skipped: {str(exc).splitlines()[0]}")
            continue
        df = trial
    return df


@contextmanager
def _lenient(df: DataFrame):
    """Arithmetic resolved in here gives NULL instead of raising; the choice stays in the plan."""
    conf, key = df.sparkSession.conf, "spark.sql.ansi.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        yield
    finally:
        conf.set(key, before)


# What a feature may be made of: nodes of Spark's parsed expressions, and functions of one row.
_NODES = set("""UnresolvedAttribute Literal UnresolvedFunction UnresolvedAlias Add Subtract Multiply Divide IntegralDivide Remainder
UnaryMinus UnaryPositive Abs EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual And Or Not CaseWhen If
IsNull IsNotNull Cast In Like RLike Between Alias""".split())
_FUNCTIONS = set("""abs acos asin atan atan2 between bround cast cbrt ceil ceiling char_length coalesce concat concat_ws cos cosh cot datediff
date_add date_sub date_trunc day dayofmonth dayofweek dayofyear degrees double exp expm1 float floor greatest hour hypot if ifnull
int isnan isnotnull isnull least length ln log log10 log1p log2 lower ltrim minute mod month nanvl nullif nvl pmod pow power
quarter radians rint round rtrim second sign signum sin sinh sqrt string substr substring tan tanh timestampdiff to_date
to_timestamp trim trunc try_add try_cast try_divide try_multiply try_subtract unix_timestamp upper weekofyear when year + - * / % < > = <= >=
!= <> == <=> and or not like rlike case bigint div negative positive""".split())


def _row_expression(df: DataFrame, text: str) -> str:
    """Refuse everything but columns, literals and functions of one row, as Spark's parser sees them."""
    waiting = [df.sparkSession._jsparkSession.sessionState().sqlParser().parseExpression(text)]
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        if kind not in _NODES:
            raise ValueError(f"only row expressions are allowed, not {kind}")
        if kind == "UnresolvedFunction":
            name = node.nameParts().mkString(".").lower()
            if name not in _FUNCTIONS:
                raise ValueError(f"function {name} is not allowed")
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return text


def ratio(top: str, bottom: str) -> Column:
    """top / bottom, missing where undefined."""
    return F.try_divide(as_number(top), as_number(bottom))


def _has_numbers(df: DataFrame, columns: Sequence[str]) -> dict[str, bool]:
    row = df.agg(*[F.count(as_number(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"n{i}"] > 0 for i, c in enumerate(columns)}


def add_sma(df: DataFrame, column: str, window: int = 3, min_periods: int = 1, center: bool = False, *,
            order_cols: Sequence[str], series_cols: Sequence[str] = (), block_rows: int | None = None,
            warnings: list[str] | None = None) -> DataFrame:
    """`{col}_sma{w}`: mean over the last (or centred) w rows, missing until min_periods values are there."""
    window, min_periods = int(window), int(min_periods)
    if window < 1 or min_periods < 1:
        raise ValueError("window and min_periods must be at least 1")
    if column not in df.columns or not _has_numbers(df, [column])[column]:
        _warn(warnings, f"moving average: '{column}' has no numbers, skipped")
        return df
    before, after = (window // 2, (window - 1) // 2) if center else (window - 1, 0)
    blocks = lay_out(df, series_cols, order_cols, block_rows).with_halo(before, after, [column])
    frame = blocks.window().rowsBetween(-before, after)
    x = as_number(column)
    data = blocks.data.withColumn(f"{column}_sma{window}",
                                  F.when(F.count(x).over(frame) >= min_periods, F.avg(x).over(frame)))
    return blocks.with_data(data).without_halo().result()


def add_ema(df: DataFrame, column: str, span: int = 5, min_periods: int = 1, adjust: bool = False, *,
            order_cols: Sequence[str], series_cols: Sequence[str] = (), block_rows: int | None = None,
            warnings: list[str] | None = None) -> DataFrame:
    """`{col}_ema{s}` with weight 2/(span+1); a gap keeps the last value while its weight decays."""
    span = int(span)
    if span < 1:
        raise ValueError("span must be at least 1")
    if column not in df.columns or not _has_numbers(df, [column])[column]:
        _warn(warnings, f"exponential average: '{column}' has no numbers, skipped")
        return df
    out = f"{column}_ema{span}"
    blocks = lay_out(df, series_cols, order_cols, block_rows)
    x_name, pos, seen, last = fresh(blocks.data, "_x", "_pos", "_seen", "_last")
    blocks = blocks.with_data(blocks.data.withColumn(x_name, as_number(column))).with_position(pos)
    x, here = F.col(x_name), F.col(x_name).isNotNull()
    # values seen so far and the position of the one before this row
    run = blocks.running()
    prior = blocks.window().rowsBetween(Window.unboundedPreceding, -1)
    data = blocks.data.withColumns({seen: F.count(x).over(run),
                                    last: F.max(F.when(here, F.col(pos))).over(prior)})
    if blocks.n_blocks > 1:
        summary = blocks.data.groupBy(*[col(k) for k in blocks.keys]).agg(
            F.count(x).alias("_n"), F.max(F.when(here, F.col(pos))).alias("_p"))
        carry = blocks.carry(summary, {"_n0": lambda w: F.sum("_n").over(w), "_p0": lambda w: F.max("_p").over(w)})
        data = blocks.attach(data, carry)
        data = data.withColumns({seen: F.col(seen) + F.coalesce("_n0", F.lit(0)),
                                 last: F.coalesce(F.col(last), F.col("_p0"))}).drop("_n0", "_p0")
    blocks = blocks.with_data(data)
    alpha = 2.0 / (span + 1.0)
    keep = 1.0 - alpha
    first = here & F.col(last).isNull()
    if adjust:
        # both parts share their decay, so missing rows leave the ratio alone and the
        # whole gap is charged to the next value
        per_row = -math.log(keep) if keep > 0 else 745.0
        rate = F.when(here & ~first, (F.col(pos) - F.col(last)) * F.lit(per_row)).otherwise(F.lit(0.0))
        num, den = fresh(blocks.data, "_num", "_den")
        blocks = affine_scan(blocks, rate, F.coalesce(x, F.lit(0.0)), num)
        blocks = affine_scan(blocks, rate, here.cast("double"), den)
        value = F.try_divide(F.col(num), F.col(den))
        data = blocks.data.withColumn(out, value).drop(num, den)
    else:
        gap = (F.col(pos) - F.col(last)).cast("double")
        weight = F.pow(F.lit(keep), gap)
        rate = (F.when(~here | first, F.lit(0.0))
                .otherwise(F.least(-(gap * math.log(keep) if keep > 0 else F.lit(-745.0)) + F.log(weight + alpha),
                                   F.lit(1e6))))
        add = F.when(first, x).when(here, x * alpha / (weight + alpha)).otherwise(F.lit(0.0))
        blocks = affine_scan(blocks, rate, add, out)
        data = blocks.data
    data = data.withColumn(out, F.when(F.col(seen) >= max(1, int(min_periods)), col(out)))
    return blocks.with_data(data.drop(x_name, pos, seen, last)).result()


def seasonal_decompose(df: DataFrame, column: str, period: int = 12, *, order_cols: Sequence[str],
                       series_cols: Sequence[str] = (), block_rows: int | None = None,
                       warnings: list[str] | None = None) -> DataFrame:
    """Trend, seasonal and residual parts, for display: they look ahead, so never model inputs.

    Trend is the centred moving average (2 x m for an even period), the seasonal
    part the mean deviation per phase, centred to zero. Missing values keep their
    place out of the series; a series under max(2 x period, 7) values gets nothing.
    """
    period = int(period)
    if period < 2:
        raise ValueError("period must be at least 2")
    names = [f"{column}_season_p{period}_{part}" for part in ("trend", "seasonal", "resid")]
    if column not in df.columns or not _has_numbers(df, [column])[column]:
        _warn(warnings, f"decomposition: '{column}' has no numbers, skipped")
        return df
    x_name = fresh(df, "_x")[0]
    held = df.withColumn(x_name, as_number(column))
    valid = held.filter(F.col(x_name).isNotNull())
    keep = list(dict.fromkeys([*series_cols, *order_cols]))
    blocks = lay_out(valid, series_cols, order_cols, block_rows).with_position("_pos")
    half = period // 2
    blocks = blocks.with_halo(half, half, [x_name, "_pos"])
    w = blocks.window()
    x = F.col(x_name)
    if period % 2:
        frame = w.rowsBetween(-half, half)
        full, mean = F.count(x).over(frame) == period, F.avg(x).over(frame)
    else:
        frame, inner = w.rowsBetween(-half, half), w.rowsBetween(-half + 1, half - 1)
        full = F.count(x).over(frame) == period + 1
        mean = (F.sum(x).over(inner) + 0.5 * (F.lag(x, half).over(w) + F.lead(x, half).over(w))) / float(period)
    blocks = blocks.with_data(blocks.data.withColumn("_trend", F.when(full, mean))).without_halo()
    data = blocks.data.withColumns({"_phase": F.pmod(F.col("_pos") - 1, F.lit(period)), "_dev": x - F.col("_trend")})
    by = [col(s) for s in series_cols]
    phases = data.groupBy(*by, "_phase").agg(F.avg("_dev").alias("_m"), F.count(F.lit(1)).alias("_n"))
    per_series = (phases.groupBy(*by).agg(F.avg("_m").alias("_mean"), F.sum("_n").alias("_n"),
                                          F.map_from_entries(F.collect_list(F.struct("_phase", "_m"))).alias("_map")))
    joined = blocks.with_data(data).join_series(data, per_series)
    enough = F.col("_n") >= max(2 * period, 7)
    seasonal = F.when(enough, F.col("_map")[F.col("_phase")] - F.col("_mean"))
    trend = F.when(enough, F.col("_trend"))
    parts = [trend, seasonal, x - trend - seasonal]
    extra = joined.select(*[c for c in joined.columns if c in df.columns],
                          *[p.alias(n) for p, n in zip(parts, names)])
    gaps = df.filter(as_number(column).isNull())
    return extra.unionByName(gaps, allowMissingColumns=True) if keep else extra
