"""Train/test flags of exact size, and scaling by train statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions.columns import as_number, col, fresh, numeric_columns, text_of
from plantlens.operators.compare import MISSING_LEVEL
from plantlens.operators.ordered import join_per_series, lay_out

# Split defaults.
SPLIT_METHODS = ("random", "stratified_random", "sequential")
DEFAULT_RATIO, DEFAULT_SEED = 0.8, 42
# Rows of one radix bucket that may be looked at one by one.
_PICK_ROWS = 10_000


def clamp_ratio(value) -> float:
    try:
        return min(max(float(value), 0.05), 0.95)
    except (TypeError, ValueError):
        return DEFAULT_RATIO


def train_size(n: int, ratio: float) -> int:
    """round-half-even(n x ratio) kept in 1..n-1; a single row is all train."""
    if n <= 1:
        return n
    return min(max(round(n * clamp_ratio(ratio)), 1), n - 1)


def train_size_column(n: Column, ratio: float, least: Column | None = None) -> Column:
    size = F.greatest(F.rint(n * F.lit(clamp_ratio(ratio))).cast("bigint"), F.lit(1) if least is None else least)
    return F.when(n <= 1, n).otherwise(F.least(size, n - 1))


def shuffle_key(id_col: str, seed: int) -> Column:
    """A reproducible random number per id, whatever the partitioning."""
    return F.xxhash64(col(id_col).cast("string"), F.lit(int(seed)))


def rank_threshold(keys: DataFrame, k: int) -> tuple[int, str] | None:
    """The k-th smallest (h, id) of a table with columns h BIGINT, id STRING.

    Radix selection: each pass counts rows by the next 16 bits of h and goes on
    inside the bucket that holds the k-th row, so no sort or shuffle of the rows
    is needed and a pass returns at most 65,536 counts.
    """
    if k < 1:
        return None
    rest, part = k, keys
    for shift in (48, 32, 16, 0):
        bucket = F.shiftright("h", shift)
        counts = part.groupBy(bucket.alias("b")).count().orderBy("b").collect()
        for r in counts:
            if rest <= r["count"]:
                part = part.filter(bucket == F.lit(r["b"]))
                break
            rest -= r["count"]
        if r["count"] <= _PICK_ROWS:
            break
    row = part.orderBy("h", "id").offset(rest - 1).limit(1).first()
    return row["h"], row["id"]


def split_random(df: DataFrame, ratio: float = DEFAULT_RATIO, seed: int = DEFAULT_SEED, id_col: str = "id",
                 flag: str = "is_train") -> DataFrame:
    """Flag exactly train_size rows, chosen by a hash of the id.

    The rows themselves are not moved: two narrow passes find the threshold and
    the flag is a comparison.
    """
    n = df.count()
    k = train_size(n, ratio)
    if k >= n:
        return df.withColumn(flag, F.lit(True))
    h = shuffle_key(id_col, seed)
    cut = rank_threshold(df.select(h.alias("h"), col(id_col).cast("string").alias("id")), k)
    return df.withColumn(flag, (h < cut[0]) | ((h == cut[0]) & (col(id_col).cast("string") <= cut[1])))


def split_stratified(df: DataFrame, by: str | None, ratio: float = DEFAULT_RATIO, seed: int = DEFAULT_SEED,
                     id_col: str = "id", flag: str = "is_train", block_rows: int | None = None,
                     warnings: list[str] | None = None) -> DataFrame:
    """The random split within every level; missing is a level, a level of one row is train."""
    if not by or by not in df.columns:
        if warnings is not None:
            warnings.append("stratified split: no valid column, random split used")
        return split_random(df, ratio, seed, id_col, flag)
    level, h, pos, n = fresh(df, "_level", "_hash", "_pos", "_n")
    work = df.withColumns({level: F.coalesce(text_of(df, by), F.lit(MISSING_LEVEL)), h: shuffle_key(id_col, seed)})
    blocks = lay_out(work, [level], [h, id_col], block_rows).with_position(pos)
    sizes = work.groupBy(level).agg(F.count(F.lit(1)).alias(n))
    out = blocks.join_series(blocks.result(), sizes)
    return out.withColumn(flag, F.col(pos) <= train_size_column(F.col(n), ratio)).drop(level, h, pos, n)


def split_sequential(df: DataFrame, order_cols: Sequence[str], ratio: float = DEFAULT_RATIO,
                     series_cols: Sequence[str] = (), id_col: str = "id", flag: str = "is_train",
                     block_rows: int | None = None, warnings: list[str] | None = None) -> DataFrame:
    """The first part by order is train, in every series.

    A table has no current order, so unknown order columns fall back to the id.
    """
    known = [c for c in order_cols or () if c in df.columns]
    if len(known) < len(order_cols or ()) and warnings is not None:
        warnings.append("sequential split: order column not found, id used")
    order = list(dict.fromkeys([*known, id_col]))
    pos, n = fresh(df, "_pos", "_n")
    blocks = lay_out(df, series_cols, order, block_rows).with_position(pos)
    sizes = df.groupBy(*[col(s) for s in series_cols]).agg(F.count(F.lit(1)).alias(n))
    out = blocks.join_series(blocks.result(), sizes)
    return out.withColumn(flag, F.col(pos) <= train_size_column(F.col(n), ratio)).drop(pos, n)


def split(df: DataFrame, method: str = "random", ratio: float = DEFAULT_RATIO, seed: int = DEFAULT_SEED,
          stratify_col: str | None = None, order_cols: Sequence[str] = (), series_cols: Sequence[str] = (),
          id_col: str = "id", flag: str = "is_train", warnings: list[str] | None = None) -> DataFrame:
    method = str(method or "random").strip().lower()
    if method == "sequential":
        return split_sequential(df, order_cols, ratio, series_cols, id_col, flag, warnings=warnings)
    if method == "stratified_random":
        return split_stratified(df, stratify_col, ratio, seed, id_col, flag, warnings=warnings)
    return split_random(df, ratio, seed, id_col, flag)


def effective_split(method: str, uses_order: bool) -> str:
    """Features that look back in time force the sequential split for models."""
    method = str(method or "random").strip().lower()
    method = method if method in SPLIT_METHODS else "random"
    return "sequential" if uses_order else method


def standardize(df: DataFrame, train: str | Column | None = None, columns: Sequence[str] | None = None,
                id_col: str = "id") -> DataFrame:
    """(x - train mean) / train sd with divisor n; a missing or zero sd counts as 1."""
    columns = list(columns) if columns else numeric_columns(df, [id_col])
    if not columns:
        return df
    cond = F.lit(True) if train is None else col(train) if isinstance(train, str) else train
    aggs = []
    for i, c in enumerate(columns):
        x = F.when(cond, as_number(c))
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    held = fresh(df, "_stats")[0]
    stats = df.agg(*aggs)
    out = df.withColumn(held, stats.select(F.struct(*stats.columns).alias("s")).scalar())
    scaled = {}
    for i, c in enumerate(columns):
        s = F.col(held).getField(f"s{i}")
        scaled[c] = (as_number(c) - F.col(held).getField(f"m{i}")) / F.when(s > 0, s).otherwise(F.lit(1.0))
    return out.withColumns(scaled).drop(held)


def scaling_table(df: DataFrame, train: str | None = None, columns: Sequence[str] | None = None,
                  id_col: str = "id") -> DataFrame:
    """Train mean and sd (divisor n) per column."""
    columns = list(columns) if columns else numeric_columns(df, [id_col])
    cond = F.lit(True) if train is None else col(train)
    aggs = []
    for i, c in enumerate(columns):
        x = F.when(cond, as_number(c))
        aggs += [F.avg(x).alias(f"v{i}__m"), F.stddev_pop(x).alias(f"v{i}__s")]
    from plantlens.functions.columns import unpivot_agg

    return unpivot_agg(df.agg(*aggs), [], columns, [("m", "mean"), ("s", "sd")])


__all__ = ["clamp_ratio", "effective_split", "join_per_series", "rank_threshold", "scaling_table", "split",
           "split_random", "split_sequential", "split_stratified", "standardize", "train_size"]
