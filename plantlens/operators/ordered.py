"""Ordered work without one task per series.

A window over a whole series (or over a whole table without a series) would put
all of its rows in one task. Here the rows are put in a total order
(series, order columns, id) and that order is cut into blocks of bounded size,
whatever the sizes of the series: a small series shares its block with others, a
large one spans many. Windows run per (block, series); what has to cross a block
edge travels as a carry table with at most two rows per block, so broadcasting
it is safe however large the data is.

The block number is a pure expression over the row (a binary search in literal
bounds that were sampled once), so a lost executor recomputes the same blocks and
nothing has to be materialised.
"""

from __future__ import annotations

import datetime as _dt
import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.functions.columns import col, fresh, is_floating, is_time, name

BLOCK_ROWS_CONF = "spark.plantlens.blockRows"
# A chain of windows sorts a block several times in one task; the longest one measured, suggest_ewma, took 1,108 MB.
DEFAULT_BLOCK_ROWS = 400_000
SAMPLES_PER_BLOCK = 20
# Up to so many blocks, or as many as run at a time, each has a task of its own.
OWN_TASKS = 32
# Branches of the generated decision tree.
TREE_LEAVES = 32
# A table keyed by series is broadcast only up to this many series.
SERIES_BROADCAST_LIMIT = 200_000
# exp() of one scan stretch stays within double range; beyond it a term is below 1e-59.
_STRETCH = 138.0

BLK = "_blk"


def block_rows_of(df: DataFrame, block_rows: int | None) -> int:
    if block_rows is None:
        block_rows = int(df.sparkSession.conf.get(BLOCK_ROWS_CONF, str(DEFAULT_BLOCK_ROWS)))
    return max(2, int(block_rows))


def _key_part(df: DataFrame, column: str) -> tuple[Column, str]:
    """A column as a JSON-safe, order-preserving primitive and its DDL type."""
    dtype = df.schema[column].dataType
    c = col(column)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c), "int"
    if is_time(dtype):
        return F.unix_micros(c.cast("timestamp")), "bigint"
    if is_floating(dtype):
        d = c.cast("double")
        return F.when(~F.isnan(d), d), "double"
    if isinstance(dtype, T.DecimalType):
        return c, dtype.simpleString()
    if isinstance(dtype, T.BooleanType):
        return c.cast("int"), "int"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint"), "bigint"
    return c.cast("string"), "string"


def sort_columns(df: DataFrame, order_cols: Sequence[str]) -> list[Column]:
    """Ascending, missing last; NaN counts as missing."""
    out = []
    for c in order_cols:
        if is_floating(df.schema[c].dataType):
            out.append(_key_part(df, c)[0].asc_nulls_last())
        else:
            out.append(col(c).asc_nulls_last())
    return out


# Stand-ins for a missing key part; a flag part before it carries the order.
_EMPTY = {"string": "", "double": 0.0}


def _key_parts(df: DataFrame, series: Sequence[str], order: Sequence[str], gaps: Sequence[bool]) -> list[tuple[Column, str]]:
    """The total order as non-missing primitive columns. A column with missing values
    takes a flag first: missing series come first, missing order values last."""
    parts = []
    for i, c in enumerate([*series, *order]):
        e, t = _key_part(df, c)
        if gaps[i]:
            parts.append(((e.isNotNull() if i < len(series) else e.isNull()).cast("int"), "int"))
            e = F.coalesce(e, F.lit(_EMPTY.get(t, 0)).cast(t))
        parts.append((e, t))
    return parts


def _plain(value):
    if isinstance(value, (_dt.date, _dt.datetime)):
        return value.isoformat()
    return value if isinstance(value, (int, float, str, type(None))) else str(value)


def _sample_bounds(df: DataFrame, parts: Sequence[tuple[Column, str]], n_rows: int, n_blocks: int) -> list[tuple]:
    """First keys of blocks 1.. from a sample whose size depends on n_blocks only."""
    fraction = min(1.0, SAMPLES_PER_BLOCK * n_blocks / n_rows)
    names = [f"k{i}" for i in range(len(parts))]
    sample = df.select(*[e.alias(k) for k, (e, _) in zip(names, parts)])
    if fraction < 1.0:
        sample = sample.sample(fraction, seed=17)
    rows = sample.orderBy(*names).toArrow()
    bounds: list[tuple] = []
    places = sorted({rows.num_rows * i // n_blocks for i in range(1, n_blocks)} - {0}) if rows.num_rows else []
    for found in rows.take(pa.array(places, pa.int64())).to_pylist():
        b = tuple(_plain(found[k]) for k in names)
        if not bounds or bounds[-1] != b:
            bounds.append(b)
    return bounds


def _with_block_number(df: DataFrame, parts: Sequence[tuple[Column, str]], bounds: list[tuple]) -> DataFrame:
    """Add the number of bounds at or below the row's key.

    Up to 31 bounds are a decision tree in generated code. More are searched in halving steps, each a column of its own that
    looks into the literal bounds of its step, so that generated code holds one comparison a step and the key is made once.
    """
    if len(bounds) < TREE_LEAVES:
        return df.withColumn(BLK, _tree(parts, bounds))
    ddl = ",".join(f"k{i}:{t}" for i, (_, t) in enumerate(parts))
    top = len(bounds).bit_length()
    key, *at = fresh(df, "_key", *[f"_at{i}" for i in range(top)])
    out = df.select("*", F.struct(*[e.alias(f"k{i}") for i, (e, _) in enumerate(parts)]).alias(key), F.lit(0).alias(at[0]))
    for i in range(top):
        step = 1 << (top - 1 - i)
        # the bounds that a search can meet at this step
        rows = [{f"k{j}": v for j, v in enumerate(b)} for b in bounds[step - 1::2 * step]]
        table = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")
        here = F.col(at[i])
        reached = F.get(table, F.shiftright(here, top - i)) <= F.col(key)
        found = F.when(reached, here + F.lit(step)).otherwise(here)
        # where the optimizer follows a join key back to a scan it would copy every step twice into the next; it stops at a generator
        out = out.withColumn(at[i + 1], found) if i + 1 < top else out.withColumn(BLK, F.explode(F.array(found)))
    return out.drop(key, *at)


def _tree(parts: Sequence[tuple[Column, str]], bounds: list[tuple]) -> Column:
    """The number of bounds at or below the row's key. Each key column stands in the plan a bounded number of times, so that the
    optimizer can copy the expression into filters without it growing."""
    def reached(bound: tuple) -> Column:
        values = [F.lit(v).cast(t) for v, (_, t) in zip(bound, parts)]
        cond = parts[-1][0] >= values[-1]
        for (e, _), v in reversed(list(zip(parts[:-1], values[:-1]))):
            cond = (e > v) | ((e == v) & cond)
        return cond

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high + 1) // 2
        return F.when(reached(bounds[mid - 1]), tree(mid, high)).otherwise(tree(low, mid - 1))

    return tree(0, len(bounds))


@dataclass(frozen=True)
class Blocks:
    """A DataFrame with its block column and the facts needed to carry across blocks."""

    data: DataFrame
    series: tuple[str, ...]
    order: tuple[str, ...]
    n_blocks: int
    n_series: int
    n_rows: int
    apart: bool = False

    @property
    def keys(self) -> list[str]:
        return [BLK, *self.series]

    def window(self, df: DataFrame | None = None, reverse: bool = False) -> WindowSpec:
        df = self.data if df is None else df
        order = sort_columns(df, self.order)
        if reverse:
            order = [_flip(df, c) for c in self.order]
        return Window.partitionBy(*[col(k) for k in self.keys]).orderBy(*order)

    def running(self, df: DataFrame | None = None) -> WindowSpec:
        return self.window(df).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def with_data(self, df: DataFrame) -> Blocks:
        return replace(self, data=df)

    def in_tasks(self) -> Blocks:
        """Blocks dealt out to tasks in turn. Few blocks, or large ones, have a task each: where they meet by their hashes, or by
        merged partitions, their rows add up. Many small ones share a task up to `blockRows` rows, since a task each costs more
        than their rows."""
        if self.apart or self.n_blocks == 1:
            return self
        together = max(1, block_rows_of(self.data, None) * self.n_blocks // self.n_rows)
        at_once = max(OWN_TASKS, self.data.sparkSession.sparkContext.defaultParallelism)
        n_tasks = max(math.ceil(self.n_blocks / together), min(self.n_blocks, at_once))
        return replace(self, data=self.data.repartitionById(n_tasks, F.col(BLK)), apart=True)

    def carry(self, summary: DataFrame, folds: dict[str, Callable[[WindowSpec], Column]],
              backwards: bool = False) -> DataFrame:
        """Per-block state -> what arrives at each block's edge.

        `summary` has one row per (block, series). Each fold is evaluated over the
        blocks of the same series strictly before (or after) the row's block. Only
        blocks that continue a series get a row: at most one per block.
        """
        part = [col(s) for s in self.series] or [F.lit(0)]
        edge = F.col(BLK).desc() if backwards else F.col(BLK).asc()
        spec = Window.partitionBy(*part).orderBy(edge)
        before = spec.rowsBetween(Window.unboundedPreceding, -1)
        out = summary.select(*[col(k) for k in self.keys],
                             *[fold(before).alias(k) for k, fold in folds.items()],
                             F.lag(F.lit(1)).over(spec).alias("_joined"))
        return out.filter("_joined is not null").drop("_joined")

    def attach(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        """Left join a carry table (bounded by the number of blocks) on (block, series)."""
        values = [c for c in carry.columns if c not in self.keys]
        renamed = carry.select(*[col(k).alias(f"_c_{k}") for k in self.keys], *[col(v) for v in values])
        cond = F.lit(True)
        for k in self.keys:
            cond = cond & df[name(k)].eqNullSafe(renamed[name(f"_c_{k}")])
        return df.join(F.broadcast(renamed), cond, "left").drop(*[f"_c_{k}" for k in self.keys])

    def join_series(self, df: DataFrame, per_series: DataFrame) -> DataFrame:
        """Join one row per series; broadcast only when the number of series allows it."""
        return join_per_series(df, per_series, self.series, self.n_series)

    def with_position(self, out: str = "_pos") -> Blocks:
        """Contiguous 1..n within each series."""
        if self.n_blocks == 1:
            return self.with_data(self.data.withColumn(out, F.row_number().over(self.window()).cast("bigint")))
        placed = self.in_tasks()
        df = placed.data
        counts = df.groupBy(*[col(k) for k in self.keys]).agg(F.count(F.lit(1)).alias("_n"))
        off = self.carry(counts, {"_off": lambda w: F.sum("_n").over(w)})
        df = df.withColumn(out, F.row_number().over(self.window()).cast("bigint"))
        df = self.attach(df, off)
        return placed.with_data(df.withColumn(out, col(out) + F.coalesce(F.col("_off"), F.lit(0))).drop("_off"))

    def with_halo(self, before: int, after: int, columns: Sequence[str]) -> Blocks:
        """Copy the rows a frame can reach over a block edge into that block, marked `_halo`.

        At most (before + after) rows per block edge are copied; only `columns`
        travel with them.
        """
        df = self.data.withColumn("_halo", F.lit(False))
        if self.n_blocks == 1 or (before <= 0 and after <= 0):
            return self.with_data(df)
        keep = list(dict.fromkeys([*self.series, *self.order, *columns]))
        narrow = self.with_data(self.data.select(BLK, *[col(c) for c in keep])).with_position("_pos")
        counts = self.data.groupBy(*[col(k) for k in self.keys]).agg(F.count(F.lit(1)).alias("_n"))
        part = [col(s) for s in self.series] or [F.lit(0)]
        spec = Window.partitionBy(*part).orderBy(BLK)
        whole = Window.partitionBy(*part).orderBy(BLK).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)
        upto = spec.rowsBetween(Window.unboundedPreceding, 0)
        extents = (counts.select(*[col(k) for k in self.keys],
                                 (F.sum("_n").over(upto) - F.col("_n") + 1).alias("_first"),
                                 F.sum("_n").over(upto).alias("_last"),
                                 F.count(F.lit(1)).over(whole).alias("_spans"))
                   .filter("_spans > 1").drop("_spans"))
        edge_rows = (self.attach(narrow.data, extents)
                     .filter((F.col("_pos") - F.col("_first") < F.lit(after))
                             | (F.col("_last") - F.col("_pos") < F.lit(before)))
                     .drop("_first", "_last", BLK))
        target = extents.select(*[col(s).alias(f"_t_{s}") for s in self.series], F.col(BLK), "_first", "_last")

        def reached(width: int, low: Column, high: Column) -> DataFrame:
            """Rows at positions low..high, no more than `width`, of each block's series. Positions are cut into cells as wide as
            that, so that a block asks for two cells at most and the join has equal keys."""
            asked = target.withColumn("_cell", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
            cond = (F.floor(F.col("_pos") / width) == F.col("_cell")) & F.col("_pos").between(low, high)
            for s in self.series:
                cond = cond & edge_rows[name(s)].eqNullSafe(asked[name(f"_t_{s}")])
            return edge_rows.join(asked, cond).drop("_cell", "_first", "_last", "_pos", *[f"_t_{s}" for s in self.series])

        sides = []
        if before > 0:
            sides.append(reached(before, F.col("_first") - before, F.col("_first") - 1))
        if after > 0:
            sides.append(reached(after, F.col("_last") + 1, F.col("_last") + after))
        halo = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
        halo = halo.withColumn("_halo", F.lit(True))
        return replace(self, data=df.unionByName(halo, allowMissingColumns=True), apart=False)

    def without_halo(self) -> Blocks:
        return self.with_data(self.data.filter(~F.col("_halo")).drop("_halo"))

    def result(self) -> DataFrame:
        return self.data.drop(BLK)


def join_per_series(df: DataFrame, per_series: DataFrame, series: Sequence[str],
                    n_series: int | None = None) -> DataFrame:
    """Left join a table with one row per series (NULL is a series of its own).

    Without series columns the single row comes in as a scalar subquery. The table
    is broadcast only when a count of the series allows it.
    """
    values = [c for c in per_series.columns if c not in series]
    if not series:
        row = per_series.select(F.struct(*[col(v) for v in values]).alias("s")).scalar()
        held = fresh(df, "_one")[0]
        return (df.withColumn(held, row)
                .withColumns({v: F.col(held).getField(v) for v in values}).drop(held))
    if n_series is None:
        n_series = df.agg(F.approx_count_distinct(F.struct(*[col(s) for s in series]))).first()[0]
    renamed = per_series.select(*[col(s).alias(f"_s_{s}") for s in series], *[col(v) for v in values])
    cond = F.lit(True)
    for s in series:
        cond = cond & df[name(s)].eqNullSafe(renamed[name(f"_s_{s}")])
    side = F.broadcast(renamed) if n_series <= SERIES_BROADCAST_LIMIT else renamed
    return df.join(side, cond, "left").drop(*[f"_s_{s}" for s in series])


def _flip(df: DataFrame, column: str) -> Column:
    e = _key_part(df, column)[0] if is_floating(df.schema[column].dataType) else col(column)
    return e.desc_nulls_first()


def lay_out(df: DataFrame, series_cols: Sequence[str], order_cols: Sequence[str],
            block_rows: int | None = None) -> Blocks:
    """Cut (series, order) into blocks. The order columns should end in an id.

    Up to one block of rows the layout is a single block and costs one count.
    """
    series, order = tuple(series_cols or ()), tuple(order_cols)
    if not order:
        raise ValueError("an order column is needed")
    missing = [c for c in (*series, *order) if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    limit = block_rows_of(df, block_rows)
    n_series_expr = F.approx_count_distinct(F.struct(*[col(s) for s in series])) if series else F.lit(1)
    present = [F.count(_key_part(df, c)[0]).alias(f"c{i}") for i, c in enumerate([*series, *order])]
    facts = df.agg(F.count(F.lit(1)).alias("n"), n_series_expr.alias("s"), *present).first()
    n_rows, n_series = int(facts["n"]), int(facts["s"] or 0)
    if n_rows <= limit:
        return Blocks(df.withColumn(BLK, F.lit(0)), series, order, 1, n_series, n_rows)
    gaps = [facts[f"c{i}"] < n_rows for i in range(len(present))]
    parts = _key_parts(df, series, order, gaps)
    bounds = _sample_bounds(df, parts, n_rows, math.ceil(n_rows / limit))
    return Blocks(_with_block_number(df, parts, bounds), series, order, len(bounds) + 1, n_series, n_rows)


def number_rows(df: DataFrame, order_cols: Sequence[str], out: str,
                series_cols: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """Contiguous numbers 1..n (per series) in the given order."""
    return lay_out(df, series_cols, order_cols, block_rows).with_position(out).result()


def affine_scan(blocks: Blocks, rate: Column, add: Column, out: str) -> Blocks:
    """Solve e_i = exp(-rate_i) * e_(i-1) + add_i per series, with e_0 = 0.

    A row's weight is held relative to the start of its stretch of total decay
    138, so that nothing overflows; what lies two stretches back weighs less than
    1e-59 and is dropped. Blocks are linked through their own scan.
    """
    blocks = blocks.in_tasks()
    df, scratch = _local_scan(blocks.data, blocks.keys, sort_columns(blocks.data, blocks.order), rate, add, out)
    total = F.col(scratch[0]) + F.col(scratch[1])
    if blocks.n_blocks > 1:
        ends = df.groupBy(*[col(k) for k in blocks.keys]).agg(
            F.max(total).alias("_rate"), F.max_by(col(out), scratch[2]).alias("_add"))
        linked, _ = _local_scan(ends, blocks.series, [F.col(BLK).asc()], F.col("_rate"), F.col("_add"), "_e")
        carry = blocks.carry(linked.select(*[col(k) for k in blocks.keys], "_e"),
                             {"_ein": lambda w: F.last("_e").over(w)})
        df = blocks.attach(df, carry)
        df = df.withColumn(out, col(out) + F.coalesce(F.exp(-total) * F.col("_ein"), F.lit(0.0))).drop("_ein")
    return blocks.with_data(df.drop(*scratch))


def _local_scan(df: DataFrame, part: Sequence[str], order: Sequence[Column], rate: Column, add: Column,
                out: str) -> tuple[DataFrame, tuple[str, str, str]]:
    """The scan inside one partition key, plus scratch columns: decay so far (two parts), row number.

    The decay is summed in two parts, a multiple of 2^-20 that adds up exactly and
    a small rest, so that a long block loses no precision.
    """
    coarse, fine, idx, sub, b, end = fresh(df, "_coarse", "_fine", "_idx", "_sub", "_b", "_end")
    keys = [col(k) for k in part] or [F.lit(0)]
    w = Window.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    grid = float(1 << 20)
    whole = F.floor(rate * grid).cast("double") / grid
    df = df.withColumns({coarse: F.sum(whole).over(run), fine: F.sum(rate - whole).over(run),
                         idx: F.row_number().over(w), b: add})
    df = df.withColumn(sub, F.floor(F.col(coarse) / _STRETCH).cast("bigint"))
    shift = (F.col(coarse) - F.col(sub) * _STRETCH) + F.col(fine)
    inner = Window.partitionBy(*keys, F.col(sub)).orderBy(F.col(idx)).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(out, F.exp(-shift) * F.sum(F.col(b) * F.exp(shift)).over(inner))
    prior = Window.partitionBy(*keys).orderBy(F.col(sub)).rangeBetween(Window.unboundedPreceding, -1)
    state = F.struct(F.col(coarse).alias("c"), F.col(fine).alias("f"), col(out).alias("e"))
    df = df.withColumn(end, F.max_by(state, F.col(idx)).over(prior))
    passed = (F.col(end)["c"] - F.col(coarse)) + (F.col(end)["f"] - F.col(fine))
    df = df.withColumn(out, col(out) + F.coalesce(F.exp(passed) * F.col(end)["e"], F.lit(0.0)))
    return df.drop(end, sub, b), (coarse, fine, idx)
