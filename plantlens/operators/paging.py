"""Sorting and paging."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.functions.columns import col, fresh, is_floating
from plantlens.operators.ordered import lay_out

# Page size default and bounds.
DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE = 200, 1000
# A page that ends later than this is found by row number instead of a top-k.
DEEP_PAGE_ROWS = 100_000


def page_size(value) -> int:
    try:
        size = int(value)
    except (TypeError, ValueError):
        size = DEFAULT_PAGE_SIZE
    return max(1, min(size, MAX_PAGE_SIZE))


def page_index(value) -> int:
    try:
        return max(int(value), 0)
    except (TypeError, ValueError):
        return 0


def sort_keys(df: DataFrame, sort: Iterable[Sequence], id_col: str = "id") -> list[Column]:
    """Keys with missing last in both directions, closed by the id; unknown columns are dropped."""
    keys, used = [], set()
    for column, direction in sort or ():
        if column not in df.columns:
            continue
        c = col(column)
        if is_floating(df.schema[column].dataType):
            c = F.when(~F.isnan(c), c)
        keys.append(c.desc_nulls_last() if str(direction) == "desc" else c.asc_nulls_last())
        used.add(column)
    if id_col in df.columns and id_col not in used:
        keys.append(col(id_col).asc_nulls_last())
    return keys


def sort_rows(df: DataFrame, sort: Iterable[Sequence], id_col: str = "id") -> DataFrame:
    keys = sort_keys(df, sort, id_col)
    return df.orderBy(*keys) if keys else df


def page(df: DataFrame, current=0, size=DEFAULT_PAGE_SIZE, sort: Iterable[Sequence] = (), id_col: str = "id",
         deep_rows: int = DEEP_PAGE_ROWS, block_rows: int | None = None) -> DataFrame:
    """One page of the sorted table.

    Near pages are a top-k, planned without a full sort. A deep page would make
    every task keep all rows up to it, so beyond `deep_rows` the rows are numbered
    block by block and only the page's numbers are kept. A table without an id has
    no unique order to number by and keeps the top-k.
    """
    size, current = page_size(size), page_index(current)
    start = current * size
    ordered = sort_rows(df, sort, id_col)
    if start + size <= deep_rows or id_col not in df.columns:
        return ordered.offset(start).limit(size) if start else ordered.limit(size)
    names = []
    work = df
    for i, (column, direction) in enumerate([(c, d) for c, d in sort or () if c in df.columns]):
        key = fresh(work, f"_sort{i}")[0]
        work = work.withColumn(key, _ascending(work, column, str(direction) == "desc"))
        names.append(key)
    pos = fresh(work, "_pos")[0]
    numbered = lay_out(work, (), [*names, id_col], block_rows).with_position(pos).result()
    picked = numbered.filter(F.col(pos).between(start + 1, start + size))
    return picked.orderBy(pos).drop(pos, *names)


def _ascending(df: DataFrame, column: str, descending: bool) -> Column:
    """A key whose ascending order, missing last, is the wanted order."""
    from plantlens.functions.columns import is_numeric, is_time, micros

    c, dtype = col(column), df.schema[column].dataType
    if not descending:
        return c
    if is_time(dtype):
        return F.bitwise_not(micros(c))
    if isinstance(dtype, T.IntegralType):
        # the complement turns the order round and, unlike the negative, exists for the smallest number
        return F.bitwise_not(c)
    if is_numeric(dtype):
        return -c
    # text: complement of the UTF-8 bytes, closed by a mark above all of them
    hexed = F.hex(F.encode(c.cast("string"), "UTF-8"))
    return F.when(c.isNotNull(), F.concat(F.translate(hexed, "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G")))


def page_count(df: DataFrame, size=DEFAULT_PAGE_SIZE) -> DataFrame:
    """One row: rows and pages."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.ceil(F.count(F.lit(1)) / page_size(size)).cast("bigint").alias("pages"))


def pages_of(rows: int, size=DEFAULT_PAGE_SIZE) -> int:
    return math.ceil(rows / page_size(size)) if rows else 0


def top_n(df: DataFrame, sort: Iterable[Sequence], n: int, id_col: str = "id") -> DataFrame:
    return sort_rows(df, sort, id_col).limit(n)
