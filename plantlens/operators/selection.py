"""Selections: a one-column DataFrame of ids, or a Boolean Column over the table.

An id selection may be as large as the table. It is counted up to a limit first:
up to that many ids are broadcast, so the table is not moved; beyond it the join
is left to Spark, which shuffles both sides on the (unique) id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions.columns import col, fresh, name

Selection = DataFrame | Column
ID_BROADCAST_LIMIT = 1_000_000


def sized(ids: DataFrame, limit: int = ID_BROADCAST_LIMIT) -> DataFrame:
    """Mark a table of ids for broadcasting if it has at most `limit` rows."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


def ids_of(sel: DataFrame, id_col: str = "id") -> DataFrame:
    """Distinct ids as text."""
    source = id_col if id_col in sel.columns else sel.columns[0]
    return sel.select(col(source).cast("string").alias(id_col)).filter(col(id_col).isNotNull()).distinct()


def select_all(view: DataFrame, id_col: str = "id") -> DataFrame:
    return view.select(col(id_col).cast("string").alias(id_col))


def select_clear(sel: DataFrame, id_col: str = "id") -> DataFrame:
    return ids_of(sel, id_col).filter(F.lit(False))


def select_replace(sel: DataFrame, picked: DataFrame, id_col: str = "id") -> DataFrame:
    return ids_of(picked, id_col)


def select_add(sel: DataFrame, picked: DataFrame, id_col: str = "id") -> DataFrame:
    """Current and picked ids, each once."""
    source = id_col if id_col in sel.columns else sel.columns[0]
    other = id_col if id_col in picked.columns else picked.columns[0]
    return ids_of(sel.select(col(source).cast("string").alias(id_col))
                  .union(picked.select(col(other).cast("string").alias(id_col))), id_col)


def select_on_page(current: DataFrame, page_rows: DataFrame, picked: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids off the page stay; of the page, only the picked ones."""
    off_page = ids_of(current, id_col).join(sized(ids_of(page_rows, id_col)), id_col, "left_anti")
    return select_add(off_page, picked, id_col)


def in_range(ranges: Mapping[str, tuple]) -> Column:
    """Condition that every named column lies in its closed range; None leaves a side open."""
    cond = F.lit(True)
    for column, (lo, hi) in ranges.items():
        if lo is not None:
            cond = cond & (col(column) >= F.lit(lo))
        if hi is not None:
            cond = cond & (col(column) <= F.lit(hi))
    return cond


def select_range(df: DataFrame, ranges: Mapping[str, tuple], id_col: str = "id") -> DataFrame:
    return df.filter(in_range(ranges)).select(col(id_col).cast("string").alias(id_col))


def flag_selected(df: DataFrame, sel: Selection | None, id_col: str = "id", flag: str = "selected") -> DataFrame:
    """Add a Boolean column; ids that are not in the table are ignored."""
    if sel is None:
        return df.withColumn(flag, F.lit(False))
    if isinstance(sel, Column):
        return df.withColumn(flag, F.coalesce(sel, F.lit(False)))
    key, mark = fresh(df, "_sel_id", "_sel_mark")
    picked = ids_of(sel, id_col).select(col(id_col).alias(key), F.lit(True).alias(mark))
    return (df.join(sized(picked), df[name(id_col)].cast("string") == picked[key], "left")
            .withColumn(flag, F.coalesce(F.col(mark), F.lit(False))).drop(key, mark))


def mask_selected(df: DataFrame, sel: Selection, id_col: str = "id") -> DataFrame:
    """Set everything but the id to missing in the selected rows."""
    flag = fresh(df, "_masked")[0]
    out = flag_selected(df, sel, id_col, flag)
    return out.withColumns({c: F.when(~F.col(flag), col(c)) for c in df.columns if c != id_col}).drop(flag)
