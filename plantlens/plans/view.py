"""Filtered and sorted view of a table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from plantlens.operators.filters import drop_missing_rows, filter_rows
from plantlens.operators.paging import sort_rows
from plantlens.operators.selection import Selection, mask_selected


def table_view(df: DataFrame, conditions: Iterable[Sequence] = (), sort: Iterable[Sequence] = (),
               id_col: str = "id") -> DataFrame:
    return sort_rows(filter_rows(df, conditions), sort, id_col)


def analysis_rows(df: DataFrame, sel: Selection | None = None, selected_as_missing: bool = False,
                  drop_missing: bool = False, id_col: str = "id") -> DataFrame:
    """Selected rows read as missing, then rows with missing values dropped, as asked."""
    if selected_as_missing and sel is not None:
        df = mask_selected(df, sel, id_col)
    return drop_missing_rows(df, id_col) if drop_missing else df
