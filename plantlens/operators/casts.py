"""Per-column type overrides; values that do not fit become missing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions.columns import as_number, col, is_time, micros

# The kinds a column can be cast to.
CAST_KINDS = ("auto", "float", "int", "string", "category", "datetime")


def whole_number(column: Column) -> Column:
    """BIGINT where the value is close to whole, otherwise missing."""
    d = as_number(column)
    return F.when(F.abs(d - F.rint(d)) <= 1e-8, F.rint(d)).try_cast("bigint")


def to_timestamp(column: Column) -> Column:
    return column.try_cast("timestamp")


def apply_types(df: DataFrame, overrides: Mapping[str, str], id_col: str = "id") -> DataFrame:
    """Cast columns by kind. Unknown columns and kinds are ignored, `auto` leaves a column alone."""
    out = {}
    for column, kind in (overrides or {}).items():
        kind = str(kind or "auto").lower()
        if column == id_col or column not in df.columns or kind not in CAST_KINDS or kind == "auto":
            continue
        c = col(column)
        if kind == "float":
            out[column] = as_number(c)
        elif kind == "int":
            out[column] = whole_number(c)
        elif kind in ("string", "category"):
            out[column] = c.cast("string")
        else:
            out[column] = c if is_time(df.schema[column].dataType) else to_timestamp(c)
    return df.withColumns(out) if out else df


__all__ = ["CAST_KINDS", "apply_types", "micros", "to_timestamp", "whole_number"]
