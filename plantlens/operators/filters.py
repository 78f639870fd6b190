"""Row predicates."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions.columns import as_number, col, is_numeric, is_time, text_of
from plantlens.operators.identity import DataError

# The comparison operators.
COMPARISONS = ("eq", "ne", "lt", "le", "gt", "ge")
TEXT_TESTS = ("contains", "datestartswith")


def _compare(left: Column, op: str, right: Column) -> Column:
    if op == "eq":
        return left == right
    if op == "ne":
        return ~left.eqNullSafe(right)
    if op == "lt":
        return left < right
    if op == "le":
        return left <= right
    if op == "gt":
        return left > right
    return left >= right


def predicate(df: DataFrame, column: str, op: str, value) -> Column | None:
    """One condition, or None where the column or operator is unknown.

    The value is read in the type of the column; one that cannot be read selects
    nothing. Missing values pass only `ne`.
    """
    if column not in df.columns:
        return None
    if op == "contains":
        return F.contains(F.lower(text_of(df, column)), F.lower(F.lit(str(value))))
    if op == "datestartswith":
        return F.startswith(text_of(df, column), F.lit(str(value)))
    if op not in COMPARISONS:
        return None
    dtype = df.schema[column].dataType
    if is_time(dtype):
        parsed = F.lit(value).try_cast(dtype)
        wanted = _compare(col(column), op, parsed)
        return wanted & parsed.isNotNull() if op == "ne" else wanted
    if is_numeric(dtype):
        try:
            number = float(value)
        except (TypeError, ValueError):
            return F.lit(False)
        if math.isnan(number):
            return F.lit(False)
        literal = int(number) if number.is_integer() and abs(number) < 2**53 else number
        return _compare(col(column), op, F.lit(literal))
    return _compare(text_of(df, column), op, F.lit(str(value)))


def filter_rows(df: DataFrame, conditions: Iterable[Sequence]) -> DataFrame:
    """Conditions (column, operator, value) joined by AND."""
    for column, op, value in conditions or ():
        p = predicate(df, column, op, value)
        if p is not None:
            df = df.filter(p)
    return df


def drop_missing_rows(df: DataFrame, id_col: str = "id") -> DataFrame:
    subset = [c for c in df.columns if c != id_col]
    for c in subset:
        df = df.filter(col(c).isNotNull())
    return df


def require_target(df: DataFrame, target: str, task: str = "regression") -> DataFrame:
    """Keep rows that have a usable target: a number, or any label for classes."""
    if target not in df.columns:
        raise DataError(f"unknown target column: {target}")
    if task == "classification":
        return df.filter(col(target).isNotNull())
    return df.filter(as_number(target).isNotNull())


def require_any_feature(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Drop rows whose features are all missing."""
    if not features:
        raise DataError("no feature columns")
    return df.filter(F.coalesce(*[col(f).cast("string") for f in features]).isNotNull())


# The least number of rows per task.
MINIMUM_ROWS = {"regression": 5, "classification": 5, "unsupervised": 3, "timeseries": 6}


def require_rows(df: DataFrame, task: str) -> DataFrame:
    least = MINIMUM_ROWS[task]
    if df.limit(least).count() < least:
        raise DataError(f"{task} needs at least {least} usable rows")
    return df
