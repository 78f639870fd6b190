"""Column-level helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOAT_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
_TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def name(col: str) -> str:
    """Quote a column name for use inside F.col / SQL text."""
    return "`" + col.replace("`", "``") + "`"


def col(column: str) -> Column:
    return F.col(name(column))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INT_TYPES + _FLOAT_TYPES)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, _TIME_TYPES)


def kind_of(dtype: T.DataType) -> str:
    """int / float / datetime / bool / string."""
    if isinstance(dtype, _INT_TYPES):
        return "int"
    if isinstance(dtype, _FLOAT_TYPES):
        return "float"
    if is_time(dtype):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    return "string"


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in skip]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType) and f.name not in skip]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is one idea: turn NaN into NULL in every floating column."""
    floats = [f.name for f in df.schema.fields if is_floating(f.dataType)]
    if not floats:
        return df
    return df.withColumns({c: F.nanvl(col(c), F.lit(None).cast("double")).cast(df.schema[c].dataType)
                           for c in floats})


def as_number(column: Column | str) -> Column:
    """Numeric reading of any column: what does not parse, and NaN, is NULL."""
    c = col(column) if isinstance(column, str) else column
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def safe_divide(top: Column, bottom: Column) -> Column:
    """Division whose undefined results are NULL."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def text_of(df: DataFrame, column: str) -> Column:
    """Text form of a column; timestamps as yyyy-MM-dd HH:mm:ss."""
    if is_time(df.schema[column].dataType):
        return F.date_format(col(column), "yyyy-MM-dd HH:mm:ss")
    return col(column).cast("string")


def micros(column: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(column.cast("timestamp"))


def from_micros(column: Column, like: T.DataType | None = None) -> Column:
    """Back from micros; without zone unless `like` says otherwise."""
    ts = F.timestamp_micros(column.cast("bigint"))
    if isinstance(like, T.TimestampType):
        return ts
    return ts.cast("timestamp_ntz")


def fresh(df: DataFrame, *wanted: str) -> tuple[str, ...]:
    """Names for scratch columns that do not collide with the table's own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        candidate = w
        while candidate.lower() in taken:
            candidate = "_" + candidate
        taken.add(candidate.lower())
        out.append(candidate)
    return tuple(out)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition that lets NULL meet NULL on every key."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[name(k)].eqNullSafe(right[name(k)])
    return cond


def unpivot_agg(wide: DataFrame, ids: Sequence[str], variables: Sequence[str],
                fields: Sequence[tuple[str, str]], label: str = "variable") -> DataFrame:
    """Turn one wide aggregate row `v0__n, v0__mean, v1__n ...` into one row per variable.

    `variables` gives the labels in position order; `fields` is (suffix, output name).
    """
    parts = []
    for i, v in enumerate(variables):
        cells = [F.lit(v).alias(label)] + [F.col(f"v{i}__{s}").alias(out) for s, out in fields]
        parts.append(F.struct(*cells))
    cell = fresh(wide, "_cell")[0]
    return (wide.select(*[col(c) for c in ids], F.explode(F.array(*parts)).alias(cell))
            .select(*[col(c) for c in ids], f"{cell}.*"))
