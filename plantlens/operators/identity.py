"""Row identity, validation and column facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.columns import (categorical_columns, col, fresh, kind_of, name, nan_to_null,
                                         numeric_columns)
from plantlens.operators.ordered import number_rows


class DataError(ValueError):
    """The table cannot be used as it is."""


def validate(df: DataFrame) -> DataFrame:
    """Refuse duplicate column names and an empty table."""
    seen: set[str] = set()
    twice = [c for c in df.columns if c in seen or seen.add(c)]
    if twice:
        raise DataError(f"duplicate column names: {sorted(set(twice))}")
    if df.isEmpty():
        raise DataError("the table has no rows")
    return df


def ids_are_usable(df: DataFrame, id_col: str) -> bool:
    """No id missing and none twice; ids are compared as text.

    A grouped count that looks for the first offender: no id set is held in one
    task, and map-side combine absorbs a hot id.
    """
    key = col(id_col).cast("string")
    bad = df.groupBy(key.alias("k")).count().filter("k is null or count > 1")
    return bad.limit(1).count() == 0


def ensure_id(df: DataFrame, id_col: str = "id", order_cols: Sequence[str] | None = None,
              block_rows: int | None = None) -> DataFrame:
    """Give every row a unique, non-null text id.

    A usable id column is cast to string; a missing or unusable one becomes
    "1".."n" in the order of `order_cols` (all columns by default). Rows equal in
    all order columns take their numbers in any order.
    """
    present = id_col in df.columns
    if present and ids_are_usable(df, id_col):
        return df.withColumn(id_col, col(id_col).cast("string"))
    order = list(order_cols) if order_cols else [c for c in df.columns if c != id_col]
    numbered = fresh(df, "_rowno")[0]
    out = number_rows(df, order or [id_col], numbered, block_rows=block_rows)
    out = out.withColumn(id_col, F.col(numbered).cast("string")).drop(numbered)
    return out.select(*[col(c) for c in (df.columns if present else [id_col, *df.columns])])


def load_table(df: DataFrame, id_col: str = "id", order_cols: Sequence[str] | None = None) -> DataFrame:
    """Validate, turn NaN into NULL, give ids."""
    return ensure_id(nan_to_null(validate(df)), id_col, order_cols)


def column_roles(df: DataFrame, id_col: str = "id") -> dict[str, list[str]]:
    return {"numeric": numeric_columns(df, [id_col]), "categorical": categorical_columns(df, [id_col])}


def column_kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def column_table(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Name, kind and role of every column, as rows."""
    numeric = set(numeric_columns(df, [id_col]))
    kinds = column_kinds(df)
    rows = [(c, kinds[c], "id" if c == id_col else "numeric" if c in numeric else "categorical")
            for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column string, kind string, role string")


def profile(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: row, column and role counts, and missing values over all columns."""
    roles = column_roles(df, id_col)
    missing = sum((F.sum(F.col(name(c)).isNull().cast("bigint")) for c in df.columns), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(len(roles["numeric"])).cast("bigint").alias("numeric_count"),
        F.lit(len(roles["categorical"])).cast("bigint").alias("categorical_count"),
        F.coalesce(missing, F.lit(0)).cast("bigint").alias("missing_values"))


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing and present values per column, from one aggregate."""
    wide = df.agg(F.count(F.lit(1)).alias("n"),
                  *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("present"),
                               (F.col("n") - F.col(f"c{i}")).alias("missing"))
                      for i, c in enumerate(df.columns)])
    return wide.select(F.explode(cells).alias("x")).select("x.*")
