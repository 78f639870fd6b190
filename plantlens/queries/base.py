"""Helpers for the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions.columns import col, is_floating


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns so that the order of additions does not show."""
    return df.select(*[(F.round(col(f.name), digits) + F.lit(0.0)).alias(f.name)
                       if is_floating(f.dataType) else col(f.name) for f in df.schema.fields])
