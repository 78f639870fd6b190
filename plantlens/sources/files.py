"""File readers and the CSV sink."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.operators.identity import DataError

# Encodings tried in turn, and the name Spark knows each by.
ENCODINGS = ("utf-8-sig", "utf-8", "cp932", "shift_jis")
SPARK_CHARSETS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp932": "windows-31j", "shift_jis": "Shift_JIS"}
_LEGACY_CHARSETS = "spark.sql.legacy.javaCharsets"


def _charset(encoding: str) -> str:
    return SPARK_CHARSETS.get(encoding.lower(), encoding)


def csv_reader(spark: SparkSession, path, encoding: str, schema=None, **options) -> DataFrame:
    charset = _charset(encoding)
    if charset not in ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"):
        spark.conf.set(_LEGACY_CHARSETS, "true")
    reader = spark.read.option("header", True).option("encoding", charset).options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def _undecodable(encoding: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for line in batch.column("line").to_pylist():
                try:
                    line.decode(encoding)
                    bad.append(False)
                except UnicodeDecodeError:
                    bad.append(True)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.bool_())], names=["bad"])
    return run


def _has_bad_bytes(spark: SparkSession, path, encoding: str) -> bool:
    """Whether any line of the data is not in the encoding.

    Spark reads wrong bytes as U+FFFD instead of failing, so the bytes of all lines
    are tested in one distributed pass: by a built-in function for UTF-8, else by a
    strict decoder. Charsets in which a line break is not the byte 10 cannot be cut
    into lines beforehand; their text is searched for U+FFFD.
    """
    if _charset(encoding) == "UTF-8":
        lines = spark.read.text(path)
        return not lines.filter(~F.is_valid_utf8("value")).isEmpty()
    if "a\n".encode(encoding) == b"a\n":
        lines = spark.read.text(path).select(F.col("value").cast("binary").alias("line"))
        return not lines.mapInArrow(_undecodable(encoding), "bad boolean").filter("bad").isEmpty()
    text = spark.read.option("encoding", _charset(encoding)).option("header", False).csv(path)
    bad = F.lit(False)
    for c in text.columns:
        bad = bad | F.coalesce(F.contains(F.col(c), F.lit("\ufffd")), F.lit(False))
    return not text.filter(bad).isEmpty()


def read_csv(spark: SparkSession, path: str | Sequence[str], encodings: Sequence[str] = ENCODINGS, schema=None,
             **options) -> DataFrame:
    """CSV with a header row; the first encoding in which all lines are valid is used.

    Types are inferred unless a schema is given (which saves a pass over the data).
    """
    tried, seen = [], set()
    for encoding in encodings:
        if _charset(encoding) in seen:
            continue
        seen.add(_charset(encoding))
        try:
            if _charset(encoding) != "UTF-8":
                spark.conf.set(_LEGACY_CHARSETS, "true")
            if _has_bad_bytes(spark, path, encoding):
                tried.append(f"{encoding}: undecodable bytes")
                continue
            return csv_reader(spark, path, encoding, schema, **options)
        except Exception as exc:  # an unknown charset or an unreadable path
            tried.append(f"{encoding}: {str(exc).splitlines()[0]}")
    raise DataError("could not read the CSV; tried " + "; ".join(tried))


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pick the reader by file suffix."""
    suffix = PurePosixPath(str(path)).suffix.lower()
    if suffix in (".csv", ".txt"):
        return read_csv(spark, path, **options)
    if suffix == ".parquet":
        return spark.read.options(**options).parquet(path)
    if suffix in (".json", ".jsonl", ".ndjson"):
        return spark.read.options(**options).json(path)
    if suffix == ".orc":
        return spark.read.options(**options).orc(path)
    raise DataError(f"unsupported file type '{suffix}'")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write all rows as CSV part files with a header; an empty table is refused."""
    if df.isEmpty():
        raise DataError("there are no rows to write")
    df.write.mode(mode).option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
