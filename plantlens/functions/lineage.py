"""Intermediate results in the folder that all executors share.

The folder is the session's `spark.checkpoint.dir`. Where that is unset, as in tests, a local session gets a
temporary folder for as long as it lives; any other session gets an error, since executors could not read
what the driver's machine holds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder as a URI or path without a slash at its end."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="plantlens-")
    return _own[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: reliable storage, so a lost executor loses nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder. The caller removes what it writes there with `remove`."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """Write a table to the shared folder and read it back: columns and compression, each row computed once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by `scratch_path`."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
