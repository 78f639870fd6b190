"""Joins with a list of ids whose size is looked at first, and batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Up to so many rows of a few numbers each (some tens of MB) a list is sent to every executor; beyond it, both sides are shuffled.
MOST_SENT = 1_000_000


def small_or_shuffled(ids: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """The list, marked for broadcast if a count shows that it is short."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


# Bytes of rows that go to a Python worker at once, one longer row still whole. Spark's own bounds, 10,000 rows and 64 MB, let a batch
# hold all texts of a task, on both sides and with room to double.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """`mapInArrow` over batches of bounded bytes. Spark looks the bound up when the table is computed, so it stays set in the
    session; one that the session already names is kept."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


# Bits of a filter for each key, and bounds of its size: 1 MB to 128 MB.
BITS_PER_KEY = 16
_LEAST_BITS, _MOST_BITS = 1 << 23, 1 << 30
_PART = 1 << 15


class Bitmap:
    """Which 64-bit hashes may be among given ones: one bit each in a table that is sent to all tasks. The size follows the number
    of keys up to a bound; the fuller the table, the less it rules out. What it lets through has to be joined."""

    def __init__(self, keys: DataFrame) -> None:
        name = keys.columns[0]
        n = keys.count()
        self.bits = min(max(1 << (BITS_PER_KEY * max(n, 1) - 1).bit_length(), _LEAST_BITS), _MOST_BITS)
        key = F.pmod(F.col(name), F.lit(self.bits))
        rows = keys.select(F.floor(key / _PART).alias("part"), F.pmod(key, F.lit(_PART)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
        table = np.zeros(self.bits // 8, np.uint8)
        for r in rows.toLocalIterator():
            table[r.part * (_PART // 8):(r.part + 1) * (_PART // 8)] = np.frombuffer(r.bits, np.uint8)
        self.held = keys.sparkSession.sparkContext.broadcast(table)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash, signed or unsigned, may be a key."""
        at = hashes.view(np.int64) & (self.bits - 1)
        return (self.held.value[at >> 3] >> (at & 7) & 1).astype(bool)
