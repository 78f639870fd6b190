"""Places of rows in an order, for any number of rows and groups of any size.

Rows are range-partitioned by group and order and sorted. A task numbers the rows of its partition in one stream; what
crosses partitions is one row for each of them, from which every partition gets the number of rows its first group
has in earlier ones. A group may fill any number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.functions.lineage import stored
from plantlens.llm.words import unused


def _numbered(df: DataFrame, group: str, part: str, local: str) -> DataFrame:
    """Add the partition's number and the place within it to rows that are sorted by group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(group).to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = key[0] != last
            heads = np.flatnonzero(new)
            index = np.arange(len(key))
            from_head = np.searchsorted(heads, index, side="right") - 1
            place = np.where(from_head < 0, n + index + 1, index - heads[np.maximum(from_head, 0)] + 1 if len(heads) else 0)
            last, n = key[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(key), TaskContext.get().partitionId())), pa.array(place)],
                                             [*batch.schema.names, part, local])

    kind = T.StructType([*df.schema.fields, T.StructField(part, T.LongType()), T.StructField(local, T.LongType())])
    return df.mapInArrow(run, kind)


def places(df: DataFrame, order: list[Column], group: str | None = None, name: str = "place") -> DataFrame:
    """Add `name`, the place from 1 of each row among the rows of its `group` (a long without nulls; all rows if None).
    Rows equal in the whole order take their places in any order."""
    key, tie, part, local = (unused(df, s) for s in ("place_group", "place_tie", "place_part", "place_local"))
    keyed = df.withColumns({key: F.col(group) if group else F.lit(0).cast("long"), tie: F.monotonically_increasing_id()})
    # the tie splits rows that are equal in everything else
    by = [F.col(key), *order, F.col(tie)]
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop(tie)
    numbered = stored(_numbered(dealt, key, part, local), "places")
    ends = numbered.groupBy(part).agg(F.min(key).alias("first"), F.max(F.struct(key, local)).alias("last")).select(
        F.col(part).alias("of_part"), "first", F.col(f"last.{key}").alias("last"), F.col(f"last.{local}").alias("n"))
    # one row for each partition
    in_order, of_last = Window.orderBy("of_part"), Window.partitionBy("last").orderBy("of_part")
    ahead = (ends.withColumn("sum", F.sum("n").over(of_last))
             .select("of_part", "first", F.lag("last").over(in_order).alias("last"), F.lag("sum").over(in_order).alias("ahead"))
             .where("first = last").select("of_part", "first", "ahead"))
    return (numbered.join(F.broadcast(ahead), (F.col(part) == F.col("of_part")) & (F.col(key) == F.col("first")), "left")
            .withColumn(name, F.col(local) + F.coalesce("ahead", F.lit(0)))
            .select(*df.columns, name))
