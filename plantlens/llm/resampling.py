"""Resample documents so that their features are distributed like those of target texts.

Features are runs of words, hashed by crc32 into a fixed number of buckets. One pass counts the buckets over all documents
and one over all target texts; a task adds up its counts before they are shuffled, so each sends one row for each
bucket. A bucket's gain is the logarithm of its share in the target over its share in the corpus; a second pass adds up
the gains of each document's features. The draw takes the documents with the largest score, the weight with Gumbel
noise from a hash of the id, which is sampling without replacement in proportion to the importance.

Checksums of all features of a column come from `crc_spans`. Ranks are places over range partitions (`places`), of rows
without their texts.

Cases: a null text has no words and weight 0; a null doc_id is hashed as an empty id and is last among equal scores;
repeated rows are scored one by one and, as their scores are equal, ranked next to each other; without target texts all
target counts are 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.lineage import stored
from plantlens.llm.crc_spans import crc32_spans
from plantlens.llm.parts import parts
from plantlens.llm.places import places
from plantlens.llm.words import text_of

BUCKETS = 10_000
MOST_WORDS = 1
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
# Text worked on at a time; its index arrays are some thirty times as large.
_PART = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes, and the number of words before each row's boundary."""
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    rows = edges[:-1][edges[:-1] < edges[1:]]
    first[rows] |= inside[rows]
    last[rows[1:] - 1] |= inside[rows[1:] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, edges)


def _features(data: np.ndarray, edges: np.ndarray, most_words: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: the buckets of all runs, and the number of runs before each row's boundary."""
    data = _LOWER[data]
    starts, ends, before = _words(data, edges)
    if most_words > 1:
        # words one space apart, so that a run of them is one span
        size = ends - starts
        new = np.cumsum(size + 1) - size - 1
        joined = np.full(int((size + 1).sum()), 32, np.uint8)
        spread = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        joined[spread + np.repeat(new, size)] = data[spread + np.repeat(starts, size)]
        data, starts, ends = joined, new, new + size
    row = np.searchsorted(before, np.arange(len(starts)), side="right")
    for k in range(1, most_words + 1):
        one_row = np.flatnonzero(row[:len(row) - k + 1] == row[k - 1:])
        found = crc32_spans(data, starts[one_row], ends[one_row + k - 1])
        yield (found % np.uint32(buckets)).astype(np.int64), np.searchsorted(one_row, before)


def bucket_counts(texts: DataFrame, most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n over all texts, for buckets that occur."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, edges, data in parts(batch.column("text"), _PART):
                for found, _ in _features(data, edges, most_words, buckets):
                    total += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    return texts.select(text_of().alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain in thousandths, for every bucket, from the counts of corpus and target."""
    each = stored(corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
                  .join(corpus.withColumnRenamed("n", "s"), "bucket", "left")
                  .join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"]), "buckets")
    all_s, all_t = each.agg(F.sum("s"), F.sum("t")).first()
    up = (F.col("t").cast("double") + 1) * F.lit(float(all_s + buckets))
    down = (F.col("s").cast("double") + 1) * F.lit(float(all_t + buckets))
    return each.select("bucket", F.floor(1000 * F.log(up / down)).cast("long").alias("gain"))


def _weighed(docs: DataFrame, gain: Broadcast, most_words: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, edges, data in parts(batch.column("text"), _PART):
                words, n, weight = None, np.zeros(last - first, np.int64), np.zeros(last - first, np.int64)
                for found, before in _features(data, edges, most_words, buckets):
                    sums = np.zeros(len(found) + 1, np.int64)
                    np.cumsum(gain.value[found], out=sums[1:])
                    n += np.diff(before)
                    weight += np.diff(sums[before])
                    words = np.diff(before) if words is None else words
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)],
                                                 ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED,
             most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it is not drawn. Drawn are
    `percent` of the documents with `least_words` words, rounded down. `docs` has doc_id and text, `target` text."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", text_of().alias("text"))
    table = gains(bucket_counts(docs, most_words, buckets), bucket_counts(target, most_words, buckets), buckets)
    by_bucket = np.zeros(buckets, np.int64)
    for row in table.collect():
        by_bucket[row.bucket] = row.gain
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((hashed.cast("double") + 0.5) / 4294967296)))
    scored = stored(_weighed(docs, spark.sparkContext.broadcast(by_bucket), most_words, buckets)
                    .withColumn("score", (F.col("weight") + noise).cast("long")), "scores")
    enough = scored.where(F.col("n_words") >= least_words)
    drawn = percent * enough.count() // 100
    ranked = places(enough, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], name="rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return (ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
            .union(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long"))))
