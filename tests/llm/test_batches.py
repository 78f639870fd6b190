"""What a Python worker holds at once is bounded in bytes, whatever the rows of a task."""

from __future__ import annotations

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plantlens.llm import language, ngram_join, pieces, sized, stages

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    spark.conf.unset(KEY)
    yield
    spark.conf.unset(KEY)


def long_texts(spark, n=400):
    return spark.range(n, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 4000).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))


def batches(docs):
    """Rows and bytes of each batch that a worker gets."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])
    return sized.in_batches(docs.select("doc_id", "text"), run, "n bigint, size bigint").collect()


def test_batches_are_bounded_in_bytes(spark, unset):
    found = batches(long_texts(spark))
    assert sum(r.n for r in found) == 400
    assert len(found) >= 3 and max(r.size for r in found) <= sized.BATCH_BYTES + 100_000


def test_a_bound_of_the_session_is_kept(spark, unset):
    spark.conf.set(KEY, "100000")
    found = batches(long_texts(spark, 20))
    assert spark.conf.get(KEY) == "100000" and sum(r.n for r in found) == 20 and max(r.n for r in found) <= 6


@pytest.mark.parametrize("stage", [
    lambda docs: language.digest(docs), lambda docs: ngram_join.similar_groups(docs), stages.known_language, stages.one_of_each_group,
    lambda docs: stages.tokenized(docs, public_tokenizers.path("piece_bpe_32k.model"))])
def test_stages_bound_their_batches(spark, unset, stage):
    assert stage(long_texts(spark, 3)).count() >= 1
    assert spark.conf.get(KEY) == str(sized.BATCH_BYTES)


def test_memory_of_solving_many_new_units():
    letters = np.random.default_rng(5).integers(97, 123, (50_000, 8)).astype(np.uint8)
    text = " ".join(bytes(w).decode() for w in letters)
    v = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    tracemalloc.start()
    v.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000
