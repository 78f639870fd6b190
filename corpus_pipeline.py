"""From raw documents to token ids: language, near copies, personal data, source weights, pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plantlens.functions.lineage import stored
from plantlens.llm import stages

STAGES = [
    ("language", lambda spark, docs, sf_dir: stages.known_language(docs)),
    ("ngram_join", lambda spark, docs, sf_dir: stages.one_of_each_group(docs)),
    ("pii", lambda spark, docs, sf_dir: stages.without_personal_data(docs)),
    ("mixing", lambda spark, docs, sf_dir: stages.mixed(docs)),
    ("pieces", lambda spark, docs, sf_dir: stages.tokenized(docs, public_tokenizers.path("piece_bpe_32k.model"))),
]
# Language and segmentation are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
