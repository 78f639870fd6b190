"""The registered queries of this package and their SQL for DuckDB."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plantlens.llm import (
    language,
    licenses,
    mixing,
    near_vectors,
    ngram_join,
    oracles,
    personal,
    pieces,
    prefix_trie,
    quality,
    resampling,
    substrings,
    token_counts,
    token_records,
)
from plantlens.queries.base import Query, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.judge(table(spark, sf_dir, "documents"), trusted).drop("trusted")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = [
    Query("op1_mixing", op1_mixing),
    Query("op2_near_vectors", op2_near_vectors),
    Query("op3_token_records", op3_token_records),
    Query("op4_ngram_join", op4_ngram_join),
    Query("op5_pieces", op5_pieces),
    Query("op6_language", op6_language),
    Query("op7_pii", op7_pii),
    Query("op8_quality", op8_quality),
    Query("op9_licenses", op9_licenses),
    Query("op10_substrings", op10_substrings),
    Query("op11_prefix_trie", op11_prefix_trie, oracles.PREFIX_TRIE),
    Query("op12_resampling", op12_resampling, oracles.RESAMPLING),
    Query("op13_token_counts", op13_token_counts),
]
