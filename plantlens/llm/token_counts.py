"""Numbers of tokens without ids: pieces are counted once for each distinct pre-token of the corpus.

A first pass counts the distinct pre-tokens of all documents (`vocabulary`; pre-aggregated in each task, shuffled by
pre-token), and the library is asked once for each of them how many pieces it has. A second pass joins these numbers to
the frequencies of each document's pre-tokens and adds them up. The join has two sides that together are exact at every
size: the most frequent pre-tokens, `HEAD_BYTES` of them whatever the corpus, are sent to the tasks, and a document keeps
rows (pre-token, frequency) only for the rest, which are joined by a shuffle. No pre-token of the rest is frequent, so that
no key is hot. Pre-tokens over `LONG_BYTES` would cost more to ship than to count: they are counted where they stand.

Texts are cut by `pretokens`; an added token's string inside a text is one pre-token, as in the library's default.

Cases: a null text counts as empty and has no tokens; null and repeated doc_ids are rows of their own; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.lineage import stored
from plantlens.llm.parts import parts
from plantlens.llm.pretokens import dictionary, pre_tokenizer
from plantlens.llm.words import text_of

HEAD_BYTES = 16 << 20
LONG_BYTES = 1024
LIMIT = 1024
# What a row of the head weighs besides its text, and steps of its histogram for a factor of two.
_ROW_BYTES = 24
_STEPS = 4
_heads: dict[str, dict[str, int]] = {}


def _lengths(starts: np.ndarray, n_bytes: int) -> np.ndarray:
    return np.diff(starts, append=n_bytes)


def vocabulary(docs: DataFrame, path: str, long_bytes: int = LONG_BYTES) -> DataFrame:
    """piece, n: the distinct pre-tokens of all texts and how often they occur."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = pre_tokenizer(path)
        for batch in batches:
            for _, _, edges, data in parts(batch.column("text")):
                starts, _ = cutter.cut(data, edges)
                values, index = dictionary(data, starts)
                short = np.bincount(index, _lengths(starts, len(data)) <= long_bytes, len(values)).astype(np.int64)
                there = np.flatnonzero(short)
                yield pa.RecordBatch.from_arrays([values.take(pa.array(there)).cast(pa.string()), pa.array(short[there])], ["piece", "n"])

    return docs.select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def count_pieces(words: DataFrame, path: str) -> DataFrame:
    """Add n_pieces, the library's number of tokens of `piece`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = pre_tokenizer(path)
        for batch in batches:
            counts = cutter.n_pieces(batch.column("piece").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array(counts, pa.int32())], ["piece", "n", "n_pieces"])

    return words.mapInArrow(run, "piece string, n long, n_pieces int")


def _head(pieces: DataFrame, head_bytes: int) -> DataFrame:
    """The most frequent rows, by whole steps of frequency, as many as fit."""
    step = F.floor(F.log2("n") * _STEPS)
    weights = pieces.groupBy(step.alias("step")).agg(F.sum(F.octet_length("piece") + _ROW_BYTES).alias("weight")).collect()
    total, least = 0, None
    for row in sorted(weights, key=lambda r: -r.step):
        total += row.weight
        if total > head_bytes:
            break
        least = row.step
    return pieces.where(F.lit(False) if least is None else step >= least).select("piece", "n_pieces")


def _numbers(name: str, head: Broadcast) -> dict[str, int]:
    """The head as a dictionary, made once in each worker."""
    if name not in _heads:
        _heads.clear()
        table = head.value
        _heads[name] = dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))
    return _heads[name]


def _per_document(docs: DataFrame, path: str, head: Broadcast, long_bytes: int) -> DataFrame:
    """Tokens of the pre-tokens in the head or counted in place, and the frequencies of the others."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, numbers = pre_tokenizer(path), _numbers(name, head)
        for batch in batches:
            for first, last, edges, data in parts(batch.column("text")):
                starts, before = cutter.cut(data, edges)
                values, index = dictionary(data, starts)
                texts = values.to_pylist()
                known = np.fromiter((numbers.get(t, -1) for t in texts), np.int64, len(texts))
                size = np.zeros(len(texts), np.int64)
                size[index] = _lengths(starts, len(data))
                long = np.flatnonzero(size > long_bytes)
                known[long] = cutter.n_pieces([texts[k] for k in long.tolist()])
                each = known[index]
                sums = np.zeros(len(each) + 1, np.int64)
                np.cumsum(np.maximum(each, 0), out=sums[1:])
                rest = np.flatnonzero(each < 0)
                rows = np.searchsorted(before, rest, side="right") - 1
                pair, freq = np.unique(rows * len(texts) + index[rest], return_counts=True)
                ends = np.searchsorted(pair, np.arange(last - first + 1) * max(len(texts), 1)).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                    [values.take(pa.array(pair % max(len(texts), 1))).cast(pa.string()), pa.array(freq.astype(np.int64))], ["piece", "freq"]))
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(np.diff(edges)),
                                                  pa.array(np.diff(sums[before])), listed], ["row", "doc_id", "n_bytes", "known", "rest"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(run, f"row long, doc_id {kind}, n_bytes long, known long, rest array<struct<piece: string, freq: long>>")


def token_counts(docs: DataFrame, path: str, head_bytes: int = HEAD_BYTES, long_bytes: int = LONG_BYTES) -> DataFrame:
    """doc_id, n_bytes of the text in UTF-8 and n_tokens of every document, by the tokenizer file at `path`."""
    docs = docs.select("doc_id", text_of().alias("text"))
    pieces = stored(count_pieces(vocabulary(docs, path, long_bytes), path), "pieces")
    head = docs.sparkSession.sparkContext.broadcast(_head(pieces, head_bytes).toArrow())
    counted = stored(_per_document(docs, path, head, long_bytes), "token-counts")
    rest = (counted.select(F.col("row").alias("of_row"), F.explode("rest").alias("r")).select("of_row", "r.piece", "r.freq")
            .join(pieces, "piece").groupBy("of_row").agg(F.sum(F.col("freq") * F.col("n_pieces")).alias("more")))
    return counted.join(rest, F.col("row") == F.col("of_row"), "left").select(
        "doc_id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def digest(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    return token_counts(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
