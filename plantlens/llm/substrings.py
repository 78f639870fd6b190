"""Passages of `WINDOW` words that also stand in a document with a smaller id.

A full-text index of everything against everything would grow with the square of the corpus, so windows are first
routed. Each half of a window has an anchor, the least hash of its eight-word runs, which depends on the half's words
alone. A window can stand in two documents only if both its anchors do, and all its copies have the same anchors.

1. One pass measures documents: a signature of the word sequence, and the distinct anchors. Documents with equal
   sequences are one class; all but the one with the least id are covered as a whole and not looked at further.
2. Anchors that stand in one class only are dropped. Runs of neighbouring windows whose anchors are shared and whose
   lesser anchor is the same are segments, named by that anchor and a hash of their words. Equal segments become one row
   with the least doc_id, pre-aggregated, so a passage that a third of all documents share is one segment.
3. Distinct segments are dealt to shards by anchor. Of an anchor with more than `MOST_SEGMENTS` distinct segments, whose
   documents differ just beside a common passage, every window is a segment of its own and dealt by its hash.
4. Each shard builds an FM-index of its segments and streams them through it: backward search over the wavelet matrix
   gives the matching statistics, cut at the window's length, and with them the least doc_id of each window.
5. Windows whose least doc_id is smaller than their own document's are joined into intervals and the words in them go.

Words are compared by 64-bit hashes, so a window by 50 of them. Routing is exact: no window, anchor or document is
capped or sampled.

Cases: a null text has no words; documents of fewer words than a window lose nothing; equal texts lose all words but in
the one with the least id, if there is a full window; rows with the same doc_id are one document and lose nothing to
each other; a row with a null doc_id neither loses words nor counts as smaller; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.lineage import stored
from plantlens.llm.fm_index import FmIndex
from plantlens.llm.sized import small_or_shuffled
from plantlens.llm.wordhash import Words, grams, words

WINDOW = 50
GRAM = 8
# Words of an index, one shard's share of a task's memory; and windows of a segment, the steps of a stream.
SHARD_WORDS = 300_000
SEGMENT_WINDOWS = 128
MOST_SEGMENTS = 2_000
# Tables of intervals up to so many rows are sent to all tasks.
MOST_SENT = 200_000


def _least_of_runs(h: np.ndarray, size: int) -> np.ndarray:
    """The least of each run of `size` neighbours, by doubling."""
    out, have = h, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _anchors(part: Words, window: int) -> np.ndarray:
    """The anchor of the half window that starts at each word; runs over the ends of documents are in it too."""
    half = window // 2
    if len(part.hashes) < half:
        return np.zeros(0, np.uint64)
    return _least_of_runs(grams(part.hashes, GRAM), half - GRAM + 1)


def _signature(h: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(np.ascontiguousarray(h).tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _measure(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words(batch.column("text")):
                anchor, rows = _anchors(part, window), []
                for lo, hi in zip(part.bounds[:-1], part.bounds[1:]):
                    own = np.unique(anchor[lo:hi - window // 2 + 1]) if hi - lo >= window else anchor[:0]
                    rows.append((*_signature(part.hashes[lo:hi]), own.view(np.int64)))
                s1, s2, own = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.first, len(rows)), pa.array(np.diff(part.bounds).astype(np.int64)),
                     pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(own, pa.list_(pa.int64()))],
                    names=["doc_id", "n_words", "s1", "s2", "anchors"])
    return run


def _segments_of(part: Words, k: int, anchor: np.ndarray, shared: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and anchor of the segments of row k; places count from the row's start."""
    lo, hi = part.bounds[k], part.bounds[k + 1]
    half, m = window // 2, hi - lo - window + 1
    if m <= 0 or not len(shared):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    mine = anchor[lo:lo + m + half]
    place = np.minimum(np.searchsorted(shared, mine), len(shared) - 1)
    held = shared[place] == mine
    both = held[:m] & held[half:half + m]
    key = np.minimum(mine[:m], mine[half:half + m])
    new = np.ones(m, bool)
    new[1:] = (key[1:] != key[:-1]) | ~both[:-1]
    first = np.flatnonzero(new & both)
    stop = np.minimum.accumulate(np.where(new | ~both, np.arange(m), m)[::-1])[::-1]
    end = np.append(stop[1:], m)[first]
    pieces = -(-(end - first) // SEGMENT_WINDOWS)
    start = np.repeat(first, pieces) + SEGMENT_WINDOWS * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return start, np.minimum(np.repeat(end, pieces) - start, SEGMENT_WINDOWS), key[start]


def _occurrences(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shared")
            for part in words(batch.column("text")):
                anchor, rows = _anchors(part, window), []
                for k in range(part.last - part.first):
                    shared = np.sort(np.array(lists[part.first + k].as_py(), np.int64).view(np.uint64))
                    start, n, key = _segments_of(part, k, anchor, shared, window)
                    lo = part.bounds[k]
                    name = [_signature(part.hashes[lo + a:lo + a + b + window - 1])[0] for a, b in zip(start, n)]
                    text = _signature(part.hashes[lo:part.bounds[k + 1]])[0]
                    rows.append((np.full(len(start), part.first + k), np.full(len(start), text), start, n, key, np.array(name, np.int64)))
                row, text, start, n, key, name = (np.concatenate(c) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), pa.array(text), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int64)),
                     pa.array(key.view(np.int64)), pa.array(name)], names=["doc_id", "text_id", "start", "windows", "anchor", "name"])
    return run


def _contents(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("segments")
            for part in words(batch.column("text")):
                for k in range(part.last - part.first):
                    lo, out = part.bounds[k], []
                    text = _signature(part.hashes[lo:part.bounds[k + 1]])[0]
                    for s in lists[part.first + k].as_py():
                        if s["text_id"] != text:
                            continue
                        h = part.hashes[lo + s["start"]:lo + s["start"] + s["windows"] + window - 1]
                        if s["single"]:
                            out += [(s["anchor"], s["name"], i, _signature(h[i:i + window])[0], h[i:i + window].tobytes()) for i in range(s["windows"])]
                        else:
                            out.append((s["anchor"], s["name"], 0, None, h.tobytes()))
                    if out:
                        anchor, name, offset, single, content = zip(*out)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").slice(part.first + k, 1).take(pa.array([0] * len(out))), pa.array(anchor, pa.int64()),
                             pa.array(name, pa.int64()), pa.array(offset, pa.int32()), pa.array(single, pa.int64()), pa.array(content, pa.binary())],
                            names=["doc_id", "anchor", "name", "offset", "single", "content"])
    return run


def _search(window: int):
    def run(group: pa.Table) -> pa.Table:
        sequences = [np.frombuffer(c, np.uint64) for c in group.column("content").to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
        symbols = np.concatenate(sequences)
        index = FmIndex(symbols, bounds, group.column("doc_id").to_numpy(), window)
        least = index.least_owners(symbols, bounds)
        found = [least[lo:hi - window + 1] for lo, hi in zip(bounds[:-1], bounds[1:])]
        return pa.table({"anchor": group.column("anchor"), "name": group.column("name"), "offset": group.column("offset"),
                         "single": group.column("single"), "least": pa.array(found, pa.list_(pa.int64()))})
    return run


def _covered(window: int):
    """Intervals of words of each occurrence whose windows have a smaller document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
            start = batch.column("start").to_numpy(zero_copy_only=False)
            least = batch.column("least")
            lengths = np.diff(least.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), lengths)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            hit = least.flatten().to_numpy() < doc[row]
            row, place = row[hit], (start[row] + inside)[hit]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row)) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[row[first]]), batch.column("text_id").take(pa.array(row[first])), pa.array(place[first].astype(np.int64)), pa.array((place[last] + window).astype(np.int64))],
                names=["doc_id", "text_id", "from_word", "to_word"])
    return run


def repeated_intervals(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Intervals (doc_id, text_id, from_word, to_word) covered by repeated windows, and the texts (doc_id, text_id) that
    are covered as a whole. text_id tells texts with one doc_id apart."""
    docs = docs.select("doc_id", "text")
    measured = stored(docs.mapInArrow(_measure(window), "doc_id bigint, n_words bigint, s1 bigint, s2 bigint, anchors array<bigint>"), "measured")
    able = measured.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    classes = stored(able.groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.first("anchors").alias("anchors")), "classes")
    copies = stored(able.select("s1", "s2", "doc_id").join(classes.select("s1", "s2", "least"), ["s1", "s2"]).where(
        F.col("least") < F.col("doc_id")).select("doc_id", F.col("s1").alias("text_id")).distinct(), "copies")

    each = classes.select("least", F.explode("anchors").alias("anchor"))
    shared = stored(each.groupBy("anchor").agg(F.min("least").alias("a"), F.max("least").alias("b")).where("a <> b").select("anchor"), "shared")
    lists = stored(each.join(small_or_shuffled(shared), "anchor", "left_semi").groupBy(F.col("least").alias("doc_id")).agg(
        F.collect_set("anchor").alias("shared")), "lists")
    # several texts with one doc_id: each is searched with all anchors of that id
    texts = docs.join(small_or_shuffled(lists, MOST_SENT), "doc_id")
    seen = stored(texts.mapInArrow(_occurrences(window), "doc_id bigint, text_id bigint, start bigint, windows bigint, anchor bigint, name bigint"), "segments")

    distinct = seen.groupBy("anchor", "name").agg(F.min(F.struct("doc_id", "text_id", "start", "windows")).alias("at"))
    per_anchor = distinct.groupBy("anchor").agg(F.count("*").alias("segments"))
    hot = stored(per_anchor.where(F.col("segments") > MOST_SEGMENTS).select("anchor", F.lit(True).alias("single")), "hot")
    distinct = stored(distinct.join(small_or_shuffled(hot), "anchor", "left").select(
        "at.*", "anchor", "name", F.coalesce("single", F.lit(False)).alias("single")), "distinct")
    per_doc = stored(distinct.groupBy("doc_id").agg(F.collect_list(F.struct("text_id", "start", "windows", "anchor", "name", "single")).alias("segments")), "per_doc")
    contents = docs.join(small_or_shuffled(per_doc, MOST_SENT), "doc_id").mapInArrow(
        _contents(window), "doc_id bigint, anchor bigint, name bigint, offset int, single bigint, content binary")
    size = distinct.agg(F.sum(F.when(F.col("single"), F.col("windows") * window).otherwise(F.col("windows") + window))).first()[0] or 0
    shards = int(size // SHARD_WORDS) + 1
    dealt = contents.withColumn("shard", F.pmod(F.xxhash64(F.coalesce("single", "anchor")), F.lit(shards)).cast("int"))
    found = stored(dealt.groupBy("shard").applyInArrow(
        _search(window), "anchor bigint, name bigint, offset int, single bigint, least array<bigint>"), "found")

    whole = found.where("single IS NULL").select("anchor", "name", F.col("offset").cast("bigint").alias("ahead"), "least")
    single = found.where("single IS NOT NULL").select("anchor", "name", F.col("offset").cast("bigint").alias("ahead"), "least")
    hits = seen.join(small_or_shuffled(whole.union(single), MOST_SENT), ["anchor", "name"]).select(
        "doc_id", "text_id", (F.col("start") + F.col("ahead")).alias("start"), "least")
    return stored(hits.mapInArrow(_covered(window), "doc_id bigint, text_id bigint, from_word bigint, to_word bigint"), "intervals"), copies


def _removed(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, copies = batch.column("spans"), batch.column("copies")
            for part in words(batch.column("text")):
                n, removed, digests, kept_text = [], [], [], []
                raw = part.data.tobytes()
                for k in range(part.last - part.first):
                    lo, hi = part.bounds[k], part.bounds[k + 1]
                    keep = np.ones(hi - lo, bool)
                    spans, whole = lists[part.first + k].as_py() or (), copies[part.first + k].as_py() or ()
                    if spans or whole:
                        name = _signature(part.hashes[lo:hi])[0]
                        keep[:] = name not in whole
                        for s in spans:
                            if s["text_id"] == name:
                                keep[s["from_word"]:s["to_word"]] = False
                    at = lo + np.flatnonzero(keep)
                    text = b" ".join([raw[a:b] for a, b in zip(part.starts[at].tolist(), part.ends[at].tolist())])
                    n.append(hi - lo)
                    removed.append(int(hi - lo - len(at)))
                    digests.append(hashlib.sha256(text).hexdigest())
                    kept_text.append(text.decode())
                columns = [batch.column("doc_id").slice(part.first, len(n)), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                           pa.array(kept_text if with_text else digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_text" if with_text else "kept_sha256"])
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the kept words, as text or as its sha256."""
    docs = docs.select("doc_id", "text")
    intervals, copies = repeated_intervals(docs, window)
    spans = intervals.groupBy("doc_id").agg(F.collect_set(F.struct("text_id", "from_word", "to_word")).alias("spans"))
    whole = copies.groupBy("doc_id").agg(F.collect_set("text_id").alias("copies"))
    marks = stored(spans.join(whole, "doc_id", "full"), "marks")
    marked = docs.join(small_or_shuffled(marks, MOST_SENT), "doc_id", "left").select("doc_id", "text", "spans", "copies")
    out = "kept_text" if with_text else "kept_sha256"
    return marked.mapInArrow(_removed(with_text), f"doc_id bigint, n_words bigint, n_removed bigint, {out} string")
