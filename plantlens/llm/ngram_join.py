"""Pairs of documents whose sets of n-word shingles have a high Jaccard similarity, and the groups they form.

The join is a sparse product of the document-by-shingle incidence matrix with its transpose, kept small by bounds
that follow from set sizes alone. With J >= t, two sets of sizes x and y share at least a = ceil(t (x + y) / (1 + t))
shingles, and neither can be smaller than t times the other. In one order of all shingles, rare ones first, the first
shingle that two sets share stands at places i and j with 1 + min(x - i - 1, y - j - 1) >= a. So only the first
x - ceil(t x) + 1 shingles of a set, its head, are entries of the product, and an entry that misses the bound makes no
pair. Blocks of the product are the partitions of the shuffle on the shingle. What is left is verified on whole sets.

1. One pass over the texts gives each document its set's size, 128-bit signature and sketch, and counts of shingles in a
   table of fixed size, from which "rare first" is read. The counts only choose the order; any order is right.
2. Documents with equal sets are one class: no pair is made inside it. Sets are known by their signature, never by doc_id.
3. A second pass counts the shingles of heads, 8 bytes each; most stand in one head only and make no entry. A third pass
   gives the entries of those that may stand in two, by a bitmap, which are sorted by shingle once. Each shingle names one set
   as its hub, the one where it stands earliest; hub pairs are verified first, so a group of thousands of near copies costs a
   number of pairs in proportion to it.
4. A sketch has one bit for about each shingle of its set, the parity of the shingles that fall on it. Bits in which two
   sketches differ are at most the shingles that one set has alone, so pairs with too many of them go without their sets being
   moved; most pairs that share a shingle by chance do.
5. Sets that share a head shingle, meet the bounds and are not yet connected are compared in full; only shingles of three sets
   or more have such pairs. After that no link between components is left out. Components are contracted in tables, not on the driver.

Tables that were read for the last time are removed.

Cases: null texts and texts without words have empty sets, size 0, and link with nothing; a text with fewer words than
a shingle has one entry, its whole sequence; equal texts and repeated rows are one class; a row with a null doc_id
takes part, also as a link between others, and never names a component unless all of it is null (then null); extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantlens.functions.lineage import remove, stored
from plantlens.llm.components import components
from plantlens.llm.sized import Bitmap, in_batches, small_or_shuffled
from plantlens.llm.wordhash import Words, grams, mix, words

SIZE = 4
PERCENT = 85
# Counters of the table that orders shingles; 4 bytes each, whatever the corpus.
COUNTERS = 1 << 18
# Bounds of a sketch's size in bits; between them it is the power of two from the set's size on.
LEAST_BITS, MOST_BITS = 64, 1 << 13


def shared_least(x, y, percent: int):
    """Least number of shared shingles of sets of these sizes."""
    return -((-percent * (x + y)) // (100 + percent))


def _sets(part: Words, size: int) -> Iterator[np.ndarray]:
    """The set of each row as sorted hashes."""
    runs = grams(part.hashes, size)
    for lo, hi in zip(part.bounds[:-1], part.bounds[1:]):
        if hi - lo >= size:
            yield np.unique(runs[lo:hi - size + 1])
        elif hi > lo:
            yield mix(np.array([hash_all(part.hashes[lo:hi])], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def hash_all(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(np.ascontiguousarray(h).tobytes() + bytes([len(h) % 251]), digest_size=8).digest(), "little")


def _signature(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketch(s: np.ndarray) -> bytes:
    """Parities of a set's shingles by their last bits; bit k of a sketch half as long is the parity of bits k and k + its length."""
    bits = min(max(1 << (len(s) - 1).bit_length(), LEAST_BITS), MOST_BITS)
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketches_differ(a: bytes, b: bytes) -> int:
    """Least number of shingles that only one of the two sets has, as far as their sketches tell."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.unpackbits(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)))).sum())


def _measure(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in words(batch.column("text"), lower=True):
                found = list(_sets(part, size))
                if any(len(s) for s in found):
                    counters += np.bincount((np.concatenate(found) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
                signed = [_signature(s) if len(s) else (None, None) for s in found]
                n = len(found)
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(part.first, n), batch.column("doc_id").slice(part.first, n), pa.array([len(s) for s in found], pa.int64()),
                    pa.array([s[0] for s in signed], pa.int64()), pa.array([s[1] for s in signed], pa.int64()),
                    pa.array([sketch(s) if len(s) else None for s in found], pa.binary()),
                    pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))], names=_MEASURED)
        filled = np.flatnonzero(counters)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
            pa.array([filled.astype(np.int32)], pa.list_(pa.int32())), pa.array([counters[filled]], pa.list_(pa.int64()))], names=_MEASURED)
    return run


_MEASURED = ["row", "doc_id", "n_shingles", "node", "node2", "sketch", "bucket", "seen"]


def _heads(part: Words, size: int, percent: int, common: np.ndarray, done: set[int]) -> Iterator[tuple[np.ndarray, int, int]]:
    """Head, signature and size of each set that this task has not seen; rare shingles come first."""
    for s in _sets(part, size):
        n = len(s)
        node = _signature(s)[0] if n else None
        if n and node not in done:
            done.add(node)
            order = np.lexsort((mix(s), common[(s % np.uint64(COUNTERS)).astype(np.int64)]))
            yield s[order[:n - -(-percent * n // 100) + 1]], node, n


def _head_shingles(size: int, percent: int, seen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for part in words(batch.column("text"), lower=True):
                found = [h for h, _, _ in _heads(part, size, percent, seen.value, done)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["shingle"])
    return run


def _entries(size: int, percent: int, seen, twice: Bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for part in words(batch.column("text"), lower=True):
                rows = [[], [], [], []]
                for head, node, n in _heads(part, size, percent, seen.value, done):
                    place = np.flatnonzero(twice(head)).astype(np.int32)
                    for column, values in zip(rows, (head[place].view(np.int64), np.full(len(place), node), np.full(len(place), n, np.int32), place)):
                        column.append(values)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in rows], names=["shingle", "node", "n", "i"])
    return run


def _whole(size: int, wanted: Bitmap):
    """Sets that may be wanted, once for each task that has them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for part in words(batch.column("text"), lower=True):
                signed = [(_signature(s)[0], s) for s in _sets(part, size) if len(s)]
                asked = wanted(np.array([n for n, _ in signed], np.int64))
                found = {n: s for (n, s), a in zip(signed, asked) if a and n not in done}
                done.update(found)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([s.view(np.int64) for s in found.values()], pa.list_(pa.int64()))],
                                                 names=["node", "members"])
    return run


def _bound(x: str, y: str, percent: int) -> str:
    """SQL: entries of two sets x and y may be the first that similar sets share."""
    return (f"(1 + least({x}.n - {x}.i - 1, {y}.n - {y}.i - 1)) * {100 + percent} >= {percent} * ({x}.n + {y}.n) "
            f"AND 100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)")


def _by_sketch(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(c).to_numpy() for c in ("a", "b", "a_n", "b_n"))
            most = x + y - 2 * shared_least(x, y, percent)
            differ = [sketches_differ(p, q) for p, q in zip(batch.column("a_sketch").to_pylist(), batch.column("b_sketch").to_pylist())]
            kept = np.array(differ, np.int64) <= most
            yield pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], names=["a", "b"])
    return run


def _likely(measured: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sketches do not rule out that their sets are similar."""
    wanted = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
    known = measured.where("n_shingles > 0").select("node", "n_shingles", "sketch").join(wanted, "node", "left_semi")
    known = stored(known.dropDuplicates(["node"]), "sketches")
    a, b = (known.select(F.col("node").alias(x), F.col("n_shingles").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch")) for x in "ab")
    found = stored(in_batches(pairs.join(a, "a").join(b, "b"), _by_sketch(percent), "a bigint, b bigint"), "likely")
    _remove(pairs.sparkSession, wanted, known)
    return found


def _verified(docs: DataFrame, measured: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""
    spark = docs.sparkSession
    pairs = _likely(measured, pairs, percent)
    if not pairs.limit(1).count():
        return pairs
    wanted = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
    sets = stored(in_batches(docs, _whole(size, Bitmap(wanted)), "node bigint, members array<bigint>"), "sets")
    once = sets.join(wanted, "node", "left_semi").dropDuplicates(["node"])
    a, b = (once.select(F.col("node").alias(x), F.col("members").alias(f"{x}_set")) for x in "ab")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    found = stored(pairs.join(a, "a").withColumn("a_n", F.size("a_set")).join(b, "b").where(
        100 * shared >= percent * (F.col("a_n") + F.size("b_set") - shared)).select("a", "b"), "links")
    _remove(spark, wanted, sets, pairs)
    return found


def _remove(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        for file in t.inputFiles()[:1]:
            remove(spark, os.path.dirname(file))


def similar_groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id. `docs` has doc_id (long) and text."""
    return similar_rows(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def similar_rows(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The same with `row`, the row's monotonically increasing id in the table, and `component`, a number of its group; it is null
    for an empty set, which has no group."""
    spark = docs.sparkSession
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    measured = stored(in_batches(
        docs, _measure(size), "row bigint, doc_id bigint, n_shingles bigint, node bigint, node2 bigint, sketch binary, bucket array<int>, seen array<bigint>"), "measured")
    counts = measured.where("n_shingles < 0").select(F.explode(F.arrays_zip("bucket", "seen")).alias("z")).groupBy(
        F.col("z.bucket").alias("k")).agg(F.sum("z.seen").alias("v"))
    common = np.zeros(COUNTERS, np.int64)
    for r in counts.toLocalIterator():
        common[r.k] = r.v
    seen = spark.sparkContext.broadcast(common)
    rows = measured.where("n_shingles >= 0").select("row", "doc_id", "n_shingles", "node", "node2")
    classes = stored(rows.where("n_shingles > 0").groupBy("node", "node2").agg(F.min("doc_id").alias("doc_id")), "classes")

    twice = stored(in_batches(docs, _head_shingles(size, percent, seen), "shingle bigint").groupBy("shingle").count().where("count > 1").select("shingle"), "twice")
    entries = stored(in_batches(docs, _entries(size, percent, seen, Bitmap(twice)), "shingle bigint, node bigint, n int, i int"), "entries")
    # the same set may come from several tasks; it stands at one place of the order, one row after another
    order = Window.partitionBy("shingle").orderBy("i", "node")
    ranked = entries.withColumns({
        "k": F.dense_rank().over(order), "before": F.lag("node").over(order),
        "hub": F.first(F.struct("node", "n", "i")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    ranked = ranked.withColumn("sets", F.max("k").over(Window.partitionBy("shingle"))).where("before IS NULL OR before <> node").alias("x")
    with_hub = f"x.k > 1 AND {_bound('x', 'hub', percent)}"
    shared = stored(ranked.where(f"sets > 2 OR {with_hub}").select("shingle", "node", "n", "i", "k", "hub", "sets"), "shared")
    _remove(spark, twice, entries)
    pairs = stored(shared.alias("x").where(with_hub).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct(), "pairs")
    links = _verified(docs, measured, pairs, size, percent)

    groups = components(links)
    member = shared.where("sets > 2").select("node", "shingle", "n", "i").join(small_or_shuffled(groups), "node", "left")
    member = member.withColumn("component", F.coalesce("component", "node"))
    same = Window.partitionBy("shingle")
    left = stored(member.withColumns({"lo": F.min("component").over(same), "hi": F.max("component").over(same)}).where("lo <> hi").drop("lo", "hi"), "member")
    _remove(spark, shared)
    rest = left.alias("x").join(left.alias("y"), "shingle").where(f"x.component < y.component AND {_bound('x', 'y', percent)}")
    rest = rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    rest = stored(rest.join(pairs, ["a", "b"], "left_anti"), "pairs")
    _remove(spark, left, pairs)
    if rest.limit(1).count():
        more = _verified(docs, measured, rest, size, percent)
        if more.limit(1).count():
            groups = components(links.union(more))
    named = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(names, "component").select("node", "node2", "component", "component_id")
    return rows.join(named, ["node", "node2"], "left").select(
        "row", "doc_id", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))
