"""The trie of all prefixes of conversations, from their sorted order.

A conversation starts with the first turns of its opener (the conversation at the hundred below it) and goes on with its
own. Turns travel as 128-bit hashes and lengths; texts are read once and not shuffled. Places of turns come from `places`, so
a conversation may have any number of them. Conversations are cut into segments of `SEGMENT` turns, each with the identity of
everything before it as its root, and segments are sorted by root and turns over all partitions. `trie_forest` makes
the forest of every sorted batch: the nodes inside are complete there, and each batch hands on at most two paths of open
nodes. These are contracted to one row per node and batch, merged by node, and what lies below them is added to all
their open ancestors, which a path names.

Conversations of more than one segment are linked by their roots: what lies in the later segments of a conversation and is
not counted for another one with the same turns is a sum over its segments, added to its nodes in earlier ones.

The conversations that end at one node have to go through one checksum in order; a batch hands on their ids as one text,
and one task streams these texts of a node.

Cases: rows without conv_id belong to no conversation and are left out; null roles and texts are empty; a null turn comes
first; turns of equal number are ordered by a hash of their role and text; repeated rows are turns of their own; an opener
that is not in the table gives no turns; an empty table has no node, not even a root; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions.lineage import stored
from plantlens.llm.places import places
from plantlens.llm.trie_forest import SCHEMA, SEGMENT, Forest, Sequences

OPENERS = 100
MOST_OPENING = 6
_TURNS = "array<struct<d: bigint, xp: bigint, xq: bigint, chars: bigint>>"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place, two hashes and the length of every turn."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), *said).alias("k1"),
        F.xxhash64(F.lit(2), *said).alias("k2"), F.length(said[1]).cast("long").alias("chars"))
    return places(stored(slim, "turns"), [F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2")], "conv_id").drop("turn")


def rebuild(turns: DataFrame, openers: int = OPENERS, most_opening: int = MOST_OPENING) -> tuple[DataFrame, DataFrame]:
    """conv_id and n, the number of its turns, of every rebuilt conversation; and its turns with their depth d."""
    size = stored(turns.groupBy("conv_id").agg(F.max("place").alias("size")), "sizes")
    opener = F.col("conv_id") - F.col("conv_id") % openers
    wanted = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_opening
    of_opener = size.select(F.col("conv_id").alias("opener"), F.col("size").alias("opener_size"))
    plan = stored(size.select("conv_id", "size", opener.alias("opener"), wanted.alias("h")).join(of_opener, "opener", "left")
                  .withColumn("taken", F.least("h", F.coalesce("opener_size", F.lit(0))))
                  .select("conv_id", "opener", "h", "taken", (F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("n")), "plan")
    hashes = ["k1", "k2", "chars"]
    own = turns.join(plan.drop("opener"), "conv_id").where("place > h").select(
        "conv_id", "n", (F.col("place") - F.col("h") + F.col("taken")).alias("d"), *hashes)
    first = turns.where((F.col("conv_id") % openers == 0) & (F.col("place") < most_opening)).withColumnRenamed("conv_id", "opener")
    opening = plan.where("taken > 0").join(first, "opener").where("place <= taken").select(
        "conv_id", "n", F.col("place").alias("d"), *hashes)
    return plan.select("conv_id", "n"), own.union(opening)


def _segments(plan: DataFrame, turns: DataFrame) -> DataFrame:
    """Segments with their roots (rp, rq): conv_id, seg, last, turns."""
    identity = [F.xxhash64(F.lit(k), "d", "k1", "k2").alias(x) for k, x in ((3, "xp"), (4, "xq"))]
    cut = (turns.select("conv_id", "n", "d", "chars", *identity).groupBy("conv_id", F.expr(f"(d - 1) div {SEGMENT}").alias("seg"))
           .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("d", "xp", "xq", "chars"))).alias("turns"),
                F.bit_xor("xp").alias("sp"), F.bit_xor("xq").alias("sq")))
    silent = plan.where("n = 0").select("conv_id", F.lit(0).cast("long").alias("seg"), "n", F.array().cast(_TURNS).alias("turns"),
                                        F.lit(0).cast("long").alias("sp"), F.lit(0).cast("long").alias("sq"))
    cut = stored(cut.union(silent).withColumn("last", F.col("n") <= (F.col("seg") + 1) * SEGMENT), "segments")
    single = (F.col("seg") == 0) & F.col("last")
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    roots = [F.coalesce(F.bit_xor(x).over(before), F.lit(0)) for x in ("sp", "sq")]
    columns = ["conv_id", "seg", "last", "turns"]
    # the window runs over the segments of long conversations without their turns
    long = cut.where(~single)
    rooted = long.select("conv_id", "seg", roots[0].alias("rp"), roots[1].alias("rq"))
    zero = F.lit(0).cast("long")
    return cut.where(single).select(*columns, zero.alias("rp"), zero.alias("rq")).union(
        long.join(rooted, ["conv_id", "seg"]).select(*columns, "rp", "rq"))


def _forests(segments: DataFrame) -> DataFrame:
    """The nodes of the forests of all sorted batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield Forest(Sequences.of(batch)).batch()

    by = ["seg", "rp", "rq", "turns", "conv_id"]
    return segments.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, SCHEMA)


def _checksums(texts: DataFrame) -> DataFrame:
    """p, q, sha: the checksum of a node's texts in the order of their first ids, one after another through one state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for p, q, text in zip(*(batch.column(c).to_pylist() for c in ("p", "q", "ends"))):
                if (p, q) == key:
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (p, q), sha256()
                state.update(text.encode())
            if done:
                yield _rows(done)
                done = []
        if key:
            yield _rows([(*key, state.hexdigest())])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], ["p", "q", "sha"])

    return (texts.where("ends <> ''").select("p", "q", "first_end", "ends").repartition("p", "q")
            .sortWithinPartitions("p", "q", "first_end").mapInArrow(run, "p long, q long, sha string"))


def _own_value() -> Column:
    return (F.col("n_convs") - 1) * F.col("chars")


def _starts_segment() -> Column:
    """Whether a node is the first of a later segment, whose parent belongs to the segment before."""
    return (F.col("depth") > SEGMENT) & ((F.col("depth") - 1) % SEGMENT == 0)


def _merged(open_nodes: DataFrame) -> DataFrame:
    """One complete row for every open node, but for its parent's conv_id."""
    one = stored(open_nodes.groupBy("p", "q").agg(
        *[F.first(c).alias(c) for c in ("pp", "pq", "seg", "depth", "chars", "path_p", "path_q")],
        F.min("conv_id").alias("conv_id"), F.bool_or("more").alias("more"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]), "open")
    children = one.where(F.col("pp").isNotNull() & ~_starts_segment()).groupBy(F.col("pp").alias("p"), F.col("pq").alias("q")).agg(F.count("*").alias("open_children"))
    counted = one.join(children, ["p", "q"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)))
    leaf = F.when((F.col("n_children") == 0) & ~F.col("more"), 1).otherwise(0)
    counted = stored(counted.withColumn("add_leaves", F.col("n_leaves") + leaf).withColumn("add_saved", F.col("saved_tokens") + _own_value()), "open")
    below = (counted.select(F.explode(F.arrays_zip("path_p", "path_q")).alias("up"), "add_leaves", "add_saved")
             .groupBy(F.col("up.path_p").alias("p"), F.col("up.path_q").alias("q"))
             .agg(F.sum("add_leaves").alias("n_leaves"), F.sum("add_saved").alias("saved_tokens")))
    empty = sha256(b"").hexdigest()
    return (counted.drop("n_leaves", "saved_tokens").join(below, ["p", "q"]).join(_checksums(open_nodes), ["p", "q"], "left")
            .withColumn("ends_sha256", F.coalesce("sha", F.lit(empty))).withColumn("parent_conv_id", F.lit(None).cast("long")))


def _with_parents(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Fill in parent_conv_id where it is null, from the nodes named by (pp, pq)."""
    named = parents.select(F.col("p").alias("pp"), F.col("q").alias("pq"), F.col("conv_id").alias("found"))
    return nodes.join(named, ["pp", "pq"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found")).drop("found")


def _paths(segments: DataFrame) -> DataFrame:
    """p, q, below_leaves, below_saved: a row for every node on the way through each segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Sequences.of(batch)
            ids, rows = [], []
            for i in range(len(s.conv)):
                for d in range(0 if s.seg[i] == 0 else 1, s.offsets[i + 1] - s.offsets[i] + 1):
                    ids.append(s.node(i, d))
                    rows.append(i)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in ids], pa.int64()), pa.array([x for _, x in ids], pa.int64()),
                 *[batch.column(c).take(take) for c in ("below_leaves", "below_saved")]], ["p", "q", "below_leaves", "below_saved"])

    return segments.mapInArrow(run, "p long, q long, below_leaves long, below_saved long")


def _linked(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """Nodes of conversations with several segments, linked from one segment to the next."""
    joint = F.col("depth") % SEGMENT == 0
    children = nodes.where(_starts_segment()).groupBy(F.col("pp").alias("p"), F.col("pq").alias("q")).agg(F.count("*").alias("next_children"))
    nodes = stored(nodes.join(children, ["p", "q"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("next_children", F.lit(0)))
                   .drop("next_children"), "nodes")
    own = nodes.where("seg > 0").groupBy("conv_id", "seg").agg(
        F.sum(_own_value()).alias("own_saved"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("own_leaves"))
    after = Window.partitionBy("conv_id").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    long = segments.where((F.col("seg") > 0) | ~F.col("last"))
    below = (long.select("conv_id", "seg").join(own, ["conv_id", "seg"], "left").fillna(0, ["own_saved", "own_leaves"])
             .select("conv_id", "seg", F.sum("own_leaves").over(after).alias("below_leaves"), F.sum("own_saved").over(after).alias("below_saved"))
             .where("below_leaves <> 0 OR below_saved <> 0"))
    more = _paths(long.join(below, ["conv_id", "seg"])).groupBy("p", "q").agg(
        F.sum("below_leaves").alias("below_leaves"), F.sum("below_saved").alias("below_saved"))
    nodes = (nodes.join(more, ["p", "q"], "left").withColumn("n_leaves", F.col("n_leaves") + F.coalesce("below_leaves", F.lit(0)))
             .withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("below_saved", F.lit(0))))
    return _with_parents(nodes, nodes.where(joint & (F.col("depth") > 0)))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of rebuilt conversations: the columns of `NODE`."""
    plan, turns = rebuild(_turns(conversations))
    segments = stored(_segments(plan, turns), "rooted")
    forests = stored(_forests(segments), "forests")
    inner = ["p", "q", "pp", "pq", "seg", "chars", *NODE]
    merged = stored(_merged(forests.where("open")), "merged")
    # a node's parent is known in its batch unless it is open
    known = forests.where("NOT open AND (parent_conv_id IS NOT NULL)").select(*inner)
    rest = forests.where("NOT open AND parent_conv_id IS NULL").select(*inner).union(merged.select(*inner))
    nodes = known.union(_with_parents(rest, merged).select(*inner))
    if segments.where("seg > 0").limit(1).count():
        nodes = _linked(nodes, segments)
    return nodes.select(*NODE)
