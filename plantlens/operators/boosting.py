"""Gradient boosting with trees that grow leaf by leaf, from histograms of gradients.

Features are cut into at most `MOST_BINS` bins once. Rows with the same bins meet the same leaf of every tree and so keep the same
score: they are one cell, with its number of rows and the sum of their labels (or rows of each class), from which the sums of their
gradients and second derivatives follow. Cells that fit into `TASK_BYTES` are boosted inside one task. More are cut over many: every
pass sends the open trees to the tasks and brings back sums of gradients, of second derivatives and of rows for each bin of each slot
of the leaves that are to be split, added up by a shuffle, so that the driver gets one histogram for each open leaf, of the
bins in use, and nothing that grows with the rows or their partitions. Of two siblings the smaller one is counted, the other is the
difference to their parent.

Leaves are split best first. Whether a leaf is worth a split does not depend on other leaves, so a pass looks into all leaves
that the best-first order would split as far as it is known, and the order is replayed over what has been found, until it
meets no leaf without a histogram. The tree is the one that a pass for each split would give, in as many passes as it is
deep. The trees of all classes of a soft-max model grow in the same passes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions.lineage import stored
from plantlens.operators.identity import DataError

MOST_BINS = 255
# Histograms that the driver and a task may hold at a time.
HISTOGRAM_BYTES = 512 << 20
# Smallest leaf in rows and in second derivatives.
LEAST_ROWS, LEAST_HESSIAN = 20, 1e-3
# Arrays of the cells that one task may hold, and bins that a task gathers before it looks for equal rows.
TASK_BYTES, _GATHERED_BYTES = 256 << 20, 8 << 20
# The passes store their cells again after so many rounds, so that a lost task repeats no more of them.
_REFRESH = 20
_WIDTH = MOST_BINS + 1
# Cells of a histogram that go through a shuffle as one value.
_CHUNK = 16_384


@dataclass(frozen=True)
class Tree:
    """Nodes in the order of their splits; a leaf has no slot (-1). Rows with a value of at most the threshold go left."""

    slot: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray

    def walk(self, go_left) -> np.ndarray:
        """Node of each row; `go_left(slots, nodes, rows)` tells which rows go left."""
        at = None
        while True:
            if at is None:
                at = go_left(None, None, None)
            moving = np.flatnonzero(self.slot[at] >= 0)
            if not len(moving):
                return at
            nodes = at[moving]
            at[moving] = np.where(go_left(self.slot[nodes], nodes, moving), self.left[nodes], self.right[nodes])

    def leaves_of_bins(self, bins: np.ndarray) -> np.ndarray:
        """Node of each column of a (slots, rows) table of bins."""
        return self.walk(lambda slots, nodes, rows: np.zeros(bins.shape[1], np.int64) if slots is None else bins[slots, rows] <= self.bin[nodes])

    def leaves_of_values(self, x: np.ndarray) -> np.ndarray:
        """Node of each row of a (rows, slots) table of values."""
        return self.walk(lambda slots, nodes, rows: np.zeros(len(x), np.int64) if slots is None else x[rows, slots] <= self.threshold[nodes])


@dataclass(frozen=True)
class Boosting:
    """Fitted rounds of one tree for each score."""

    loss: str
    start: np.ndarray
    rounds: tuple[tuple[Tree, ...], ...]
    n_slots: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """(rows, scores) of a (rows, slots) table of values."""
        out = np.repeat(self.start[:, None], len(x), axis=1)
        at = self._exits.places(x)
        for trees, tables in zip(self.rounds, self._exits.rounds):
            for k, (tree, table) in enumerate(zip(trees, tables)):
                out[k] += tree.value[tree.leaves_of_values(x)] if table is None else _Exits.values(table, at)
        return out.T

    @cached_property
    def _exits(self) -> _Exits:
        return _Exits(self)

    def scores(self, vector: Column) -> Column:
        """Value, or probability of each class, as an array."""
        model = self

        @F.arrow_udf("array<double>")
        def score(x: pa.Array) -> pa.Array:
            found = probabilities(model.loss, model.raw(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), model.n_slots)).T)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(found), pa.int32()), pa.array(np.ascontiguousarray(found.T).ravel()))

        return score(vector_to_array(vector))

    def importances(self) -> np.ndarray:
        """Share of each slot in the gains of all splits."""
        total = np.zeros(self.n_slots)
        for trees in self.rounds:
            for tree in trees:
                inner = tree.slot >= 0
                np.add.at(total, tree.slot[inner], tree.gain[inner])
        return total / total.sum() if total.sum() > 0 else total

    def told(self) -> dict:
        names = Tree.__dataclass_fields__
        return {"loss": self.loss, "start": self.start.tolist(), "n_slots": self.n_slots,
                "rounds": [[{n: getattr(t, n).tolist() for n in names} for t in trees] for trees in self.rounds]}

    @classmethod
    def read(cls, told: Mapping) -> Boosting:
        kinds = {"threshold": float, "value": float, "gain": float}
        rounds = tuple(tuple(Tree(**{n: np.array(v, kinds.get(n, np.int64)) for n, v in t.items()}) for t in trees) for trees in told["rounds"])
        return cls(told["loss"], np.array(told["start"], float), rounds, told["n_slots"])


class _Exits:
    """Values of small trees without a walk. The leaves of a tree are bits from left to right; each slot takes away those that the
    row's value rules out, and the lowest bit that is left is the row's leaf."""

    MOST_NODES = 127
    _MAGIC = np.uint64(0x03F79D71B4CB0A89)

    def __init__(self, model: Boosting) -> None:
        trees = [t for trees in model.rounds for t in trees]
        slots, thresholds = (np.concatenate([getattr(t, n) for t in trees] or [np.zeros(0)]) for n in ("slot", "threshold"))
        self.thresholds = [np.unique(thresholds[slots == j]) for j in range(model.n_slots)]
        self.rounds = [[self._tables(t) if 1 < len(t.slot) <= self.MOST_NODES else None for t in trees] for trees in model.rounds]

    def places(self, x: np.ndarray) -> list[np.ndarray | None]:
        """Number of a slot's thresholds under each value; NaN is over all of them and goes right."""
        return [np.searchsorted(t, x[:, j], side="left") if len(t) else None for j, t in enumerate(self.thresholds)]

    def _tables(self, tree: Tree) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """Leaves that are left for each place in a slot, and the values of the leaves by their bits."""
        spans, leaves = np.zeros((len(tree.slot), 2), int), []
        waiting = [(0, False)]
        while waiting:
            node, seen = waiting.pop()
            if seen:
                spans[node] = spans[tree.left[node]][0], spans[tree.right[node]][1]
            elif tree.slot[node] < 0:
                spans[node] = len(leaves), len(leaves) + 1
                leaves.append(tree.value[node])
            else:
                waiting += [(node, True), (int(tree.right[node]), False), (int(tree.left[node]), False)]
        left = []
        for j in np.unique(tree.slot[tree.slot >= 0]):
            table = np.full(len(self.thresholds[j]) + 1, (1 << len(leaves)) - 1, np.uint64)
            for node in np.flatnonzero(tree.slot == j):
                lo, hi = (int(v) for v in spans[tree.left[node]])
                table[np.searchsorted(self.thresholds[j], tree.threshold[node]) + 1:] &= np.uint64((1 << 64) - 1 - ((1 << hi) - (1 << lo)))
            left.append((int(j), table))
        value = np.zeros(64)
        value[[((1 << b) * int(self._MAGIC) % (1 << 64)) >> 58 for b in range(len(leaves))]] = leaves
        return left, value

    @staticmethod
    def values(tables: tuple[list[tuple[int, np.ndarray]], np.ndarray], at: Sequence[np.ndarray | None]) -> np.ndarray:
        left = None
        for j, table in tables[0]:
            mine = table.take(at[j])
            left = mine if left is None else np.bitwise_and(left, mine, out=left)
        low = left & (~left + np.uint64(1))
        low *= _Exits._MAGIC
        low >>= np.uint64(58)
        return tables[1].take(low.view(np.int64))


def probabilities(loss: str, raw: np.ndarray) -> np.ndarray:
    """(scores, rows) to values or probabilities of the classes."""
    if loss == "squares":
        return raw
    if loss == "logistic":
        p = 1.0 / (1.0 + np.exp(-raw[0]))
        return np.stack([1.0 - p, p])
    e = np.exp(raw - raw.max(axis=0))
    return e / e.sum(axis=0)


def _derivatives(loss: str, raw: np.ndarray, n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the rows of each cell, which share their score: `sums` are those of the labels, or the rows of each class."""
    if loss == "squares":
        return raw * n - sums, n[None, :]
    p = probabilities(loss, raw)
    if loss == "logistic":
        return (p[1] * n - sums[0])[None, :], (p[1] * p[0] * n)[None, :]
    k = len(raw)
    return p * n - sums, k / (k - 1) * p * (1 - p) * n


def _value_counts(rows: DataFrame, vector: str, n_slots: int) -> DataFrame:
    """slot, x and n for every distinct value; a batch counts its own rows first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, n_slots)
            for j in range(n_slots):
                values, counts = np.unique(x[:, j], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), j, np.int32)), pa.array(values), pa.array(counts)], ["slot", "x", "n"])

    found = rows.select(vector_to_array(vector).alias("x")).mapInArrow(run, "slot int, x double, n bigint")
    return found.groupBy("slot", "x").agg(F.sum("n").alias("n"))


def bin_edges(rows: DataFrame, vector: str, n_rows: int, n_slots: int) -> list[np.ndarray]:
    """Borders between bins for each slot: between all neighbouring values, or between quantiles where these are too many.

    All rows count. Distinct values are put in order in ranges, with running counts inside a range and before it, so that
    the driver gets the borders alone, at most 254 a slot.
    """
    counts = stored(_value_counts(rows, vector, n_slots), "values")
    ranged = stored(counts.repartitionByRange("slot", "x").withColumn("part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("part", "slot").orderBy("x")
    before = Window.partitionBy("slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("slot").orderBy("part")
    whole = Window.partitionBy("slot")
    # a row for each range of each slot
    parts = ranged.groupBy("part", "slot").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"), F.min("x").alias("_first")).select(
        "part", "slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("values_before"),
        F.lead("_first").over(later).alias("next_first"), F.sum("_k").over(whole).alias("all_values"))
    upto = F.col("rows_before") + F.sum("n").over(inside)
    share = lambda seen: seen.cast("double") / F.lit(float(n_rows)) * F.lit(float(MOST_BINS))
    data = ranged.join(F.broadcast(parts), ["part", "slot"]).select(
        "slot", "x", F.coalesce(F.lead("x").over(inside), F.col("next_first")).alias("after"), (F.col("all_values") - 1 - F.col("values_before") - F.row_number().over(inside)).alias("left"),
        "all_values", share(upto).alias("share"), share(upto - F.col("n")).alias("share_before"))
    # a value closes a bin where the share of rows up to it reaches a whole number; the one before the last does it in its place
    reaches = (F.floor("share") > F.floor("share_before")) & (F.col("share_before") < F.lit(float(MOST_BINS - 1)))
    instead = (F.col("left") == 0) & (F.col("share") < F.lit(float(MOST_BINS - 1)))
    chosen = data.where((F.col("left") >= 0) & ((F.col("all_values") <= MOST_BINS) | reaches | instead))
    edges = chosen.select("slot", "x", ((F.col("x") + F.col("after")) / 2).alias("edge")).toArrow()
    slot, x, edge = (edges.column(c).to_numpy() for c in ("slot", "x", "edge"))
    order = np.lexsort((x, slot))
    ends = np.searchsorted(slot[order], np.arange(n_slots + 1))
    return [edge[order][lo:hi] for lo, hi in zip(ends[:-1], ends[1:])]


def _cells(rows: DataFrame, vector: str, label: str, edges: list[np.ndarray], loss: str, n_scores: int, unit: int) -> DataFrame:
    """bins, n and whole-numbered sums s0, s1 .. of the rows with the same bins.

    The sums do not depend on the order of rows: classes are counted, and labels added up in two parts, multiples of 2^-unit and
    the rest in multiples of 2^-36 of that.
    """
    n_slots = len(edges)
    n_sums = n_scores if loss == "softmax" else 1 if loss == "logistic" else 2
    names = [f"s{i}" for i in range(n_sums)]

    def tell(bins: list[np.ndarray], labels: list[np.ndarray]) -> pa.RecordBatch:
        b, y = np.concatenate(bins), np.concatenate(labels)
        packed = np.zeros((len(b), -(-n_slots // 8) * 8), np.uint8)
        packed[:, :n_slots] = b
        words = packed.view(np.uint64)
        order = np.lexsort(words.T)
        words = words[order]
        first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)]))
        if loss == "squares":
            whole = np.floor(np.ldexp(y, unit))
            parts = [whole, np.rint(np.ldexp(np.ldexp(y, unit) - whole, 36))]
        else:
            parts = [y == k for k in range(n_scores)] if loss == "softmax" else [y]
        sums = [np.add.reduceat(v.astype(np.int64)[order], first) for v in parts]
        cells = np.ascontiguousarray(b[order[first]]).tobytes()
        keys = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.arange(len(first) + 1) * n_slots).astype(np.int32)), pa.py_buffer(cells)])
        return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(np.append(first, len(b)))), *map(pa.array, sums)], ["bins", "n", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, labels, held = [], [], 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, n_slots)
                bins.append(np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8))
                labels.append(batch.column("y").to_numpy().astype(float))
                held += batch.num_rows * (n_slots + 8)
            if held > _GATHERED_BYTES:
                yield tell(bins, labels)
                bins, labels, held = [], [], 0
        if held:
            yield tell(bins, labels)

    slim = rows.select(vector_to_array(vector).alias("x"), F.col(label).cast("double").alias("y"))
    found = slim.mapInArrow(run, f"bins binary, n bigint, {', '.join(f'{c} bigint' for c in names)}")
    return stored(found.groupBy("bins").agg(*[F.sum(c).alias(c) for c in ("n", *names)]), "cells")


def _arrays(batch: pa.RecordBatch | pa.Table, n_slots: int, loss: str, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, cells) bins, rows and (sums, cells) of the labels."""
    column = batch.column("bins")
    chunks = [c.cast(pa.binary(n_slots)) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]
    bins = np.concatenate([np.frombuffer(c.buffers()[1], np.uint8)[c.offset * n_slots:(c.offset + len(c)) * n_slots] for c in chunks]).reshape(-1, n_slots)
    sums = np.stack([batch.column(c).to_numpy() for c in batch.schema.names[2:]]).astype(float)
    if loss == "squares":
        sums = np.ldexp(sums[:1] + np.ldexp(sums[1:], -36), -unit)
    return np.ascontiguousarray(bins.T), batch.column("n").to_numpy().astype(float), sums


@dataclass
class _Node:
    """A node while its tree grows: its histogram while it may be split, its best split, and its children's numbers."""

    sums: np.ndarray
    histogram: np.ndarray | None = None
    gain: float = 0.0
    slot: int = -1
    bin: int = -1
    children: tuple[int, int] | None = None


@dataclass
class _Growing:
    """A tree that is growing, with every node that was looked into."""

    nodes: list[_Node] = field(default_factory=list)

    def as_tree(self) -> Tree:
        """All nodes so far, to route rows; a node waits for its histogram as a leaf."""
        split = [n.children is not None for n in self.nodes]
        pick = lambda f, other: np.array([f(n) if s else other for n, s in zip(self.nodes, split)], np.int64)
        zero = np.zeros(len(self.nodes))
        return Tree(pick(lambda n: n.slot, -1), pick(lambda n: n.bin, -1), zero, pick(lambda n: n.children and n.children[0], -1),
                    pick(lambda n: n.children and n.children[1], -1), zero, zero, zero)

    def order(self, n_leaves: int) -> tuple[list[int], list[int]]:
        """Replay the best-first order: nodes it splits, and those of them that have no children yet."""
        queue, split, unseen = [(-self.nodes[0].gain, 0)], [], []
        while queue and len(split) + 1 < n_leaves:
            gain, at = heapq.heappop(queue)
            if gain >= 0:
                break
            split.append(at)
            if self.nodes[at].children is None:
                unseen.append(at)
            else:
                for c in self.nodes[at].children:
                    heapq.heappush(queue, (-self.nodes[c].gain, c))
        return split, unseen


def _best_split(h: np.ndarray, sums: np.ndarray, n_edges: np.ndarray, least_rows: int) -> tuple[float, int, int]:
    """Gain, slot and bin of the best split of a (3, slots, bins) histogram; the first of equal ones."""
    left = np.cumsum(h, axis=2)
    right = sums[:, None, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - sums[0] ** 2 / sums[1]
    ok = ((left[2] >= least_rows) & (right[2] >= least_rows) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
          & (np.arange(h.shape[2])[None, :] < n_edges[:, None]))
    gain = np.where(ok & np.isfinite(gain), gain, 0.0)
    at = int(np.argmax(gain))
    slot, b = divmod(at, h.shape[2])
    return float(gain[slot, b]), slot, b


_Cut = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class _Pass:
    """Histograms of chosen nodes of the growing trees over a partition, in numbered pieces of _CHUNK cells."""

    def __init__(self, loss: str, trees: Sequence[Tree], wanted: Sequence[Sequence[int]], starts: np.ndarray) -> None:
        self.loss, self.trees, self.wanted, self.starts = loss, trees, wanted, starts

    def __call__(self, part: int, blocks: Iterator[_Cut]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        n_nodes = sum(map(len, self.wanted))
        total = np.zeros((n_nodes, 3, self.starts[-1]))
        for bins, n, sums, raw in blocks:
            g, h = _derivatives(self.loss, raw, n, sums)
            ahead = 0
            for k, (tree, wanted) in enumerate(zip(self.trees, self.wanted)):
                place = tree.leaves_of_bins(bins)
                for at in wanted:
                    _count(total[ahead], bins, np.flatnonzero(place == at), g[k], h[k], n, self.starts)
                    ahead += 1
        flat = total.ravel()
        for c, lo in enumerate(range(0, len(flat), _CHUNK)):
            yield c, (part, flat[lo:lo + _CHUNK])


def _count(total: np.ndarray, bins: np.ndarray, mine: np.ndarray | None, g: np.ndarray, h: np.ndarray, n: np.ndarray, starts: np.ndarray) -> None:
    """Add the sums of some cells, or all of them, for each bin in use."""
    same = h is n or h.base is n
    if mine is not None:
        g, h, n = g[mine], h[mine], n[mine]
    for j, (lo, hi) in enumerate(zip(starts[:-1], starts[1:])):
        b = bins[j] if mine is None else bins[j, mine]
        total[0, lo:hi] += np.bincount(b, g, hi - lo)
        rows = np.bincount(b, n, hi - lo)
        total[1, lo:hi] += rows if same else np.bincount(b, h, hi - lo)
        total[2, lo:hi] += rows


def _in_order(parts: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sums in the order of the partitions, so that reruns agree."""
    return reduce(np.add, [a for _, a in sorted(parts, key=lambda p: p[0])])


_Histograms = Callable[[Sequence[_Growing], Sequence[Sequence[int]]], np.ndarray]


def _by_slot(sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(nodes, 3, slots, bins) of the (nodes, 3, bins in use) sums."""
    out = np.zeros((len(sums), 3, len(starts) - 1, _WIDTH))
    for j, (lo, hi) in enumerate(zip(starts[:-1], starts[1:])):
        out[:, :, j, :hi - lo] = sums[:, :, lo:hi]
    return out


def _grow(histograms: _Histograms, n_scores: int, n_edges: np.ndarray, n_leaves: int, least_rows: int) -> list[_Growing]:
    """The trees of one round."""
    def look_into(tree: _Growing, at: int, histogram: np.ndarray) -> None:
        node = tree.nodes[at]
        node.histogram = histogram
        node.gain, node.slot, node.bin = _best_split(histogram, node.sums, n_edges, least_rows)

    growing = [_Growing([_Node(np.zeros(3))]) for _ in range(n_scores)]
    for tree, h in zip(growing, histograms(growing, [[0]] * n_scores)):
        tree.nodes[0].sums = h[:, 0].sum(axis=1)
        look_into(tree, 0, h)
    while True:
        small: list[list[int]] = []
        for tree in growing:
            picked = []
            for at in tree.order(n_leaves)[1]:
                node = tree.nodes[at]
                left = node.histogram[:, node.slot, :node.bin + 1].sum(axis=1)
                node.children = (len(tree.nodes), len(tree.nodes) + 1)
                tree.nodes += [_Node(left), _Node(node.sums - left)]
                picked.append(min(node.children, key=lambda c: tree.nodes[c].sums[2]))
            small.append(picked)
        if not any(small):
            return growing
        found = iter(histograms(growing, small))
        for tree, picked in zip(growing, small):
            parents = {c: n for n in tree.nodes if n.children for c in n.children}
            for at in picked:
                parent = parents[at]
                other = sum(parent.children) - at
                h = next(found)
                look_into(tree, other, parent.histogram - h)
                look_into(tree, at, h)
                parent.histogram = None


def _cut_to(tree: _Growing, edges: list[np.ndarray], n_leaves: int, rate: float) -> Tree:
    """The nodes of the best-first order."""
    chosen = set(tree.order(n_leaves)[0])
    keep, at = [0], 0
    while at < len(keep):
        if keep[at] in chosen:
            keep += tree.nodes[keep[at]].children
        at += 1
    number = {old: new for new, old in enumerate(keep)}
    rows = []
    for old in keep:
        n, inner = tree.nodes[old], old in chosen
        left, right = (number[c] for c in n.children) if inner else (-1, -1)
        value = -rate * n.sums[0] / n.sums[1] if n.sums[1] > 0 else 0.0
        rows.append((n.slot if inner else -1, n.bin if inner else -1, edges[n.slot][n.bin] if inner else 0.0, left, right,
                     value, n.gain if inner else 0.0, int(n.sums[2])))
    kinds = (np.int64, np.int64, float, np.int64, np.int64, float, float, np.int64)
    return Tree(*(np.array(c, k) for c, k in zip(zip(*rows), kinds)))


@dataclass(frozen=True)
class _Plan:
    """What a fit needs besides its cells."""

    loss: str
    start: np.ndarray
    edges: list[np.ndarray]
    unit: int
    n_estimators: int
    learning_rate: float
    num_leaves: int
    least_rows: int

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])])

    def trees(self, histograms: _Histograms) -> tuple[list[_Growing], tuple[Tree, ...]] | None:
        """The trees of the next round; None where no leaf can be split any more."""
        grown = _grow(histograms, len(self.start), np.array([len(e) for e in self.edges]), self.num_leaves, self.least_rows)
        trees = tuple(_cut_to(t, self.edges, self.num_leaves, self.learning_rate) for t in grown)
        return None if all(len(t.slot) == 1 for t in trees) else (grown, trees)


def _in_task(plan: _Plan, cells: pa.Table) -> list[tuple[Tree, ...]]:
    """All rounds over cells that one task holds. Each node keeps its cells, so that a child looks at those of its parent only."""
    bins, n, sums = _arrays(cells, len(plan.edges), plan.loss, plan.unit)
    starts, done = plan.starts, []
    raw = np.repeat(plan.start[:, None], len(n), axis=1)
    for _ in range(plan.n_estimators):
        g, h = _derivatives(plan.loss, raw, n, sums)
        held: list[dict[int, np.ndarray | None]] = [{0: None} for _ in plan.start]

        def histograms(trees, wanted):
            out = np.zeros((sum(map(len, wanted)), 3, starts[-1]))
            ahead = 0
            for k, (tree, picked) in enumerate(zip(trees, wanted)):
                parents = {c: at for at, node in enumerate(tree.nodes) if node.children for c in node.children}
                for at in picked:
                    if at:
                        node = tree.nodes[parents[at]]
                        mine = held[k].pop(parents[at])
                        left = (bins[node.slot] if mine is None else bins[node.slot, mine]) <= node.bin
                        for c, side in zip(node.children, (left, ~left)):
                            held[k][c] = np.flatnonzero(side) if mine is None else mine[side]
                    _count(out[ahead], bins, held[k][at], g[k], h[k], n, starts)
                    ahead += 1
            return _by_slot(out, starts)

        found = plan.trees(histograms)
        if found is None:
            break
        for k, tree in enumerate(found[1]):
            raw[k] += tree.value[tree.leaves_of_bins(bins)] if len(tree.slot) == 1 else _spread(found[0][k], plan, tree, held[k], len(n))
        done.append(found[1])
    return done


def _spread(grown: _Growing, plan: _Plan, tree: Tree, held: dict[int, np.ndarray | None], n_cells: int) -> np.ndarray:
    """Value of the tree for each cell, from the cells of the nodes that it grew from."""
    out = np.zeros(n_cells)
    waiting = [(0, 0)]
    while waiting:
        old, new = waiting.pop()
        children = grown.nodes[old].children
        if tree.slot[new] >= 0:
            waiting += zip(children, (int(tree.left[new]), int(tree.right[new])))
            continue
        # nodes that were looked into and not split in the end have their cells further down
        under = [old]
        while under:
            at = under.pop()
            if at in held:
                out[held[at]] = tree.value[new]
            else:
                under += grown.nodes[at].children
    return out


def _in_passes(plan: _Plan, cells: DataFrame, n_slots: int) -> list[tuple[Tree, ...]]:
    """All rounds over cells in many tasks; each round's scores are kept with the cells."""
    n_scores, starts, done = len(plan.start), plan.starts, []

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b, n, sums = _arrays(batch, n_slots, plan.loss, plan.unit)
                yield _packed([(b, n, sums, np.repeat(plan.start[:, None], len(n), axis=1))])

    def unpack(row: tuple[bytes, ...]) -> _Cut:
        n = np.frombuffer(row[1], float)
        bins, sums, raw = (np.frombuffer(row[i], t).reshape(-1, len(n)) for i, t in ((0, np.uint8), (2, float), (3, float)))
        return bins, n, sums, raw

    def moved(trees: tuple[Tree, ...]) -> Callable[[_Cut], _Cut]:
        return lambda c: (*c[:3], c[3] + np.stack([t.value[t.leaves_of_bins(c[0])] for t in trees]))

    names = "bins binary, n binary, sums binary, raw binary"
    kept = stored(cells.sortWithinPartitions("bins").mapInArrow(pack, names), "blocks")
    data = kept.rdd.map(lambda r: unpack(tuple(r))).persist(StorageLevel.MEMORY_AND_DISK)
    last = None
    for i in range(plan.n_estimators):
        here = data

        def histograms(trees, wanted):
            run = _Pass(plan.loss, [t.as_tree() for t in trees], wanted, starts)
            n_chunks = -(-3 * sum(map(len, wanted)) * int(starts[-1]) // _CHUNK)
            pieces = here.mapPartitionsWithIndex(run).groupByKey(min(here.getNumPartitions(), n_chunks)).mapValues(_in_order).collect()
            return _by_slot(np.concatenate([a for _, a in sorted(pieces, key=lambda p: p[0])]).reshape(-1, 3, starts[-1]), starts)

        found = plan.trees(histograms)
        if last is not None:
            last.unpersist()
        if found is None:
            break
        done.append(found[1])
        last, data = data, data.map(moved(found[1]))
        if (i + 1) % _REFRESH == 0:
            data = stored(data.map(lambda c: tuple(bytearray(v.tobytes()) for v in c)).toDF(names), "blocks").rdd.map(lambda r: unpack(tuple(r)))
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    for rdd in (last, data):
        if rdd is not None:
            rdd.unpersist()
    return done


def _packed(cuts: Sequence[_Cut]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in c], pa.binary()) for c in zip(*cuts)], ["bins", "n", "sums", "raw"])


def fit_boosting(rows: DataFrame, vector: str, label: str, n_classes: int = 0, n_estimators: int = 300, learning_rate: float = 0.05,
                 num_leaves: int = 31, least_rows: int = LEAST_ROWS) -> Boosting:
    """Fit to a vector column and a label: a number (`n_classes` 0), or the number of a class."""
    loss = "squares" if not n_classes else "logistic" if n_classes == 2 else "softmax"
    n_scores = n_classes if loss == "softmax" else 1
    rows = rows.filter(F.col(label).isNotNull())
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean"), F.max(F.size(vector_to_array(vector))).alias("width"), F.max(F.abs(label)).alias("most"),
        *[F.avg((F.col(label) == k).cast("double")).alias(f"p{k}") for k in range(n_classes)]).first()
    if not facts["n"]:
        raise DataError("boosting needs rows with a label")
    n_slots, num_leaves = facts["width"], max(2, int(num_leaves))
    if n_slots * _WIDTH * 24 * (num_leaves + 1) * n_scores > HISTOGRAM_BYTES:
        raise DataError("histograms of so many slots, leaves and classes are larger than HISTOGRAM_BYTES")
    share = [max(facts[f"p{k}"], 1e-15) for k in range(n_classes)]
    start = np.array([facts["mean"]] if loss == "squares" else [np.log(share[1] / share[0])] if loss == "logistic" else np.log(share))
    edges = bin_edges(rows, vector, facts["n"], n_slots)
    # the whole parts of all labels add up within 62 bits
    unit = 62 - math.frexp(max(facts["most"], 1e-300) * facts["n"])[1]
    plan = _Plan(loss, start, edges, unit, int(n_estimators), learning_rate, num_leaves, least_rows)
    cells = _cells(rows, vector, label, edges, loss, n_scores, unit)
    # bins, rows, sums, scores, derivatives and the cells of the open nodes, some of them twice for a while
    if cells.count() * (2 * n_slots + 8 * (6 + 8 * n_scores)) > TASK_BYTES:
        done = _in_passes(plan, cells, n_slots)
    else:
        kinds = {n: np.float64 if n in ("threshold", "value", "gain") else np.int64 for n in Tree.__dataclass_fields__}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            for trees in _in_task(plan, pa.Table.from_batches(held)) if held else ():
                yield pa.RecordBatch.from_arrays([pa.array([getattr(t, n) for t in trees]) for n in kinds], list(kinds))

        ddl = ", ".join(f"{n} array<{'double' if k is np.float64 else 'bigint'}>" for n, k in kinds.items())
        grown = cells.coalesce(1).sortWithinPartitions("bins").mapInArrow(run, ddl)
        found = [Tree(*row) for row in grown.rdd.map(lambda r: tuple(np.array(v, k) for v, k in zip(r, kinds.values()))).collect()]
        done = [tuple(found[i:i + n_scores]) for i in range(0, len(found), n_scores)]
    return Boosting(loss, start, tuple(done), n_slots)
