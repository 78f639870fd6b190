"""Encoding into pieces of a public vocabulary, the N best segmentations, and decoding.

A text gets a space in front and spaces become the mark U+2581; a segmentation is a path over the lattice of pieces. A
character that is no piece is a run of byte pieces. The vocabulary file is a merge list whose scores are minus the ranks;
they become log-probabilities -ln(rank + 2), so that the rank plays the part of a Zipf rank, bytes costing -ln(size),
in whole millionths.

No piece has a character before a mark, so the lattice falls apart between units: spaces and the characters after
them. Distinct units of a batch are solved together, forwards and backwards, which gives the best path and what the next
best costs. For the N best of a text only the N - 1 units with the cheapest second paths matter; these are searched by
A* from the end, whose heuristic, the forward Viterbi score, is exact, so paths leave the queue in order. Units are kept
in a bounded memory of the worker; when it is full, the half that was met most stays. Documents meet in no shuffle.

Cases: null and empty texts have no pieces, one segmentation with score 0 and decode to an empty text; a mark in the
text itself is written as bytes and survives; ties prefer the longer last piece; long words are solved whole; repeated
rows are encoded one by one; extra columns are kept by `encode`, except those whose names it sets.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain as together
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.llm.sized import in_batches
from plantlens.llm.wordhash import mix

MARK = "▁"
N_BEST = 4
# Scores are whole millionths, so that sums are exact and ties are ties.
MICRO = 1_000_000
# Units a worker remembers, some 300 bytes each.
MOST_UNITS = 200_000
# Characters of units that are solved together, at some 500 bytes each; a longer one is solved alone.
MOST_CHARACTERS = 50_000
_NO_CHARACTER = 0x110000
_vocabularies: dict[str, Vocabulary] = {}


class _Units(dict):
    """Numbers of units in the order in which they were met; `new` has those that are not solved yet."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.new.append(unit)
        return number


class Vocabulary:
    """Pieces with log-probabilities, byte pieces, and tables of hashes for whole columns of text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.piece: dict[str, tuple[int, float]] = {}
        self.byte = [0] * 256
        self.back: list[bytes] = [b""] * size
        for i in range(size):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
                self.back[i] = bytes([int(p[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                rank = -model.get_score(i)
                self.piece[p] = (i, -float(round(MICRO * math.log((rank if rank < size else size) + 2.0))))
                self.back[i] = p.replace(MARK, " ").encode()
        self.byte_score = -float(round(MICRO * math.log(size)))
        self.longest = max(map(len, self.piece))
        if any(MARK in p.lstrip(MARK) for p in self.piece):
            raise ValueError("pieces that reach over a space are not supported")
        alone = "" if any("\n" in p for p in self.piece) else "\n"
        self.unit = re.compile(f"{alone}| *[^ {alone}]+| +" if alone else " *[^ ]+| +")
        heads: dict[int, set[int]] = {}
        whole: dict[int, dict[int, tuple[int, float]]] = {}
        for p, (i, score) in self.piece.items():
            h = np.uint64(0)
            for k, c in enumerate(np.frombuffer(p.encode("utf-32-le"), np.uint32)):
                h = self._extend(np.array([h]), np.array([c]))[0]
                heads.setdefault(k + 1, set()).add(int(h))
            whole.setdefault(len(p), {})[int(h)] = (i, score)
        # by length: hashes of the beginnings of pieces, and id (-1 for none) and score of the piece that is one
        self.heads = {}
        for k, v in heads.items():
            names = sorted(v)
            found = [whole.get(k, {}).get(h, (-1, 0.0)) for h in names]
            self.heads[k] = (np.array(names, np.uint64), np.array([x[0] for x in found]), np.array([x[1] for x in found]))
        self._forget()
        self.n_best = lru_cache(maxsize=20_000)(self._n_best)

    def _forget(self, kept: np.ndarray | None = None) -> None:
        """Only these units stay solved: their numbers, ids, scores of the best path, what the second best costs more, the length
        of their ids, and how often they were met."""
        if kept is None:
            self.units, self.names = _Units(), []
            self.scores, self.gaps, self.bytes, self.met = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        known = list(self.units)
        self.units = _Units()
        self.units.update((known[k], i) for i, k in enumerate(kept.tolist()))
        self.names = [self.names[k] for k in kept.tolist()]
        self.scores, self.gaps, self.bytes, self.met = self.scores[kept], self.gaps[kept], self.bytes[kept], self.met[kept] // 2

    @staticmethod
    def _extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return mix(h + c.astype(np.uint64) + np.uint64(1))

    # whole batches

    def _edges(self, codes: np.ndarray, unit: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, length, id (-1 for bytes) and score of all lattice edges; places count characters of the batch."""
        parts = []
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        single = np.zeros(len(codes), bool)
        for length in range(1, self.longest + 1):
            inside = at + length <= ends[unit[at]]
            at, h = at[inside], h[inside]
            h = self._extend(h, codes[at + length - 1])
            names, ids, scores = self.heads[length]
            k = np.minimum(np.searchsorted(names, h), len(names) - 1)
            alive = names[k] == h
            at, h, k = at[alive], h[alive], k[alive]
            hit = ids[k] >= 0
            parts.append((at[hit], np.full(hit.sum(), length), ids[k[hit]], scores[k[hit]]))
            if length == 1:
                single[at[hit]] = True
            if not len(at):
                break
        lone = np.flatnonzero(~single)
        width = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where((codes < 0x10000) | (codes == _NO_CHARACTER), 3, 4)))
        parts.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1), width[lone] * self.byte_score))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _solve(self, units: list[str]) -> None:
        text = "".join(units)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        codes[codes == ord(MARK)] = _NO_CHARACTER
        codes[codes == 32] = ord(MARK)
        length = np.array([len(u) for u in units])
        ends = np.cumsum(length)
        starts = ends - length
        unit = np.repeat(np.arange(len(units)), length)
        at, size, ids, score = self._edges(codes, unit, ends)
        # a unit of n characters has n + 1 nodes
        tail, head = at + unit[at], at + unit[at] + size
        first = starts + np.arange(len(units))
        last = first + length
        # edges and their scores by the node where they end, longer ones first
        longest = int(size.max())
        table = np.full((int(last[-1]) + 1, longest), -np.inf)
        table[head, longest - size] = score
        edge_at = np.zeros(table.shape, np.int32)
        edge_at[head, longest - size] = np.arange(len(at))
        forth, pick, behind = _best(table, first, length)
        on_path = np.zeros(len(at), bool)
        now, stop = last, first
        while len(now):
            on_path[edge_at[now, longest - pick[now]]] = True
            now = now - pick[now]
            now, stop = now[now > stop], stop[now > stop]
        slack = forth[last][unit[at]] - (forth[tail] + score + behind[head])
        off = ~on_path
        second = np.full(len(units), np.inf)
        np.minimum.at(second, unit[at[off]], np.maximum(slack[off], 0.0))
        chosen = np.flatnonzero(on_path)
        chosen = chosen[np.argsort(at[chosen], kind="stable")]
        order = np.searchsorted(unit[at[chosen]], np.arange(len(units) + 1)).tolist()
        packed = ids[chosen].astype("<u2").tobytes()
        names = [packed[2 * lo:2 * hi] for lo, hi in zip(order, order[1:])]
        for k in np.unique(unit[at[chosen[ids[chosen] < 0]]]).tolist():
            full: list[int] = []
            mine = chosen[order[k]:order[k + 1]]
            for i, place in zip(ids[mine].tolist(), at[mine].tolist()):
                full += [i] if i >= 0 else [self.byte[b] for b in text[place].encode()]
            names[k] = np.array(full, "<u2").tobytes()
        self.scores, self.gaps = np.concatenate([self.scores, forth[last]]), np.concatenate([self.gaps, second])
        self.bytes = np.concatenate([self.bytes, [len(x) for x in names]])
        self.names += names

    # one unit

    def _n_best(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a unit, best first."""
        text = "".join("\0" if c == MARK else MARK if c == " " else c for c in unit)
        edges: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(text) + 1)]
        forth = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            for size in range(1, min(self.longest, end) + 1):
                found = self.piece.get(text[end - size:end]) if "\0" not in text[end - size:end] or unit[end - size:end] == "\0" else None
                if found:
                    edges[end].append((end - size, found[1], (found[0],)))
                elif size == 1:
                    raw = unit[end - 1].encode()
                    edges[end].append((end - 1, len(raw) * self.byte_score, tuple(self.byte[b] for b in raw)))
            forth[end] = max(forth[a] + s for a, s, _ in edges[end])
        # entries: minus the best total through it, its place (of equals the one nearest the start goes on), a number,
        # the score from there to the end, and the pieces from there as a linked list
        queue: list[tuple] = [(-forth[-1], len(text), 0, 0.0, None)]
        out: list[tuple[float, bytes]] = []
        count = 1
        while queue and len(out) < n:
            _, place, _, back, chain = heapq.heappop(queue)
            if place == 0:
                ids: list[int] = []
                while chain is not None:
                    ids += chain[0]
                    chain = chain[1]
                out.append((back, np.array(ids, "<u2").tobytes()))
                continue
            for a, s, new in edges[place]:
                heapq.heappush(queue, (-(forth[a] + s + back), a, count, s + back, (new, chain)))
                count += 1
        return out

    # texts

    def encode(self, texts: list[str], n: int = N_BEST) -> list[tuple[bytes, float, list[float], list[bytes]]]:
        """For each text: ids of the best segmentation as 2-byte numbers, its score, and of the next n - 1 scores and ids."""
        if len(self.units) > MOST_UNITS:
            self._forget(np.sort(np.argsort(-self.met, kind="stable")[:MOST_UNITS // 2]))
        split = [self.unit.findall(" " + t) if t else [] for t in texts]
        numbers = [list(map(self.units.__getitem__, units)) for units in split]
        while self.units.new:
            some = int(np.searchsorted(np.cumsum([len(u) for u in self.units.new[:20_000]]), MOST_CHARACTERS)) + 1
            self._solve(self.units.new[:some])
            del self.units.new[:some]
        met = np.bincount(np.fromiter(together.from_iterable(numbers), np.int64), minlength=len(self.names))
        met[:len(self.met)] += self.met
        self.met = met
        return [self._text(units, at, n) for units, at in zip(split, numbers)]

    def _text(self, units: list[str], at: list[int], n: int) -> tuple[bytes, float, list[float], list[bytes]]:
        found = list(map(self.names.__getitem__, at))
        ids = b"".join(found)
        places = np.array(at, np.int64)
        # whole numbers, so that the sum is exact in any order
        score = float(self.scores[places].sum())
        if n < 2 or not units:
            return ids, score / MICRO, [], []
        gaps = self.gaps[places]
        cheap = np.argsort(gaps, kind="stable")[:n - 1] if len(gaps) <= 4 * n else _least(gaps, n - 1)
        ways: list[tuple[float, tuple[tuple[int, bytes], ...]]] = [(0.0, ())]
        for k in cheap.tolist():
            if math.isinf(gaps[k]):
                continue
            best = self.n_best(units[k], n)
            top = best[0][0]
            ways = sorted([(w + top - s, c if s == top and j == 0 else (*c, (k, b)))
                           for w, c in ways for j, (s, b) in enumerate(best)], key=itemgetter(0))[:n]
        scores, others = [], []
        ends = np.cumsum(self.bytes[places])
        for gap, changes in ways[1:]:
            parts, done = [], 0
            for k, b in sorted(changes, key=itemgetter(0)):
                parts += [ids[done:int(ends[k]) - len(found[k])], b]
                done = int(ends[k])
            scores.append((score - gap) / MICRO)
            others.append(b"".join([*parts, ids[done:]]))
        return ids, score / MICRO, scores, others

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.back.__getitem__, ids.tolist()))[1:].decode()


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least values, the earlier one of equals."""
    border = np.partition(values, n - 1)[n - 1]
    under = np.flatnonzero(values < border)
    return np.concatenate([under, np.flatnonzero(values == border)[:n - len(under)]])


def _best(table: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best scores from the first node of each unit, the size of each node's best edge, of equals the longer, and best scores to
    the last node; `table` has the scores of edges by the node where they end, longest first. All units go on by one node at a time."""
    nodes, longest = table.shape
    forth, pick, behind = np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes)
    order = np.argsort(-length, kind="stable")
    begin, end = first[order], (first + length)[order]
    alive = np.searchsorted(-length[order], -np.arange(int(length.max()) + 1), side="right").tolist()
    flat = table.reshape(-1)
    for depth in range(1, len(alive)):
        n, most = alive[depth], min(longest, depth)
        sizes = np.arange(most, 0, -1)
        node = begin[:n] + depth
        total = table[node, longest - most:] + forth[node[:, None] - sizes]
        best = total.argmax(axis=1)
        forth[node] = total[np.arange(n), best]
        pick[node] = most - best
        node = end[:n, None] - depth + sizes
        behind[end[:n] - depth] = (flat[node * longest + longest - sizes] + behind[node]).max(axis=1)
    return forth, pick, behind


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Add `piece_ids`, the best segmentation of the text."""
    docs = docs.drop("piece_ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = v.encode([t or "" for t in part.column(text_col).to_pylist()], 1)
                ids = [np.frombuffer(f[0], "<u2").astype(np.int32) for f in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "piece_ids"])

    return in_batches(docs, run, schema)


def encode_checked(docs: DataFrame, path: str, text_col: str = "text", n: int = N_BEST) -> DataFrame:
    """Add `piece_ids` and its `score`, `next_scores` and `next_ids` of the next n - 1 segmentations, and `decodes`, whether the
    best one decodes to the text, in one pass."""
    fields = T.StructType.fromDDL(
        "piece_ids array<int>, score double, next_scores array<double>, next_ids array<array<int>>, decodes boolean").fields
    docs = docs.drop(*[f.name for f in fields])
    schema = T.StructType([*docs.schema.fields, *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                found = v.encode(texts, n)
                ids = [np.frombuffer(f[0], "<u2") for f in found]
                others = [[np.frombuffer(x, "<u2").astype(np.int32) for x in f[3]] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.float64()),
                     pa.array([f[2] for f in found], pa.list_(pa.float64())), pa.array(others, pa.list_(pa.list_(pa.int32()))),
                     pa.array([v.decode(x) == t for x, t in zip(ids, texts)], pa.bool_())], names=names)

    return in_batches(docs, run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """Add the text of piece ids."""
    encoded = encoded.drop(out)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else v.decode(np.array(x, np.int64)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return in_batches(encoded, run, schema)


def digest(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """One row per document: doc_id, n_pieces, score of the best segmentation, ids_crc32 of its 2-byte ids, the scores and
    checksums of the next n - 1, and whether the best one decodes to the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = v.encode(texts, n)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(f[0]) // 2 for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.float64()), pa.array([zlib.crc32(f[0]) for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.list_(pa.float64())),
                    pa.array([[zlib.crc32(x) for x in f[3]] for f in found], pa.list_(pa.int64())),
                    pa.array([v.decode(np.frombuffer(f[0], "<u2")) == t for f, t in zip(found, texts)], pa.bool_())],
                    names=["doc_id", "n_pieces", "score", "ids_crc32", "next_scores", "next_crc32", "round_trip"])

    return in_batches(
        docs.select("doc_id", F.col("text")), run,
        "doc_id bigint, n_pieces bigint, score double, ids_crc32 bigint, next_scores array<double>, next_crc32 array<bigint>, round_trip boolean")
