"""The prefix forest of one sorted batch of turn sequences, by union-find over the edges between neighbours.

An edge joins two neighbours and has the length of their longest common prefix. Edges are taken in descending order of
it: all sequences joined so far at some depth are the members of one node, and a merge of components makes the node where
their paths part. Before a component is merged at a smaller depth, the nodes on its way up are final and are written out.
Nodes that touch an end of the batch may go on in the next one; they are marked open and carry only what is complete.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Turns in a segment of a conversation.
SEGMENT = 64

FIELDS = {"p": "long", "q": "long", "pp": "long", "pq": "long", "seg": "long", "depth": "long", "chars": "long", "conv_id": "long",
          "parent_conv_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long",
          "ends_sha256": "string", "open": "boolean", "more": "boolean", "first_end": "long", "ends": "string",
          "path_p": "array<long>", "path_q": "array<long>"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())


def _prefixes(root: np.ndarray, offsets: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Identities of all prefixes: the exclusive or of the root and the turns so far, for all rows at once."""
    running = np.zeros(len(own) + 1, np.int64)
    np.bitwise_xor.accumulate(own, out=running[1:])
    sizes = np.diff(offsets)
    return running[1:] ^ np.repeat(running[offsets[:-1]] ^ root, sizes)


@dataclass
class Sequences:
    """Segments of conversations in the order of their turns; `offsets` cuts the flat lists."""

    seg: list[int]
    conv: list[int]
    last: list[bool]
    root_p: list[int]
    root_q: list[int]
    offsets: list[int]
    p: list[int]
    q: list[int]
    chars: list[int]

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Sequences:
        column = {n: batch.column(n) for n in batch.schema.names}
        turns = column["turns"]
        offsets = turns.offsets.to_numpy() - turns.offsets[0].as_py()
        flat = turns.flatten()
        own = {n: pc.struct_field(flat, n).to_numpy(zero_copy_only=False) for n in ("xp", "xq", "chars")}
        roots = [column[n].to_numpy() for n in ("rp", "rq")]
        return cls(column["seg"].to_pylist(), column["conv_id"].to_pylist(), column["last"].to_pylist(), roots[0].tolist(), roots[1].tolist(),
                   offsets.tolist(), _prefixes(roots[0], offsets, own["xp"]).tolist(), _prefixes(roots[1], offsets, own["xq"]).tolist(),
                   own["chars"].tolist())

    def node(self, row: int, depth: int) -> tuple[int, int]:
        if not depth:
            return self.root_p[row], self.root_q[row]
        at = self.offsets[row] + depth - 1
        return self.p[at], self.q[at]

    def common(self, row: int) -> int:
        """Length of the longest prefix that a row shares with the one before it; -1 if they have different roots."""
        if (self.seg[row], self.root_p[row], self.root_q[row]) != (self.seg[row - 1], self.root_p[row - 1], self.root_q[row - 1]):
            return -1
        a, b, end = self.offsets[row - 1], self.offsets[row], self.offsets[row + 1]
        n, most = 0, min(b - a, end - b)
        while n < most and self.p[a + n] == self.p[b + n] and self.q[a + n] == self.q[b + n]:
            n += 1
        return n


@dataclass
class _Component:
    """Rows low..high, joined at `top`: what its node there has gathered so far."""

    low: int
    high: int
    top: int
    least: int
    more: bool
    n: int = 1
    saved: int = 0
    leaves: int = 0
    children: int = 0
    ends: list[int] = field(default_factory=list)
    waiting: list[int] = field(default_factory=list)


class Forest:
    """Nodes of a batch as columns of `FIELDS`."""

    def __init__(self, sequences: Sequences) -> None:
        self.of = sequences
        self.columns: dict[str, list] = {name: [] for name in FIELDS}
        n = len(sequences.conv)
        self.edge_rows = (0, n - 1)
        self.up = list(range(n))
        self.parts = [_Component(i, i, sequences.offsets[i + 1] - sequences.offsets[i], c, not last, ends=[c] if last else [])
                      for i, (c, last) in enumerate(zip(sequences.conv, sequences.last))]
        edges = [(sequences.common(i), i) for i in range(1, n)]
        for depth, row in sorted((e for e in edges if e[0] >= 0), key=lambda e: -e[0]):
            self._merge(self._find(row - 1), self._find(row), depth)
        for i in range(n):
            if self._find(i) == i:
                self._rise(self.parts[i], -1 if sequences.seg[i] == 0 else 0)

    def _find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def _merge(self, left: int, right: int, depth: int) -> None:
        a, b = self.parts[left], self.parts[right]
        self._rise(a, depth)
        self._rise(b, depth)
        self.up[right] = left
        a.high = b.high
        a.least = min(a.least, b.least)
        a.more |= b.more
        a.n, a.saved, a.leaves, a.children = a.n + b.n, a.saved + b.saved, a.leaves + b.leaves, a.children + b.children
        a.ends += b.ends
        a.waiting += b.waiting

    def _rise(self, part: _Component, depth: int) -> None:
        """Write out the nodes of a component that are deeper than `depth`."""
        is_open = part.low == self.edge_rows[0] or part.high == self.edge_rows[1]
        while part.top > depth:
            part.waiting = self._node(part, is_open)
            if is_open:
                part.saved = part.leaves = part.children = 0
            part.ends, part.more = [], False
            part.top -= 1

    def _node(self, part: _Component, is_open: bool) -> list[int]:
        """Write the node at a component's top; returns the rows that wait for their parent."""
        s, out, d, row = self.of, self.columns, part.top, part.low
        at = len(out["p"])
        chars = s.chars[s.offsets[row] + d - 1] if d else 0
        if not is_open:
            part.saved += (part.n - 1) * chars
            part.leaves = part.leaves if part.children else int(not part.more)
        lowest = 0 if s.seg[row] == 0 else 1
        path = [s.node(row, k) for k in range(lowest, d + 1)] if is_open else None
        mine, above = s.node(row, d), s.node(row, d - 1) if d else (None, None)
        joined = ",".join(map(str, part.ends))
        values = (*mine, *above, s.seg[row], s.seg[row] * SEGMENT + d, chars, part.least, None, part.n, part.children, part.leaves, part.saved,
                  None if is_open else sha256(joined.encode()).hexdigest(), is_open, part.more, part.ends[0] if part.ends else None,
                  joined if is_open else None, path and [x for x, _ in path], path and [x for _, x in path])
        for name, value in zip(FIELDS, values):
            out[name].append(value)
        if is_open:
            return []
        for child in part.waiting:
            out["parent_conv_id"][child] = part.least
        part.children = 1
        return [at]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.columns[k], _ARROW[v]) for k, v in FIELDS.items()], list(FIELDS))
