"""Words of whole columns of text as 64-bit hashes, worked out over the bytes of an Arrow column at once.

Words are split at the six ASCII white-space bytes, which never occur inside a longer UTF-8 character. The hash of a
word is a polynomial in its bytes, taken from one running sum over the column, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text worked on at a time; one longer document is still taken whole.
PART_BYTES = 1 << 19
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _LETTERS.copy()
_LOWER[65:91] = _LETTERS[97:123]
_powers: dict[str, np.ndarray] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            t = np.full(n, base, np.uint64)
            t[:1] = 1
            _powers[name] = np.cumprod(t, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the argument."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of the rows first..last-1 of a column: their hashes, byte ranges in `data`, and the first word of each row."""

    first: int
    last: int
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    data: np.ndarray


def words(column: pa.Array, lower: bool = False, part_bytes: int = PART_BYTES) -> Iterator[Words]:
    """The words of a string column, some megabytes of text at a time. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    body = column.buffers()[2] if n else None
    raw = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    letters = _LOWER if lower else _LETTERS
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + part_bytes, side="right")) - 1)
        low = int(offsets[first])
        edge = offsets[first:last + 1] - low
        data = raw[low:int(offsets[last])]
        space = _SPACE[data]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        filled = edge[:-1] < edge[1:]
        before[edge[:-1][filled]] = True
        after[edge[1:][filled] - 1] = True
        starts = np.flatnonzero(~space & before)
        ends = np.flatnonzero(~space & after) + 1
        up, down = _table(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * up[:-1], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        yield Words(first, last, hashes, starts, ends, np.searchsorted(starts, edge), data)
        first = last


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` neighbouring words, the word hashes of one or more rows standing one after another."""
    m = max(len(hashes) - size + 1, 0)
    total = np.zeros(m, np.uint64)
    for k in range(size):
        total = mix(total + hashes[k:k + m] + np.uint64(k + 1)) if size <= 8 else total * np.uint64(_MULTIPLIER) + hashes[k:k + m]
    return mix(total)
