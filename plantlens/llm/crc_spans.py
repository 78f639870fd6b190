"""crc32 of many byte spans at once.

The checksum is linear in a message's bits but for a constant of its length: it is the exclusive or of one table entry for
each byte, chosen by the byte and its distance from the span's end, and of the checksum of as many zero bytes. Entries are
looked up for all bytes of a column and combined by `bitwise_xor.reduceat` over the spans. The table has `BLOCK`
distances; a longer span is combined in blocks from its end, and its blocks are folded in pairs, the earlier
one carried over the zero bytes of the later one.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

BLOCK = 64
# Fixed value: the reflected polynomial of crc32.
_POLYNOMIAL = 0xEDB88320


def _carried(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The state after one more zero byte."""
    return (state >> np.uint32(8)) ^ table[state & np.uint32(255)]


@cache
def _entries() -> np.ndarray:
    """Entry of a byte at a distance from the end, at [distance * 256 + byte]."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = (first >> np.uint32(1)) ^ np.where(first & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    rows = [first]
    for _ in range(BLOCK - 1):
        rows.append(_carried(rows[-1], first))
    return np.concatenate(rows)


@cache
def _shift(level: int) -> np.ndarray:
    """Four tables of 256 that carry a state over BLOCK * 2**level zero bytes, one for each of its bytes."""
    if level:
        half = _shift(level - 1)
        return _carry(_carry(np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None], half), half)
    state = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(BLOCK):
        state = _carried(state, _entries()[:256])
    return state


def _carry(state: np.ndarray, tables: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return (tables[0][state & byte] ^ tables[1][state >> np.uint32(8) & byte]
            ^ tables[2][state >> np.uint32(16) & byte] ^ tables[3][state >> np.uint32(24)])


@cache
def _zeros() -> np.ndarray:
    return np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], np.uint32)


def _constants(lengths: np.ndarray) -> np.ndarray:
    """Checksums of zero bytes."""
    out = _zeros()[np.minimum(lengths, BLOCK)]
    long = np.flatnonzero(lengths > BLOCK)
    kinds, which = np.unique(lengths[long], return_inverse=True)
    out[long] = np.array([zlib.crc32(bytes(n)) for n in kinds.tolist()], np.uint32)[which]
    return out


def _folded(blocks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One state for each span from its blocks, which stand first to last; earlier blocks are carried over later ones."""
    level = 0
    while len(blocks) > len(counts):
        # an odd span gets a block of zeros ahead, which changes nothing
        odd = counts & 1
        ends = np.cumsum(counts + odd)
        padded = np.zeros(int(ends[-1]), np.uint32)
        at = np.arange(len(blocks)) + np.repeat(np.cumsum(odd), counts)
        padded[at] = blocks
        blocks = _carry(padded[0::2], _shift(level)) ^ padded[1::2]
        counts = (counts + odd) // 2
        level += 1
    return blocks


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of data[starts[k]:ends[k]] for every k; spans are not empty and may overlap."""
    lengths = ends - starts
    if not len(lengths):
        return np.zeros(0, np.uint32)
    before = np.cumsum(lengths) - lengths
    total = int(before[-1] + lengths[-1])
    place = np.arange(total)
    distance = np.repeat(before + lengths - 1, lengths) - place
    byte = data[place + np.repeat(starts - before, lengths)]
    entries = _entries()[(distance % BLOCK) << 8 | byte]
    if lengths.max() <= BLOCK:
        return np.bitwise_xor.reduceat(entries, before) ^ _constants(lengths)
    heads = distance % BLOCK == BLOCK - 1
    heads[before] = True
    blocks = np.bitwise_xor.reduceat(entries, np.flatnonzero(heads))
    counts = -(-lengths // BLOCK)
    long = counts > 1
    in_long = np.repeat(long, counts)
    out = np.zeros(len(lengths), np.uint32)
    out[~long] = blocks[~in_long]
    out[long] = _folded(blocks[in_long], counts[long])
    return out ^ _constants(lengths)
