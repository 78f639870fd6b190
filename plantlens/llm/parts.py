"""Bytes of Arrow string columns, some megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 4 << 20


def parts(column: pa.Array, part_bytes: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, byte offsets of these rows from 0, their bytes). Null counts as empty; a row longer
    than `part_bytes` is a part of its own."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    body = column.buffers()[2]
    raw = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + part_bytes, side="right")) - 1)
        yield first, last, offsets[first:last + 1] - offsets[first], raw[offsets[first]:offsets[last]]
        first = last
