"""Pre-tokens of byte-level tokenizers, found over whole Arrow columns at once.

The library cuts a text into contractions, runs of letters, of numbers and of other characters, each with one space
before it, and runs of white space. Which characters are letters, numbers and white space is asked of the library itself, so
that its Unicode version decides. Pre-tokens cover a text without gaps and the library never joins anything across them.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE = range(4)
# The contractions of the byte-level pre-tokenizer after their apostrophe.
SHORT, LONG = "stmd", ("re", "ve", "ll")
_known: dict[str, PreTokenizer] = {}


def _classes(pre) -> np.ndarray:
    """The class of every code point."""
    def kind(c: str) -> int:
        if len(pre("a" + c)) == 1:
            return LETTER
        if len(pre("1" + c)) == 1:
            return NUMBER
        return SPACE if len(pre("\n" + c)) == 1 else OTHER

    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x80):
        table[c] = kind(chr(c))
    # neighbouring code points of one class come back as one run
    for low, high in ((0x80, 0xD800), (0xE000, 0x110000)):
        for _, (a, b) in pre("".join(map(chr, range(low, high)))):
            table[low + a:low + b] = kind(chr(low + a))
    return table


class PreTokenizer:
    """Cuts columns of text like the library's byte-level pre-tokenizer; counts pieces by the library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if told["normalizer"] or {k: (told["pre_tokenizer"] or {}).get(k) for k in plain} != plain:
            raise ValueError("not a byte-level tokenizer without prefix space and normalizer")
        if any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in their surroundings")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = sorted((t["content"] for t in told["added_tokens"] if t["content"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.classes = _classes(self.tokenizer.pre_tokenizer.pre_tokenize_str)

    def n_pieces(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _special_spans(self, text: str, edges: np.ndarray) -> list[tuple[int, int]]:
        """Added tokens inside single rows, as character positions."""
        if self.special is None or not self.special.search(text):
            return []
        return [m.span() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) for m in self.special.finditer(text, a, b)]

    def cut(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where pre-tokens start, and for each row boundary the number of pre-tokens before it."""
        n_bytes = len(data)
        if not n_bytes:
            return np.zeros(0, np.int64), np.zeros(len(edges), np.int64)
        text = data.tobytes().decode()
        n = len(text)
        if n == n_bytes:
            places, points, rows = None, data, edges
        else:
            places = np.flatnonzero((data & 0xC0) != 0x80)
            points, rows = np.frombuffer(text.encode("utf-32-le"), np.uint32), np.searchsorted(places, edges)
        kinds = self.classes[points]
        segment = np.zeros(n + 1, bool)
        segment[rows] = True
        spans = self._special_spans(text, rows)
        for a, b in spans:
            segment[a], segment[b] = True, True
        first = segment[:-1]
        blank, space = kinds == SPACE, points == 32
        start = np.ones(n, bool)
        start[1:] = (kinds[1:] != kinds[:-1]) & (blank[1:] | ~space[:-1])
        # the last of a run of white space stands alone or goes with what follows
        start[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:]
        start |= first
        marks = np.flatnonzero(start & (points == 39))
        for at in marks.tolist():
            size = 2 if text[at + 1:at + 2] in SHORT and at + 1 < n else 3 if text[at + 1:at + 3] in LONG else 0
            if size and not segment[at + 1:at + size].any():
                start[at + 1:at + size] = False
                start[at + size:at + size + 1] = True
        for a, b in spans:
            start[a + 1:b] = False
        starts = np.flatnonzero(start)
        return (starts if places is None else places[starts]).astype(np.int64), np.searchsorted(starts, rows)


def pre_tokenizer(path: str) -> PreTokenizer:
    if path not in _known:
        _known[path] = PreTokenizer(path)
    return _known[path]


def dictionary(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct pre-tokens and the number of each one's place in them."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()
