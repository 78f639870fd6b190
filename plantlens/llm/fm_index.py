"""A compressed full-text index over sequences of 64-bit symbols.

The suffix array is ordered by the first 64 symbols of each suffix, enough for patterns up to that length, and only
serves to build the index: the Burrows-Wheeler transform in a wavelet matrix of packed bits with block counts, the
symbol table, and the bounds of groups of suffixes that agree in their first `size` and `size - 1` symbols.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Occurrences of a symbol before a place, for arrays of symbols and places."""

    def __init__(self, symbols: np.ndarray, distinct: int) -> None:
        self.levels = max(1, int(distinct - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now, n = symbols, len(symbols)
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 + -n % 64, np.uint8)]), bitorder="little").view(np.uint64)
            ones = np.zeros(len(packed), np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=ones[1:])
            self.words.append(packed)
            self.counts.append(ones)
            self.zeros.append(n - int(bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.base = self._walk(np.arange(distinct), np.zeros(distinct, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & mask)
            at = np.where(symbol >> level & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._walk(symbol, at) - self.base[symbol]


def _ranks(text: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The suffix array by the first 64 symbols, and the ranks of suffixes by their first 1, 2, 4, ..., 32 symbols."""
    n, step = len(text), 1
    rank = np.concatenate([text.astype(np.int64), [-1]])
    kept = {}
    while True:
        kept[step] = rank
        ahead = np.full(n, -1, np.int64)
        ahead[:max(n - step, 0)] = rank[step:n]
        key = rank[:n] * (n + 2) + ahead + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        ordered = key[order]
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.concatenate([new, [-1]])
        step *= 2
        if step == 64:
            return order, kept


class FmIndex:
    """An index over sequences put one after another, `bounds` giving their places in `symbols`."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, owners: np.ndarray, size: int = 50) -> None:
        if not 34 <= size <= 62:
            raise ValueError("size must be from 34 to 62")
        self.size = size
        self.alphabet, dense = np.unique(symbols, return_inverse=True)
        lengths = np.diff(bounds)
        at = np.arange(len(symbols)) + np.repeat(np.arange(len(lengths)), lengths)
        text = np.zeros(len(symbols) + len(lengths), np.int64)
        text[at] = dense + 1
        owner = np.repeat(owners, lengths + 1)
        order, kept = _ranks(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        self.wavelet = WaveletMatrix(text[order - 1], len(self.alphabet) + 1)
        less, whole = self._starts(order, kept, size - 1), self._starts(order, kept, size)
        edges = np.flatnonzero(less)
        number = np.cumsum(less) - 1
        self.group_start, self.group_end = edges[number], np.append(edges[1:], len(order))[number]
        edges = np.flatnonzero(whole)
        self.least_owner = np.minimum.reduceat(owner[order], edges)[np.cumsum(whole) - 1]

    @staticmethod
    def _starts(order: np.ndarray, kept: dict[int, np.ndarray], size: int) -> np.ndarray:
        """True where a suffix differs from the one before it within its first `size` symbols."""
        n, new, at = len(order), np.zeros(len(order), bool), 0
        new[:1] = True
        for step in (32, 16, 8, 4, 2, 1):
            if size & step:
                r = kept[step][np.minimum(order + at, n)]
                new[1:] |= r[1:] != r[:-1]
                at += step
        return new

    def least_owners(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each place of streamed sequences, the least owner of the window of `size` symbols that starts there.

        Sequences are read backwards, all of them a step at a time. A step drops the symbol at the far end, by widening
        the interval to the suffixes that agree in one symbol less, and extends by the symbol before, by two ranks.
        Places without a full window, or whose window the index does not hold, get the largest number.
        """
        dense = np.searchsorted(self.alphabet, symbols)
        known = (dense < len(self.alphabet)) & (self.alphabet[np.minimum(dense, len(self.alphabet) - 1)] == symbols)
        dense = np.where(known, dense + 1, 0)
        out = np.full(len(symbols), np.iinfo(np.int64).max)
        lengths = np.diff(bounds)
        by_length = np.argsort(-lengths, kind="stable")
        ends, lengths = bounds[1:][by_length], lengths[by_length]
        total = len(self.group_start)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), total, np.int64)
        depth = np.zeros(len(ends), np.int64)
        active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
        for t, m in enumerate(active):
            place = ends[:m] - 1 - t
            c = dense[place]
            lo, hi, d = low[:m], high[:m], depth[:m]
            full = d == self.size
            inside = np.minimum(lo, total - 1)
            lo, hi = np.where(full, self.group_start[inside], lo), np.where(full, self.group_end[inside], hi)
            lo, hi = self.first[c] + self.wavelet.rank(c, lo), self.first[c] + self.wavelet.rank(c, hi)
            lost = (hi <= lo) | (c == 0)
            if lost.any():
                self._shorten(dense, place, ends[:m], d, full, lost, lo, hi, low, high)
                d = depth[:m] = np.where(lost, self._kept_depth, np.minimum(d + 1, self.size))
            else:
                d = depth[:m] = np.minimum(d + 1, self.size)
            low[:m], high[:m] = lo, hi
            found = d == self.size
            out[place[found]] = self.least_owner[lo[found]]
        return out

    def _shorten(self, dense, place, ends, depth, full, lost, lo, hi, low, high) -> None:
        """The longest match that starts at `place` for the sequences whose match was lost: searched anew, by halving its length."""
        self._kept_depth = np.zeros(len(place), np.int64)
        which = np.flatnonzero(lost)
        most = np.where(full, self.size - 1, depth)[which]
        least = np.zeros(len(which), np.int64)
        best_lo, best_hi = np.zeros(len(which), np.int64), np.full(len(which), len(self.group_start), np.int64)
        while (least < most).any():
            middle = (least + most + 1) // 2
            a, b = self._search(dense, place[which], middle)
            ok = (b > a) & (least < most)
            best_lo, best_hi = np.where(ok, a, best_lo), np.where(ok, b, best_hi)
            least, most = np.where(ok, middle, least), np.where(ok | (least >= most), most, middle - 1)
        lo[which], hi[which] = best_lo, best_hi
        self._kept_depth[which] = least

    def _search(self, dense: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns of these lengths that start at these places."""
        lo, hi = np.zeros(len(place), np.int64), np.full(len(place), len(self.group_start), np.int64)
        for back in range(int(length.max(initial=0)) - 1, -1, -1):
            use = back < length
            c = dense[np.minimum(place + back, len(dense) - 1)]
            a, b = self.first[c] + self.wavelet.rank(c, lo), self.first[c] + self.wavelet.rank(c, hi)
            gone = (c == 0) | (b <= a)
            lo = np.where(use, np.where(gone, 0, a), lo)
            hi = np.where(use, np.where(gone, 0, b), hi)
        return lo, hi
