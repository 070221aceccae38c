"""Elias-Fano sequences in numpy: access and successor search over monotone integers.

Each value is cut into low bits, packed, and a high part, written in unary.  All arrays can be
views of one memory-mapped buffer.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
#: Values decoded at once for sorted questions.
BLOCK = 1 << 16


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Fields of ``width`` bits (up to 63) in 64-bit words, one spare word at the end."""
    words = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(words, word, values << shift)
        over = (at & 63) + width > 64
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return words


def encode(values: np.ndarray) -> dict:
    """Arrays of a non-decreasing sequence of integers from 0."""
    values = np.asarray(values, np.uint64)
    n, top = len(values), int(values[-1]) + 1 if len(values) else 1
    width = max(0, (top // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(width)).astype(np.int64)
    bits = np.zeros(n + (top >> width) + 65 & ~63, bool)
    bits[high + np.arange(n)] = True
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    return {"head": np.array([n, width], np.int64), "low": _pack(values & np.uint64((1 << width) - 1), width),
            "high": words, "ones": ones.astype(np.uint32)}


class Sequence:
    def __init__(self, arrays: dict):
        self.n, self.width = (int(x) for x in arrays["head"])
        self.low_words, self.words, self.ones = arrays["low"], arrays["high"], arrays["ones"]
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: bool) -> np.ndarray:
        """Position of the k-th one (or zero, if ``flip``)."""
        word = np.searchsorted(counts, k, "right") - 1
        left = k - counts[word]
        bits = self.words[word]
        bits = ~bits if flip else bits
        place = np.zeros(len(k), np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(bits >> place & np.uint64((1 << step) - 1)).astype(np.int64)
            beyond = left >= below
            left = np.where(beyond, left - below, left)
            place = np.where(beyond, place + np.uint64(step), place)
        return word * 64 + place.astype(np.int64)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.int64)
        first = at * self.width
        word, shift = first >> 6, (first & 63).astype(np.uint64)
        # shifting by 64 is undefined: in two steps
        value = self.low_words[word] >> shift | self.low_words[word + 1] << (np.uint64(63) - shift) << ONE
        return (value & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Values at the indexes."""
        return (self._select(at, self.ones, False) - at << self.width) + self._low(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value's successor if that equals it, else -1 (the first index, if it repeats)."""
        high = values >> self.width
        if not self.n:
            return np.full(len(values), -1, np.int64)
        inside = high < self.zeros[-1]
        high = np.where(inside, high, 0)
        end = self._select(high, self.zeros, True) - high
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, True) - high + 1, 0)
        end = np.where(inside, end, start)
        wanted, stop = values & (1 << self.width) - 1, end
        while (start < end).any():
            middle = start + end >> 1
            less = (self._low(np.minimum(middle, self.n - 1)) < wanted) & (start < end)
            end = np.where(less | (start >= end), end, middle)
            start = np.where(less, middle + 1, start)
        hit = (start < stop) & (self._low(np.minimum(start, self.n - 1)) == wanted)
        return np.where(hit, start, -1)

    def decoded(self, start: int, stop: int) -> np.ndarray:
        """The values at ``start`` to ``stop`` - 1."""
        if stop <= start:
            return np.zeros(0, np.int64)
        first = int(np.searchsorted(self.ones, start, "right")) - 1
        last = int(np.searchsorted(self.ones, stop, "left"))
        place = np.flatnonzero(np.unpackbits(self.words[first:last].view(np.uint8), bitorder="little"))
        skip = start - int(self.ones[first])
        high = place[skip:skip + stop - start] + (first * 64 - start) - np.arange(stop - start)
        return (high << self.width) + self._low(np.arange(start, stop))

    def read(self, at: np.ndarray) -> np.ndarray:
        """Values at sorted indexes."""
        if len(at) * 64 < self.n:
            return self.access(at)
        out, i = np.empty(len(at), np.int64), 0
        while i < len(at):
            start = int(at[i])
            j = int(np.searchsorted(at, start + BLOCK))
            out[i:j] = self.decoded(start, int(at[j - 1]) + 1)[at[i:j] - start]
            i = j
        return out

    def seek(self, values: np.ndarray) -> np.ndarray:
        """:meth:`find` for sorted values."""
        if len(values) * 64 < self.n or not self.n:
            return self.find(values)
        starts = np.arange(0, self.n, BLOCK)
        # values up to a block's last stop in it
        cuts = np.searchsorted(values, self.access(np.minimum(starts + BLOCK, self.n) - 1), "right")
        out, i = np.full(len(values), -1, np.int64), 0
        for start, j in zip(starts.tolist(), cuts.tolist()):
            if j > i:
                block = self.decoded(start, min(start + BLOCK, self.n))
                at = np.searchsorted(block, values[i:j])
                out[i:j] = np.where(block[at] == values[i:j], start + at, -1)
                i = j
        return out
