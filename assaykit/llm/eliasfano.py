"""Elias-Fano coded monotone sequences in flat, memory-mappable arrays, queried many at a time.

A value's low bits are stored as they are; its high part in unary: per high value a one for each element and then a
zero. Element i's high bit is thus at high + i. Every RATE-th one and zero has its word noted, and each word the ones
before it, so that selecting is a short walk and a search within one word. Once a share of 1 / OFTEN of a sequence has
been asked for, it is decoded as a whole, which costs less than selecting each.
"""

from __future__ import annotations

import numpy as np

RATE = 64
OFTEN = 8
_PIECE = 1 << 17
_U = np.uint64
_HALVES = [(_U(h), _U((1 << h) - 1)) for h in (32, 16, 8, 4, 2, 1)]


def _nth_bit(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The place of the nth (from 0) set bit of each word."""
    at, n = np.zeros(len(word), np.uint64), n.astype(np.uint64)
    for half, mask in _HALVES:
        low = word & mask
        ones = np.bitwise_count(low).astype(np.uint64)
        up = n >= ones
        n = np.where(up, n - ones, n)
        word = np.where(up, word >> half, low)
        at += np.where(up, half, _U(0))
    return at.astype(np.int64)


class EliasFano:
    """A sequence that never falls. parts() and from_parts() give and take its arrays, which may be memory-mapped."""

    def __init__(self, header: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.header, self.low, self.high, self.before, self.ones, self.zeros = header, low, high, before, ones, zeros
        self.n, self.width = int(header[0]), int(header[1])
        self.top = int(header[2])
        self.asked, self.plain = 0, None

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        """values < universe < 2 ** 63."""
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        top = (int(universe) >> width) + 1
        at = (values >> _U(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(((n + top) // 64 + 1) * 64, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype(np.int64)
        off = np.flatnonzero(bits[: n + top] == 0)
        words = np.zeros(n * width // 64 + 2, np.uint64)
        for i in range(0, n, _PIECE) if width else ():
            place = np.arange(i, min(n, i + _PIECE), dtype=np.int64) * width
            rest = values[i : i + _PIECE] & _U((1 << width) - 1)
            word, shift = place >> 6, (place & 63).astype(np.uint64)
            np.bitwise_or.at(words, word, rest << shift)
            spill = np.flatnonzero((place & 63) + width > 64)
            np.bitwise_or.at(words, word[spill] + 1, rest[spill] >> (_U(64) - shift[spill]))
        return cls(np.array([n, width, top], np.int64), words, high, before, (at[::RATE] >> 6).astype(np.int64), (off[::RATE] >> 6).astype(np.int64))

    def parts(self) -> list[np.ndarray]:
        return [self.header, self.low, self.high, self.before, self.ones, self.zeros]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        place = i.astype(np.int64) * self.width
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        after = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return ((self.low[word] >> shift) | after) & _U((1 << self.width) - 1)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Where the kth one (or zero) is."""
        word = (self.ones if one else self.zeros)[k // RATE]
        todo = np.arange(len(k))
        while len(todo):
            w = word[todo] + 1
            passed = self.before[w] if one else (w << 6) - self.before[w]
            todo = todo[passed <= k[todo]]
            word[todo] += 1
        base = self.before[word] if one else (word << 6) - self.before[word]
        bits = self.high[word] if one else ~self.high[word]
        return (word << 6) + _nth_bit(bits, k - base)

    def decoded(self) -> np.ndarray:
        """All elements."""
        at = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))[: self.n]
        place = np.arange(self.n)
        return (((at - place).astype(np.uint64) << _U(self.width)) | self._low(place)).astype(np.int64)

    def _often(self, n: int) -> bool:
        self.asked += n
        if self.plain is None and self.asked * OFTEN >= self.n:
            self.plain = self.decoded()
        return self.plain is not None

    def access(self, i: np.ndarray) -> np.ndarray:
        """The elements at i."""
        i = i.astype(np.int64)
        if self._often(len(i)):
            return self.plain[i]
        return (((self._select(i, True) - i).astype(np.uint64) << _U(self.width)) | self._low(i)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """For each x the place of its successor, if that is x itself; else -1. x < universe."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        if self._often(len(x)):
            at = np.searchsorted(self.plain, x)
            return np.where(np.take(self.plain, at, mode="clip") == x, at, -1)
        x = x.astype(np.uint64)
        high, low = (x >> _U(self.width)).astype(np.int64), x & _U((1 << self.width) - 1)
        # the elements with this high part; in a dense stretch they are many, so their low bits are halved, not walked
        first = np.zeros(len(x), np.int64)
        later = np.flatnonzero(high > 0)
        first[later] = self._select(high[later] - 1, False) - high[later] + 1
        last = self._select(high, False) - high
        todo = np.flatnonzero(first < last)
        a, z, low = first[todo], last[todo], low[todo]
        while len(todo):
            middle = (a + z) >> 1
            here = self._low(middle)
            same = here == low
            out[todo[same]] = middle[same]
            less = here < low
            a, z = np.where(less, middle + 1, a), np.where(less, z, middle)
            go = np.flatnonzero((a < z) & ~same)
            todo, a, z, low = todo[go], a[go], z[go], low[go]
        return out
