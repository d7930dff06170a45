"""Whole-batch text kernels over Arrow string buffers.

A word is a maximal run of ASCII letters and digits or of code points above U+007F, in lower case. Words are
hashed straight from the UTF-8 buffer with a polynomial prefix hash, so no Python string is made per word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
WORD_RE = re.compile("[0-9a-z\u0080-\U0010ffff]+")

_WORD_BYTE = np.zeros(256, bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _WORD_BYTE[_c] = True
_WORD_BYTE[128:] = True

_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, CHUNK_BYTES + 1), np.uint64)
        out[0], filled = 1, 1
        while filled < len(out):
            take = min(filled, len(out) - filled)
            out[filled : filled + take] = out[:take] * np.uint64(pow(base, filled, 1 << 64))
            filled += take
        _powers[base] = have = out
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; a null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    """The bytes with A to Z as small letters, each in its place."""
    return _SMALL[raw]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most so many bytes, or one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row where its words begin in these (n + 1 numbers)."""
    inside = _WORD_BYTE[raw]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers_of(_BASE, len(raw)), out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _powers_of(_BASE_INV, len(raw) + 1)[starts])


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, row by row, and where each row's begin. A row of fewer words gives its words."""
    counts = np.diff(first)
    run = hashes.copy()
    for j in range(1, k):
        run[: len(run) - j] = run[: len(run) - j] * np.uint64(0xD6E8FEB86659FD93) + hashes[j:]
    run = mix64(run)
    row = np.repeat(np.arange(len(counts)), counts)
    ordinal = np.arange(len(hashes)) - first[:-1][row]
    short = (counts < k)[row]
    run[short] = hashes[short]
    keep = short | (ordinal <= counts[row] - k)
    out = np.where(counts < k, counts, counts - k + 1)
    return run[keep], np.concatenate([[0], np.cumsum(out)]).astype(np.int64)


def distinct_shingles(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each (lower-case) text the sorted distinct hashes of its word k-shingles."""
    raw, offsets = buffers(texts)
    for i, j in chunks(offsets):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, first = word_spans(part, at)
        run, begin = shingles(word_hashes(part, s, e), first, k)
        for a in range(j - i):
            yield np.unique(run[begin[a] : begin[a + 1]])
