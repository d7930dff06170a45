"""License scans: MinHash over overlapping windows retrieves templates, exact shingle containment verifies them.

A document's word 3-shingles are cut into segments of HALF; two segments in a row are a window, so windows overlap by
half and every run of HALF shingles lies within one. Templates are cut into pieces of HALF shingles at most. Each of
BANDS hash functions is a band of one row: a window retrieves a template if for one function its least value is a
piece's. A piece of m shingles in a window of at most 2 HALF is missed by all with probability (1 - m / (2 HALF)) **
BANDS at most: under 0.3 % for three shingles, 2 % for two, 1e-19 for a full piece, and a long template has many
pieces. A retrieved template is then looked for around its windows: the share of its distinct shingles that occur
within a stretch of 1.5 times its length must be CONTAINED at least; of a template of fewer than SHORT shingles all must,
for one word of a statement tells the version.

Templates: the full texts in license_files, and the grants, notices, statements and SPDX tags of license_texts. The many
wordings of a license's statement have one name.

Defined results. Null texts and texts of fewer than 3 words hold no license. Passages of one name that overlap
are one row, with the best containment; two licenses may claim one passage. Repeated rows are each reported. An
empty table or no templates give an empty result. Other columns are ignored, whatever their names. The letters A to Z
count as the small ones. Places count Unicode code points of the text as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import small_batches
from .license_texts import templates as known_templates
from .text import ascii_lower, buffers, chunks, mix64, shingles, word_hashes, word_spans

SHINGLE = 3
HALF = 16
BANDS = 64
CONTAINED = 0.8
SHORT = 20
_ODD = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SIEVE = 1 << 16


def template_shingles(text: str) -> np.ndarray:
    raw, offsets = buffers(pa.array([text]))
    raw = ascii_lower(raw)
    s, e, first = word_spans(raw, offsets)
    return shingles(word_hashes(raw, s, e), first, SHINGLE)[0]


class Templates:
    """The templates' shingle sets, and by hash function the sorted least values of their pieces."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        runs = [template_shingles(texts[n]) for n in self.names]
        self.sets = [np.unique(r) for r in runs]
        self.lengths = [len(r) for r in runs]
        pieces = [(r[i : i + HALF], t) for t, r in enumerate(runs) for i in range(0, max(1, len(r) - HALF // 2), HALF)]
        of, least = np.array([t for _, t in pieces], int), np.array([[(p * m).min() for p, _ in pieces] for m in _ODD], np.uint64).reshape(BANDS, -1)
        order = np.argsort(least, axis=1, kind="stable")
        self.least, self.of = np.take_along_axis(least, order, 1), of[order]
        self.sieve = np.zeros((BANDS, _SIEVE), bool)
        for b in range(BANDS):
            self.sieve[b, (self.least[b] & np.uint64(_SIEVE - 1)).astype(int)] = True

    def retrieve(self, values: np.ndarray, begin: np.ndarray) -> set[tuple[int, int, int]]:
        """(row, first shingle of the window within the row, template)."""
        counts = np.diff(begin)
        per_row = -(-counts // HALF)
        row = np.repeat(np.arange(len(counts)), per_row)
        ordinal = np.arange(per_row.sum()) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        found: set[tuple[int, int, int]] = set()
        if not len(row) or not len(self.of):
            return found
        starts = begin[:-1][row] + ordinal * HALF
        joined = np.flatnonzero(row[1:] == row[:-1])
        for b in range(BANDS):
            least = np.minimum.reduceat(values * _ODD[b], starts)
            window = least.copy()
            window[joined] = np.minimum(least[joined], least[joined + 1])
            some = np.flatnonzero(self.sieve[b][(window & np.uint64(_SIEVE - 1)).astype(np.int64)])
            low, high = (np.searchsorted(self.least[b], window[some], side) for side in ("left", "right"))
            for k in np.flatnonzero(low < high):
                at = int(row[some[k]]), int(ordinal[some[k]]) * HALF
                found.update((*at, int(t)) for t in self.of[b, low[k] : high[k]])
        return found

    def passages(self, run: np.ndarray, t: int, first: int, last: int) -> list[tuple[int, int, float]]:
        """First and last shingle and containment of the passages of template t about the shingles first to last of a
        row's; of those that overlap the best."""
        size, reach = len(self.sets[t]), self.lengths[t] * 3 // 2 + SHINGLE
        needed = CONTAINED if size >= SHORT else 1
        low = max(0, first - reach)
        part = run[low : last + 2 * HALF + reach]
        hits = np.flatnonzero(np.isin(part, self.sets[t]))
        values, i, out = part[hits].tolist(), 0, []
        inside: dict[int, int] = {}
        for j, (h, v) in enumerate(zip(hits.tolist(), values)):
            inside[v] = inside.get(v, 0) + 1
            while hits[i] + reach < h:
                inside[values[i]] -= 1
                if not inside[values[i]]:
                    del inside[values[i]]
                i += 1
            share = len(inside) / size
            if share >= needed:
                a = low + int(hits[i])
                if out and a <= out[-1][1]:
                    if share > out[-1][2]:
                        out[-1] = (a, low + h, share)
                else:
                    out.append((a, low + h, share))
        return out


def scan(row_values: np.ndarray, begin: np.ndarray, templates: Templates) -> list[tuple[int, str, int, int, float]]:
    """(row, name, first shingle, last shingle, containment)."""
    at: dict[tuple[int, int], list[int]] = {}
    for row, place, t in sorted(templates.retrieve(row_values, begin)):
        at.setdefault((row, t), []).append(place)
    found: dict[tuple[int, str], list[tuple[int, int, float]]] = {}
    for (row, t), places in at.items():
        run, reach = row_values[begin[row] : begin[row + 1]], 3 * templates.lengths[t] + 2 * (SHINGLE + HALF)
        cuts = [0, *(np.flatnonzero(np.diff(places) > reach) + 1).tolist(), len(places)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            found.setdefault((row, templates.names[t].partition(":")[0]), []).extend(templates.passages(run, t, places[i], places[j - 1]))
    out = []
    for (row, name), passages in found.items():
        merged: list[tuple[int, int, float]] = []
        for a, z, share in sorted(passages):
            if merged and a <= merged[-1][1]:
                if (share, z - a) > (merged[-1][2], merged[-1][1] - merged[-1][0]):
                    merged[-1] = a, z, share
            else:
                merged.append((a, z, share))
        out += [(row, name, *p) for p in merged]
    return out


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, start, end, containment: a row for each passage of a template."""
    templates = Templates(known_templates() if texts is None else texts)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = buffers(b.column(1))
            out = []
            for i, j in chunks(offsets):
                part, at = ascii_lower(raw[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
                s, e, first = word_spans(part, at)
                values, begin = shingles(word_hashes(part, s, e), first, SHINGLE)
                for row, name, a, z, share in scan(values, begin, templates):
                    start, end = s[first[row] + a], e[min(first[row] + z + SHINGLE, first[row + 1]) - 1]
                    points = lambda x: int(((part[at[row] : x] & 0xC0) != 0x80).sum())  # noqa: B023, E731
                    out.append((b.column(0)[i + row].as_py(), name, points(start), points(end), share))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    slim = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, license string, start long, end long, containment double")
