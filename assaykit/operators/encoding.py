"""Bytes of whole files, block by block: NULL bytes, byte-order marks, invalid UTF-8, and text decoded with the wrong code
page."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import redact
from ..functions.text import occurrences
from ..sources import storage

#: What UTF-8 looks like if it was read as Windows-1252.
MOJIBAKE = (
    "\u00c2",
    *(c.encode("utf-8").decode("cp1252") if c != "\u201d" else "\u00e2\u20ac\u009d" for c in "\u2019\u201c\u201d\u2013\u2014\u00e9\u00e8\u00f1\ufeff"),
)
_BOM = b"\xef\xbb\xbf"


def mojibake_counts(text: Column) -> Column:
    """An array of (pattern, n) for one text."""
    return F.array(*(F.struct(F.lit(p).alias("pattern"), occurrences(text, p).alias("n")) for p in MOJIBAKE))


#: Bytes that a task scans, and those it reads beyond on either side: a sample's surroundings.
BLOCK = 64 << 20
AROUND = 512
#: Bytes of a block that are in memory at once, besides those around them.
WINDOW = 2 << 20
_SCANNED = "file string, key string, at bigint, n bigint, sample string"


def _edge(data: bytes, at: int) -> int:
    """The first place from at on where a character may begin; three bytes on at most."""
    end = min(len(data), at + 3)
    while at < end and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def scan_block(data: bytes, start: int, begin: int, end: int) -> Iterator[tuple[str, int, int, str | None]]:
    """key, place of the first, count, sample of what is found in data[begin:end]; data begins at start in its file and
    goes on behind end. What begins in the block is the block's."""
    a, z = (0 if start == begin == 0 else _edge(data, begin)), _edge(data, end) if end < len(data) else end
    if n := data.count(b"\0", begin, end):
        yield "null_bytes", start + data.find(b"\0", begin), n, None
    leading = start == begin == 0 and data.startswith(_BOM)
    if leading:
        yield "bom_at_start", 0, 1, None
    if n := data.count(_BOM, begin, min(len(data), end + 2)) - leading:
        yield "stray_bom", start + begin, n, None
    piece = data[a:]
    try:
        piece.decode("utf-8")
    except UnicodeDecodeError as error:
        # what lies behind the block is the next one's; a character cut off by the end of what was read is no error
        if error.start < z - a:
            at = start + a + error.start
            where = f"position {at}" if error.end - error.start == 1 else f"position {at}-{start + a + error.end - 1}"
            byte = f"byte 0x{piece[error.start]:02x}" if error.end - error.start == 1 else "bytes"
            said = f"'utf-8' codec can't decode {byte} in {where}: {error.reason}"
            yield "invalid_utf8", at, 1, json.dumps({"message": said, "hex": data[max(0, a + error.start - 40) : a + error.end + 40].hex()})
    before, own, after = data[:a].decode("utf-8", "replace"), data[a:z].decode("utf-8", "replace"), data[z:].decode("utf-8", "replace")
    text = before + own + after
    for p in MOJIBAKE:
        low, high = len(before), min(len(text), len(before) + len(own) + len(p) - 1)
        if n := text.count(p, low, high):
            at = text.find(p, low)
            yield f"mojibake:{p}", start + a + len(text[low:at].encode()), n, redact(text[max(0, at - 80) : at + 120])


def scan_windows(file: str, start: int, size: int) -> list[list]:
    """file, key, at, n, sample of what is found in the block at start of a file of that size, read window by window."""
    found: dict[str, list] = {}
    for begin in range(start, min(size, start + BLOCK), WINDOW):
        low, end = max(0, begin - AROUND), min(size, start + BLOCK, begin + WINDOW)
        data = storage.read_range(file, low, end - low + AROUND)
        for key, at, n, sample in scan_block(data, low, begin - low, end - low):
            if key not in found:
                found[key] = [file, key, at, n, sample]
            elif key != "invalid_utf8":  # told once a block
                found[key][3] += n
    return list(found.values())


def scan_blocks(blocks: DataFrame) -> DataFrame:
    """file, key, n, sample: what is found in each file, summed over its blocks; the sample is the first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, start, size in zip(b["file"], b["start"].tolist(), b["size"].tolist()):
                if found := scan_windows(file, start, size):
                    yield pd.DataFrame(found, columns=["file", "key", "at", "n", "sample"])

    return blocks.mapInPandas(run, _SCANNED).groupBy("file", "key").agg(F.sum("n").alias("n"), F.min_by("sample", "at").alias("sample"))


def told(rows: list) -> tuple[list[dict], dict[str, int]]:
    """Issues and counts of one file from its rows of scan_blocks()."""
    found, issues, counts = {r["key"]: r for r in rows}, [], {}

    def note(severity: str, key: str, pattern: str, message: str, **more) -> None:
        counts[key] = found[key]["n"]
        issues.append({"severity": severity, "pattern": pattern, "message": message, "count": found[key]["n"], **more})

    if "null_bytes" in found:
        note("CRITICAL", "null_bytes", "NULL byte", "NULL bytes present")
    if "bom_at_start" in found:
        note("WARNING", "bom_at_start", "BOM", "UTF-8 BOM at start of file")
    if "stray_bom" in found:
        note("WARNING", "stray_bom", "stray BOM", "BOM occurs after the start of the file")
    if "invalid_utf8" in found:
        said = json.loads(found["invalid_utf8"]["sample"])
        issues.append({"severity": "CRITICAL", "pattern": "invalid_utf8", "message": said["message"], "sample_bytes_hex": said["hex"]})
    for p in MOJIBAKE:
        if f"mojibake:{p}" in found:
            note("WARNING", f"mojibake:{p}", p, "the text looks decoded with the wrong code page", samples=[found[f"mojibake:{p}"]["sample"]])
    return issues, counts
