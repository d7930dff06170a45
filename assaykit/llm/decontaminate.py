"""Benchmark decontamination with one Aho-Corasick automaton.

A passage is a run of WINDOW words or more of a normalised question or answer, or the whole item if it is shorter, however
short. Normalised means: lower case, words (runs of Unicode letters, digits and underscores) joined by single spaces.

The automaton holds each item's words in pieces of half a window, so it is as large as the benchmark and not WINDOW times
that: a run of WINDOW words has a whole piece in it. Every document is normalised and scanned once; a piece that is met is
extended to both sides word by word, and what reaches the length is a passage. Its place is mapped back to the original
through the words' ordinal numbers; passages of one item that overlap or touch are one.

The benchmark is written to the shared folder once; each Python worker reads it there and builds the one automaton, some
60 bytes a character, for all its tasks. Nothing of it passes through the driver.

drop_contaminated() drops a document for a passage of at least DROP words: a short answer is found in clean texts too, so
it is reported, and the reader decides.

Defined results. A null or wordless text has no passage, nor has a null or wordless item; items with equal words are
reported each, an item with a null id under that. Repeated rows are each reported. Empty tables give empty results.
Other columns are ignored, whatever their names. Places count Unicode code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import filter_rows, mark, shared_path, small_batches, stable, with_row_id

WINDOW = 13
DROP = 8
_GAP = re.compile(r"\W+")
_WORD = re.compile(r"\w+")


def lower(text: str) -> str:
    """Lower case of the same length: a code point whose lower case is longer stays."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def normalise(text: str) -> str:
    """The words, each with a space before and one at the end."""
    return f" {_GAP.sub(' ', lower(text)).strip()} "


class Machine:
    """The automaton over the items' pieces."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.ids = [item for item, _ in items]
        self.words = [normalise(text or "").split() for _, text in items]
        self.needed = [min(window, len(w)) for w in self.words]
        self.pieces = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for k, (words, needed) in enumerate(zip(self.words, self.needed)):
            size = (needed + 1) // 2 if len(words) > needed else needed
            for i in range(0, len(words) - size + 1, size) if size else ():
                held.setdefault(f" {' '.join(words[i : i + size])} ", []).append((k, i))
        for piece, whose in held.items():
            self.pieces.add_word(piece, (piece.count(" ") - 1, whose))
        if held:
            self.pieces.make_automaton()

    def passages(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item, start, end, words) of each passage of text."""
        if not len(self.pieces):
            return []
        plain = normalise(text)
        runs: dict[int, list[tuple[int, int]]] = {}
        reached: dict[tuple[int, int], int] = {}
        done = ordinal = 0
        there: list[str] | None = None
        for end, (size, whose) in self.pieces.iter(plain):
            ordinal += plain.count(" ", done, end)
            done = end
            at = ordinal - size
            there = plain.split() if there is None else there
            for k, i in whose:
                if reached.get((k, at - i), -1) >= ordinal:  # within a run that is known
                    continue
                words, a, z = self.words[k], at, ordinal
                while a > 0 and i > 0 and there[a - 1] == words[i - 1]:
                    a, i = a - 1, i - 1
                while z < len(there) and i + z - a < len(words) and there[z] == words[i + z - a]:
                    z += 1
                reached[k, a - i] = z
                if z - a >= self.needed[k]:
                    runs.setdefault(k, []).append((a, z))
        if not runs:
            return []
        places = [m.span() for m in _WORD.finditer(lower(text))]
        out = []
        for k, found in runs.items():
            merged: list[list[int]] = []
            for a, z in sorted(found):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            out += [(self.ids[k], places[a][0], places[z - 1][1], z - a) for a, z in merged]
        return sorted(out, key=lambda p: (p[1:], p[0] is None, p[0] or 0))


_built: tuple[str, Machine] | None = None


def _machine(path: str, window: int) -> Machine:
    """The machine of the benchmark at path, built once in a worker."""
    global _built
    if _built is None or _built[0] != f"{path} {window}":
        _built = None
        system, at = fs.FileSystem.from_uri(path)
        table = ds.dataset(at, filesystem=system, format="parquet").to_table(["item", "text"])
        _built = f"{path} {window}", Machine(list(zip(table.column("item").to_pylist(), table.column("text").to_pylist())), window)
    return _built[1]


def _passages(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_texts: tuple[str, ...], window: int) -> DataFrame:
    """row, mark, doc_id, item_id, start, end, words."""
    slim = with_row_id(small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "row").select("row", mark("text"), "doc_id", "text")
    path = shared_path(docs.sparkSession, "benchmark")
    items = F.explode(F.array(*(F.col(c).cast("string") for c in item_texts)))
    benchmark.select(F.col(item_col).cast("long").alias("item"), items.alias("text")).where("text is not null").write.parquet(path)
    schema = pa.schema([("row", pa.int64()), ("mark", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("item_id", "start", "end", "words"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(path, window)
        for b in batches:
            rows = [(i, *p) for i, text in enumerate(b.column(3).to_pylist()) if text for p in machine.passages(text)]
            if rows:
                at, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in range(3)), *(pa.array(x, pa.int64()) for x in rest)], schema=schema)

    found = slim.mapInArrow(run, "row long, mark long, doc_id long, item_id long, start long, end long, words long")
    return found.distinct() if len(item_texts) > 1 else found


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_texts: tuple[str, ...] = ("text",), window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, start, end (places in the original text), words: a row for each passage of an item."""
    return _passages(docs, benchmark, id_col, text_col, item_col, item_texts, window).drop("row", "mark")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_texts: tuple[str, ...] = ("text",), window: int = WINDOW, least: int = DROP) -> DataFrame:
    """docs without those that hold a passage of at least so many words, with all columns as they were."""
    docs = stable(docs)
    dirty = _passages(docs, benchmark, id_col, text_col, item_col, item_texts, window).where(F.col("words") >= least).select("row", "mark").distinct()
    return filter_rows(docs, dirty, False, text_col)


def oracle_sql(window: int = WINDOW) -> str:
    """find_contamination() of the tables documents and benchmark in DuckDB, for texts whose lower case is as long as they
    are: all runs of window words side by side."""
    letter = r"\p{L}\p{N}_"
    words = f"regexp_extract_all(lower(text), '[{letter}]+')"
    return f"""
        WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL),
        sized AS (SELECT item_id, w, least({window}, len(w)) AS k FROM i WHERE len(w) > 0),
        runs AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS run FROM sized, unnest(range(1, len(w) - k + 2)) t(j)),
        there AS (SELECT doc_id, k, j AS a, array_to_string(w[j:j + k - 1], ' ') AS run FROM d, (SELECT DISTINCT k FROM sized) s, unnest(range(1, len(w) - k + 2)) t(j)),
        hits AS (SELECT doc_id, item_id, a, a + k AS z FROM there JOIN runs USING (k, run)),
        begun AS (SELECT *, CASE WHEN a <= lag(z) OVER (PARTITION BY doc_id, item_id ORDER BY a) THEN 0 ELSE 1 END AS b FROM hits),
        grouped AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, item_id ORDER BY a) AS g FROM begun),
        passages AS (SELECT doc_id, item_id, min(a) AS a, max(z) - 1 AS last FROM grouped GROUP BY doc_id, item_id, g),
        pieces AS (SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS o FROM (
            SELECT doc_id, regexp_extract_all(text, '[{letter}]+|[^{letter}]+') AS p FROM documents WHERE doc_id IN (SELECT doc_id FROM hits))),
        placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY o) AS past FROM pieces),
        ordinal AS (SELECT doc_id, past - length(piece) AS begins, past AS ends, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS n FROM placed WHERE regexp_matches(piece, '^[{letter}]'))
        SELECT p.doc_id, p.item_id, CAST(x.begins AS BIGINT) AS start, CAST(y.ends AS BIGINT) AS "end", CAST(p.last - p.a + 1 AS BIGINT) AS words
        FROM passages p JOIN ordinal x ON x.doc_id = p.doc_id AND x.n = p.a JOIN ordinal y ON y.doc_id = p.doc_id AND y.n = p.last"""
