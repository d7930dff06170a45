"""Near duplicates: fast similarity sketching, banding, exact verification.

Sketch (Dahlgaard, Knudsen, Thorup 2017). Round i < T hashes each shingle to one of T bins and to a value; a bin
keeps the least value of the first round that reached it. Round T + i throws all shingles into bin i, so every
coordinate is filled after 2 T rounds at the latest, mostly after one or two; the share of equal coordinates of two
sketches is concentrated about their Jaccard similarity as with T independent hash functions, at a cost of
O(n + T log T) instead of O(n T).

Banding. BANDS keys of WIDTH coordinates each; rows with equal shingle sets are one candidate. In each bucket the row
with the least number is the pivot, and all others are paired with it, so these pairs grow with the rows of a bucket,
not with their square. Pairs are verified by the exact Jaccard similarity of the shingle sets, and verified pairs are
joined into components.

What the pivots don't connect. In a bucket that still holds several components, any two rows of different ones may be
similar; where many documents share a passage they mostly aren't, and pairing them all would grow with their square. The
rows of such buckets are joined by prefixes instead, which is exact: with a set's shingles in one order, rarest first,
two sets of n >= m shingles and similarity t at least share one of the first n - ceil(t n) + 1 of the larger and
m - ceil(2 t m / (1 + t)) + 1 of the smaller, and what lies behind it must suffice. A shared passage is frequent and
last in the order, so it pairs nobody. Rarity is counted over these rows in COUNTERS counters; any one order is right.

Defined results. A group is a connected component of pairs with similarity >= threshold; the document with the least
id stays, a null id after all others, among equal ids the first in the scan. Texts of fewer than SHINGLE words are
sets of words. A null text, or one without words, is in no group. Repeated rows are a group. Empty tables give empty
results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .exchange import filter_rows, mark, materialise, small_batches, stable, with_row_id
from .text import buffers, chunks, distinct_shingles, mix64, shingles, word_hashes, word_spans

SHINGLE = 3
THRESHOLD = 0.6
BANDS = 32
WIDTH = 4
COUNTERS = 1 << 18
_SEEDS = mix64(np.arange(1, 2 * BANDS * WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW = np.uint64((1 << 40) - 1)


def sketch(values: np.ndarray, begin: np.ndarray, bins: int = BANDS * WIDTH) -> np.ndarray:
    """Sketches of many sets at once: values[begin[i]:begin[i + 1]] is set i. Rows of empty sets hold the largest number."""
    sets = len(begin) - 1
    out = np.full((sets, bins), np.iinfo(np.uint64).max, np.uint64)
    flat, of = out.ravel(), np.repeat(np.arange(sets), np.diff(begin))
    for i in range(2 * bins):
        if not len(values):
            break
        h = mix64(values ^ _SEEDS[i])
        at = (h >> np.uint64(44)).astype(np.int64) % bins if i < bins else i - bins
        np.minimum.at(flat, of * bins + at, (np.uint64(i) << np.uint64(40)) | (h & _LOW))
        left = (out == np.iinfo(np.uint64).max).any(axis=1)[of]
        values, of = values[left], of[left]
    return out


def _bands(sketches: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(sketches), BANDS)).copy()
    for j in range(WIDTH):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + sketches.reshape(-1, BANDS, WIDTH)[:, :, j])
    return keys


def _sketched(docs: DataFrame) -> DataFrame:
    """row, mark, doc_id, two halves of a digest of the set, keys: for each row with words."""
    schema = pa.schema([("row", pa.int64()), ("mark", pa.int64()), ("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = buffers(b.column(3))
            for i, j in chunks(offsets):
                part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                s, e, first = word_spans(part, at)
                values, begin = shingles(word_hashes(part, s, e), first, SHINGLE)
                some = np.flatnonzero(np.diff(begin))
                if not len(some):
                    continue
                sets = [np.unique(values[begin[a] : begin[a + 1]]) for a in some]
                begin = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                values = np.concatenate(sets)
                keys = _bands(sketch(values, begin))
                digest = [np.add.reduceat(mix64(values ^ np.uint64(x)), begin[:-1]).view(np.int64) for x in (0x51ED270B, 0xA0761D64)]
                where = pa.array(some + i)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(where) for c in range(3)), pa.array(digest[0]), pa.array(digest[1]), flat], schema=schema)

    return docs.select("row", mark("text"), "doc_id", F.lower("text").alias("text")).mapInArrow(run, "row long, mark long, doc_id long, d1 long, d2 long, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose texts' shingle sets have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fine = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(distinct_shingles(b.column(2), SHINGLE), distinct_shingles(b.column(3), SHINGLE))):
                if min(len(x), len(y)) >= threshold * max(len(x), len(y)) > 0:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    fine[i] = both >= threshold * (len(x) + len(y) - both)
            yield b.select(["u", "v"]).filter(pa.array(fine))

    joined = pairs.join(texts.toDF("u", "a"), "u").join(texts.toDF("v", "b"), "v").select("u", "v", "a", "b")
    return joined.mapInArrow(run, "u long, v long")


def _mixed(at: DataFrame, key: str) -> DataFrame:
    """The rows of at (key, rep, root) whose key has several roots, with main, the root that most of them have."""
    of = at.groupBy(key, "root").count().groupBy(key).agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("n"))
    return at.join(of.where("n > 1").drop("n"), key)


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """rep, root, n, key, place, leads: a row for each shingle of a set's prefix; leads: also of the prefix that the set
    has towards larger ones. sets has rep, root and text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for x in distinct_shingles(b.column(0), SHINGLE):
                np.add.at(seen, (x % np.uint64(COUNTERS)).astype(np.int64), 1)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["counter", "n"])

    counted = sets.select("text").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(COUNTERS, np.int64)
    often[counted["counter"]] = counted["n"]
    shared = sets.sparkSession.sparkContext.broadcast(often)
    schema = pa.schema([("rep", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("leads", pa.bool_())])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            parts, rows = [], []
            for i, x in enumerate(distinct_shingles(b.column(2), SHINGLE)):
                n = len(x)
                long, short = n - int(np.ceil(threshold * n - 1e-9)) + 1, n - int(np.ceil(2 * threshold / (1 + threshold) * n - 1e-9)) + 1
                x = x[np.lexsort((x, often[(x % np.uint64(COUNTERS)).astype(np.int64)]))][: min(n, long)]
                parts.append((x.view(np.int64), np.full(len(x), n), np.arange(len(x)), np.arange(len(x)) < short))
                rows.append(np.full(len(x), i))
            if rows:
                key, n, place, leads = (np.concatenate(c) for c in zip(*parts))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(n), pa.array(key), pa.array(place), pa.array(leads)], schema=schema)

    return sets.select("rep", "root", "text").mapInArrow(order, "rep long, root long, n long, key long, place long, leads boolean")


def _pairs_left(members: DataFrame, roots: DataFrame, texts: DataFrame, tried: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components among the rows of buckets that hold several, that may be similar and weren't tried."""
    at = members.join(roots, members.rep == roots.node, "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    open_ = _mixed(at, "key").select("rep", "root").distinct()
    sets = materialise(open_.join(texts.withColumnRenamed("row", "rep"), "rep"), "sets-left")
    held = materialise(_mixed(_prefixes(sets, threshold), "key"), "prefixes")
    x, y = (held.select("key", "main", *(F.col(c).alias(c + s) for c in ("rep", "root", "n", "place", "leads"))) for s in "xy")
    # of two sets the smaller has the shorter prefix; only what the most of a shingle's rows aren't in is paired with all
    apart = x.where("rootx != main").drop("main")
    smaller = "(ny < nx or ny = nx and repy < repx)"
    pairs = apart.join(y.where("leadsy"), "key").where(smaller).union(apart.where("leadsx").join(y, "key").where(f"not {smaller}"))
    least = threshold / (1 + threshold)
    close = (F.least("nx", "ny") >= threshold * F.greatest("nx", "ny") - 1e-9) & (F.least(F.col("nx") - F.col("placex"), F.col("ny") - F.col("placey")) >= least * (F.col("nx") + F.col("ny")) - 1e-9)
    found = pairs.where((F.col("rootx") != F.col("rooty")) & close).select(F.greatest("repx", "repy").alias("u"), F.least("repx", "repy").alias("v"))
    return found.distinct().join(tried, ["u", "v"], "left_anti")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document of a group but the one that stays: row, mark, doc_id, kept_doc_id, copies. docs must be stable()."""
    slim = with_row_id(small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "row")
    sketched = materialise(_sketched(slim), "sketches")
    alike = materialise(sketched.groupBy("d1", "d2").agg(F.min(F.struct("row", "keys")).alias("least")).select("d1", "d2", F.col("least.row").alias("rep"), F.col("least.keys").alias("keys")), "sets")

    placed = alike.select("rep", F.explode("keys").alias("key"))
    pivots = placed.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = materialise(placed.join(pivots, "key"), "buckets")
    star = members.where("rep != pivot").select(F.col("rep").alias("u"), F.col("pivot").alias("v")).distinct()

    candidates = members.select(F.col("rep").alias("row")).distinct().join(sketched.select("row", "mark"), "row")
    texts = materialise(filter_rows(slim.select("row", "text"), candidates, True).select("row", F.lower("text").alias("text")), "candidates")
    first = materialise(_verified(star, texts, threshold), "pairs")
    left = materialise(_pairs_left(members.select("key", "rep"), connected_components(first), texts, star, threshold), "pairs-left")
    second = _verified(left, texts, threshold)
    roots = connected_components(first.union(second))

    group = sketched.join(alike.select("d1", "d2", "rep"), ["d1", "d2"]).join(roots, F.col("rep") == roots.node, "left")
    group = group.select("row", "mark", "doc_id", F.coalesce("root", "rep").alias("root"))
    kept = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    groups = group.groupBy("root").agg(kept.alias("kept"), F.count("*").alias("copies")).where("copies > 1")
    out = group.join(groups, "root").where("row != kept.row")
    return out.select("row", "mark", "doc_id", F.col("kept.doc_id").alias("kept_doc_id"), "copies")


def find_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, kept_doc_id, copies for each document that is dropped; see the module's text for edge cases."""
    return near_duplicates(stable(docs), id_col, text_col, threshold).drop("row", "mark")


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """find_near_duplicates() of the table documents in DuckDB, by all pairs that share a shingle. Banding finds a pair at the
    threshold with probability 0.988, so this is what the search comes to where it misses none."""
    return rf"""
        WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10ffff}}]+') AS w FROM documents WHERE text IS NOT NULL),
        sh AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= {SHINGLE} THEN [array_to_string(w[i:i+{SHINGLE - 1}], ' ') FOR i IN range(1, len(w) - {SHINGLE - 2})] ELSE w END) AS s FROM w),
        sizes AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
        shared AS (SELECT a.id AS u, b.id AS v, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
        edges AS (SELECT u, v FROM shared JOIN sizes x ON x.id = u JOIN sizes y ON y.id = v WHERE k >= {threshold} * (x.n + y.n - k)),
        both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
        reach(id, root) AS (SELECT u, u FROM both_ways UNION SELECT b.v, r.root FROM reach r JOIN both_ways b ON b.u = r.id),
        grouped AS (SELECT id, min(root) AS kept FROM reach GROUP BY id)
        SELECT id AS doc_id, kept AS kept_doc_id, count(*) OVER (PARTITION BY kept) AS copies FROM grouped QUALIFY id <> kept"""


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows of find_near_duplicates, with all columns as they were."""
    docs = stable(docs)
    return filter_rows(docs, near_duplicates(docs, id_col, text_col, threshold), False, text_col)
