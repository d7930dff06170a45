"""Groups of records whose leading texts share most word 5-grams.

The exact join: records with equal shingle sets are one. With the shingles of all sets in one order, rarest first, two
sets of n >= m shingles and similarity t must share one of the first n - ceil(t n) + 1 of the larger and of the first
m - ceil(2 t m / (1 + t)) + 1 of the smaller, and what lies behind the first that they share must suffice; so only these
are joined, and each pair is verified. Rarity keeps apart what only has boilerplate in common: it comes last in the order,
and nobody's prefix reaches it. It is counted in COUNTERS counters, whatever the input; any order gives the same pairs.
Pairs become groups as connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from ..functions.records import primary_text
from ..functions.text import words
from .components import connected_components
from .shared import ensure_checkpoints

SHINGLE = 5
COUNTERS = 1 << 16
BITS = 1 << 25
MISSED = 0.001
_SLACK = 1e-9


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingled(values: np.ndarray, sizes: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Of records' word hashes, one record after another, with the numbers of their words: the sorted distinct hashes of each
    record's runs of n words, and how many these are; the words' own hashes of a record with fewer words."""
    short = sizes < n
    runs = np.where(short, sizes, sizes - (n - 1))
    words, whole = values.view(np.uint64), max(len(values) - (n - 1), 0)
    held = words[:whole]
    for i in range(1, n):
        held = _mixed(held) ^ words[i : whole + i]
    starts = np.cumsum(sizes) - sizes
    out = np.where(np.repeat(short, sizes), words, np.concatenate([_mixed(held), words[whole:]]))
    # runs over the end of a record are none
    out = out[np.arange(len(values)) - np.repeat(starts, sizes) < np.repeat(runs, sizes)].view(np.int64)
    ends = np.cumsum(runs)
    for a, b in zip((ends - runs).tolist(), ends.tolist()):
        out[a:b].sort()
    first = np.ones(len(out), bool)
    first[1:] = out[1:] != out[:-1]
    first[(ends - runs)[runs > 0]] = True
    before = np.concatenate([[0], np.cumsum(first)])
    return out[first], before[ends] - before[ends - runs]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the lists' sizes."""
    return column.flatten().to_numpy(), column.value_lengths().to_numpy().astype(np.int64)


def _ddl(df: DataFrame, names: list[str]) -> str:
    of = {f.name: f.dataType.simpleString() for f in df.schema}
    return "".join(f"`{c}` {of[c]}, " for c in names)


def with_sets(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys and set: the sorted hashes of the record's shingles. Blank and unreadable rows have empty sets and stay."""
    hashed = records.select(*keys, F.transform(words(primary_text(F.col("fields"))), lambda t: F.xxhash64(t)).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), _lists(*shingled(*_flat(b.column("words"))))], [*keys, "set"])

    return small_batches(hashed).mapInArrow(run, _ddl(hashed, keys) + "set array<bigint>")


def _often(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each counter occur, in quarters of powers of two, 7 bits each."""
    counter = F.pmod(F.col("shingle"), F.lit(COUNTERS)).cast("int").alias("counter")
    often = np.zeros(COUNTERS, np.int64)
    for r in sets.select(F.explode("set").alias("shingle")).groupBy(counter).agg(F.count("*").alias("n")).collect():
        often[r["counter"]] = min(127, int(4 * math.log2(1 + r["n"])))
    return often


def prefixes(sets: DataFrame, threshold: float, group: list[str]) -> DataFrame:
    """group, id, n, place, head: the first of each set's shingles, rarest first, as numbers. A number's upper 7 bits tell how
    often its counter's shingles occur; the rest is the hash's. Shingles that share a number are as one for the prefixes,
    which so can only find more pairs. sets: group, id, set, not empty."""
    often, keys = _often(sets), [*group, "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, n = _flat(b.column("set"))
            number = often[values & (COUNTERS - 1)] << 56 | (values.view(np.uint64) >> np.uint64(8)).view(np.int64)
            ends = np.cumsum(n)
            for a, e in zip((ends - n).tolist(), ends.tolist()):
                number[a:e].sort()
            long = (n - np.ceil(threshold * n - _SLACK) + 1).astype(np.int64)
            place = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
            head = number[np.repeat(ends - n, long) + place]
            of = pa.array(np.repeat(np.arange(b.num_rows), long))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in keys), pa.array(np.repeat(n, long)), pa.array(place), pa.array(head)], [*keys, "n", "place", "head"])

    return small_batches(sets.select(*keys, "set")).mapInArrow(run, _ddl(sets, keys) + "n bigint, place bigint, head bigint")


def candidate_pairs(sets: DataFrame, threshold: float, group: list[str]) -> DataFrame:
    """u, v: the pairs of sets with something in the prefixes that such a similarity takes; sets: group, id, set, not empty."""
    t = float(threshold)
    # nothing is null; said of both sides, as the join would say it of one, so that one shuffle serves for both
    heads = prefixes(sets, t, group).where(" and ".join(f"{c} is not null" for c in ("id", "n", "place", "head")))
    side = lambda s: heads.select(*group, "head", *(F.col(c).alias(c + s) for c in ("id", "n", "place")))
    # asked of both sides together, so that it isn't asked before the shuffle: one serves for both
    leads = F.col("placey") + F.least("placex", F.lit(0)) <= F.col("ny") - F.ceil(F.lit(2 * t / (1 + t)) * F.col("ny") - F.lit(_SLACK))
    pairs = side("x").join(side("y"), [*group, "head"]).where("ny < nx or ny = nx and idy < idx").where(leads)
    close = (F.col("ny") >= F.lit(t) * F.col("nx") - F.lit(_SLACK)) & (F.least(F.col("nx") - F.col("placex"), F.col("ny") - F.col("placey")) >= F.lit(t / (1 + t)) * (F.col("nx") + F.col("ny")) - F.lit(_SLACK))
    return pairs.where(close).select(F.least("idx", "idy").alias("u"), F.greatest("idx", "idy").alias("v")).distinct()


def similar_pairs(sets: DataFrame, threshold: float, group: list[str]) -> DataFrame:
    """u, v (numbers in column id) and similarity of all pairs of one group at threshold or more, u < v. sets: group, id,
    set, one row for each distinct set of a group. Empty sets are in no pair: those of a group are one set."""
    some = sets.where(F.size("set") > 0).select(*group, "id", "set")
    return _verified(some, candidate_pairs(some, threshold, group), threshold)


def _in_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """id and set of the sets that are in a pair: a bitmap of BITS, whatever the input, tells them; the few others that it
    lets through meet nobody."""
    at = F.pmod(F.xxhash64("id"), F.lit(BITS))
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).select(at.alias("at"))
    held = bytearray(BITS // 8)
    for r in ids.groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits")).collect():
        held[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    byte = F.conv(F.hex(F.substring(F.lit(bytes(held)), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return sets.where(F.call_function("getbit", byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1).select("id", "set")


def with_parities(sets: DataFrame) -> DataFrame:
    """id, n and parities of sets: a bit for each value that the low bits of a hash can have, in words of 64, telling whether an
    odd number of hashes has it. There are as many bits as hashes, at most twice as many, always a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, n = _flat(b.column("set"))
            values = values.view(np.uint64)
            wide = 1 << np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(wide)])
            place = (values & np.repeat(64 * wide - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(64 * starts[:-1], n)
            odd = (np.bincount(place, minlength=64 * int(starts[-1])) & 1).astype(np.uint8)
            words = pa.array(np.packbits(odd, bitorder="little").view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), words)], ["id", "n", "parities"])

    return small_batches(sets.select("id", "set")).mapInArrow(run, "id long, n long, parities array<bigint>")


def _maybe_similar(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """pairs without those whose parities tell that they are less similar. Sets that differ in d hashes differ in d bits at
    most, however many of them there are; of a longer one, the halves are put together. Parities take a 64th or a 32nd of
    the sets, so only sets that are similar, or nearly so, are moved."""
    told = with_parities(_in_pairs(sets, pairs))
    both = pairs.join(told.toDF("u", "nu", "pu"), "u").join(told.toDF("v", "nv", "pv"), "v")
    longer = F.size("pu") >= F.size("pv")
    long, short = F.when(longer, F.col("pu")).otherwise(F.col("pv")), F.when(longer, F.col("pv")).otherwise(F.col("pu"))
    xor, half = lambda a, b: a.bitwiseXOR(b), F.size(short)
    even = F.when(F.size(long) == half, long).when(F.size(long) == 2 * half, F.zip_with(F.slice(long, F.lit(1), half), F.slice(long, half + 1, half), xor))
    differ = F.aggregate(F.zip_with(even, short, xor), F.lit(0), lambda n, x: n + F.bit_count(x))
    most = F.lit((1 - threshold) / (1 + threshold)) * (F.col("nu") + F.col("nv")) + F.lit(_SLACK)
    return both.where(F.coalesce(differ <= most, F.lit(True))).select("u", "v")


def _verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs that are as similar."""
    ensure_checkpoints(sets.sparkSession)
    pairs = _maybe_similar(sets, pairs.checkpoint(), threshold).checkpoint()
    sides = _in_pairs(sets, pairs)
    joined = pairs.join(sides.toDF("u", "x"), "u").join(sides.toDF("v", "y"), "v")
    both = F.size(F.array_intersect("x", "y"))
    scored = joined.withColumn("similarity", both / (F.size("x") + F.size("y") - both))
    return scored.where(F.col("similarity") >= threshold).select("u", "v", "similarity")


def clusters(records: DataFrame, threshold: float = 0.85, across: bool = False, method: str = "exact", num_perm: int = 128) -> DataFrame:
    """file, idx, cluster (the least number of its records) and size of each record in a group of two or more, within
    files or across them all."""
    ensure_checkpoints(records.sparkSession)
    number = (F.shiftleft(F.col("file_ord").cast("long"), 40) + F.col("idx")).alias("id")
    # the sets are used several times; a checkpoint spares the texts as many scans
    group = [] if across else ["file"]
    digest = [F.xxhash64("set").alias("d1"), F.xxhash64(F.lit(1), F.col("set")).alias("d2")]
    sets = with_sets(records.select("file", "file_ord", "idx", "line", "fields", number), ["file", "idx", "line", "id"]).select("*", *digest).checkpoint()
    alike = sets.groupBy(*group, "d1", "d2").agg(F.min("id").alias("id"), F.min_by("set", "id").alias("set")).checkpoint()
    if method == "lsh":
        pairs = lsh_pairs(alike, threshold, group, num_perm)
    else:
        pairs = similar_pairs(alike, threshold, group)
    roots = connected_components(pairs.select("u", "v"))
    member = sets.drop("set").join(alike.select(*group, "d1", "d2", F.col("id").alias("rep")), [*group, "d1", "d2"])
    placed = member.join(roots, F.col("rep") == F.col("node"), "left").select("file", "idx", "line", "id", F.coalesce("root", "rep").alias("cluster"))
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1")
    return placed.join(sizes, "cluster").select("file", "idx", "line", "id", "cluster", "size")


def banding(threshold: float, num_perm: int) -> tuple[int, int]:
    """Bands and rows of each: as many rows as leave a pair at the threshold unfound with a probability of MISSED at most."""
    rows = [r for r in range(1, num_perm + 1) if (1 - threshold**r) ** (num_perm // r) <= MISSED]
    return num_perm // max(rows, default=1), max(rows, default=1)


def lsh_pairs(sets: DataFrame, threshold: float, group: list[str], num_perm: int) -> DataFrame:
    """The approximate join: sets that agree in all rows of a band of their MinHash meet, each pair once, and is verified."""
    bands, rows = banding(threshold, num_perm)
    some = sets.where(F.size("set") > 0).select(*group, "id", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.random.default_rng(1).integers(1 << 63, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b in batches:
            if not b.num_rows:
                continue
            held = b.column("set")
            values, starts = held.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())[:-1]])
            keys = np.empty((b.num_rows, bands), np.uint64)
            for i in range(bands):
                key = np.full(b.num_rows, i, np.uint64)
                for f in factors[i * rows : (i + 1) * rows]:
                    mixed = values * f
                    mixed ^= mixed >> np.uint64(32)
                    mixed *= f
                    key = (key ^ np.minimum.reduceat(mixed, starts)) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                keys[:, i] = key
            key = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), bands).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*group, "id")), key], [*group, "id", "keys"])

    of = {f.name: f.dataType.simpleString() for f in some.schema}
    keyed = small_batches(some).mapInArrow(run, ", ".join(f"`{c}` {of[c]}" for c in (*group, "id")) + ", keys array<bigint>")
    buckets = keyed.select(*group, "id", F.explode("keys").alias("key")).groupBy(*group, "key").agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 1)
    met = buckets.select("ids", F.explode("ids").alias("u")).select("u", F.explode(F.filter("ids", lambda v: v > F.col("u"))).alias("v"))
    return _verified(some, met.distinct(), threshold)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("file").agg(F.countDistinct("cluster").alias("cluster_count"), F.count("*").alias("records_in_clusters"))
