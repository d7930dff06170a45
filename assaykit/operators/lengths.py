"""Lengths of records in characters and tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import bundle
from ..functions.text import estimated_tokens
from ..sources import storage
from .shared import first_n

BINS = 10


#: How an encoding cuts texts before it merges bytes.
_CUTS = {
    "cl100k_base": r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s",
    "gpt2": r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s",
}
_CUTS |= dict.fromkeys(("r50k_base", "p50k_base"), _CUTS["gpt2"])


def tokenizer(ranks: str, encoding: str = "cl100k_base"):
    """A column function that counts the tokens of an encoding, whose ranks are in a file that all executors can read."""
    if encoding not in _CUTS:
        raise ValueError(f"token_encoding is {encoding}; known are {', '.join(sorted(_CUTS))}")
    pattern = _CUTS[encoding]

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with storage.open_file(ranks) as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        for texts in parts:
            yield texts.map(lambda t: len(own.encode_ordinary(t or "")))

    return count


def measured(records: DataFrame, ranks: str | None = None, encoding: str = "cl100k_base") -> DataFrame:
    """file, idx, line, bundle, chars, tokens."""
    text = records.select("file", "file_ord", "idx", "line", bundle(F.col("fields"), F.col("canonical")).alias("bundle"))
    tokens = tokenizer(ranks, encoding)(F.col("bundle")) if ranks else estimated_tokens(F.col("bundle"))
    return text.withColumns({"chars": F.char_length("bundle").cast("long"), "tokens": tokens})


def stats(lengths: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """One pass: counts, percentiles with linear interpolation, means, and how many exceed each window."""
    aggs = [F.count("*").alias("record_count"), F.count_if(F.col("bundle") == "").alias("empty_text_bundle_records")]
    for c in ("chars", "tokens"):
        aggs += [F.percentile(c, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias(f"{c}_p"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min"), F.avg(c).alias(f"{c}_mean")]
    aggs += [F.count_if(F.col("tokens") > w).alias(f"over_{w}") for w in windows]
    return lengths.groupBy("file", "file_ord").agg(*aggs)


def histogram(lengths: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """file, bin, low, high, n: at most bins equal bins between the extremes, empty ones with 0. The least equals the most: one bin."""
    ends = lengths.groupBy("file").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    ends = ends.withColumn("bins", F.least(F.lit(bins), F.greatest(F.lit(1), F.col("hi") - F.col("lo")))).withColumn("step", (F.col("hi") - F.col("lo")) / F.col("bins"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.col("bins") - 1, F.floor((F.col(column) - F.col("lo")) / F.col("step"))))
    counts = lengths.join(ends, "file").groupBy("file", at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    all_bins = ends.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin")).withColumn("bin", F.col("bin").cast("long"))
    edge = lambda i: F.floor(F.col("lo") + i * F.col("step")).cast("long")
    return all_bins.join(counts, ["file", "bin"], "left").select("file", "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bars(rows: list[tuple[int, int, int]], width: int = 30) -> list[str]:
    """Lines of a text histogram from (low, high, n)."""
    most = max((n for *_, n in rows), default=0) or 1
    alone = len(rows) == 1 and rows[0][0] == rows[0][1]
    out = []
    for low, high, n in rows:
        size = min(width, n) if alone else max(1, n * width // most) if n else 0
        out.append(f"{low:>7}-{high:<7} | {'#' * size} {n}")
    return out


def longest(lengths: DataFrame, n: int) -> DataFrame:
    """Each file's longest records, of equals the first."""
    return first_n(lengths, n, ["file"], F.desc("tokens"), F.asc("idx"))


def overall_longest(lengths: DataFrame, n: int) -> DataFrame:
    return lengths.orderBy(F.desc("tokens"), "file_ord", "idx").limit(n)

