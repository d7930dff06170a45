"""Pairs of a chosen and a rejected answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import redacted
from ..functions.text import bounded, normalize_space
from .shared import exploded, first_n, issue


def pairs(records: DataFrame) -> DataFrame:
    return records.where(F.col("fmt") == "preference_pair")


def with_first_pair(records: DataFrame) -> DataFrame:
    """Each pair with the one that its prompt, in lower case with single spaces, came with first in the file. Hashes
    are grouped and joined back, so a prompt that half the rows share is no task of its own."""
    norm = lambda c: F.sha2(F.lower(normalize_space(F.col(c))), 256)
    some = pairs(records).withColumn("prompt_hash", norm("prompt")).withColumn("pair_hash", F.concat(norm("chosen"), norm("rejected")))
    first = some.groupBy("file", "prompt_hash").agg(F.min_by(F.struct("pair_hash", "idx", "line"), "idx").alias("first"))
    return some.join(first, ["file", "prompt_hash"])


def issues(records: DataFrame) -> DataFrame:
    found = F.array(
        F.when(F.col("chosen") == F.col("rejected"), issue("CRITICAL", "chosen_equals_rejected", "chosen and rejected are identical", bounded(F.col("sample"), 800))),
        F.when(F.col("pair_hash") != F.col("first.pair_hash"), issue("WARNING", "conflicting_prompt_pairs", "Same prompt has conflicting chosen/rejected across rows")),
    )
    marked = with_first_pair(records).withColumn("first_idx", F.col("first.idx")).withColumn("first_line", F.col("first.line"))
    return exploded(marked, found, "first_idx", "first_line")


def length_bias(records: DataFrame, limit: float) -> DataFrame:
    """record_count, mean lengths, their difference, its share of the rejected mean, and whether that is over limit."""
    mean = pairs(records).groupBy("file").agg(F.count("*").alias("record_count"), F.avg(F.char_length("chosen")).alias("mean_chosen_chars"), F.avg(F.char_length("rejected")).alias("mean_rejected_chars"))
    out = mean.withColumn("mean_delta_chars", F.col("mean_chosen_chars") - F.col("mean_rejected_chars"))
    ratio = F.col("mean_delta_chars") / F.greatest(F.lit(1.0), F.col("mean_rejected_chars"))
    return out.withColumn("ratio_vs_rejected", ratio).withColumn("biased", F.col("ratio_vs_rejected") > limit)


def review(records: DataFrame, n: int) -> DataFrame:
    some = first_n(pairs(records), n, ["file"])
    return some.select("file", "idx", "line", "rn", *(redacted(F.left(c, F.lit(250))).alias(f"{c}_excerpt") for c in ("prompt", "chosen", "rejected")))
