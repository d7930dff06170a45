"""Expressions for personal data and secrets, counted by match over whole records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import PATTERNS, matches, redacted
from ..functions.records import bundle
from .shared import first_n


def _text(records: DataFrame) -> DataFrame:
    return records.select("file", "file_ord", "idx", "line", bundle(F.col("fields"), F.col("canonical")).alias("bundle"))


def hits(records: DataFrame) -> DataFrame:
    """file, idx, line, pattern, match_count of each record and pattern with a match. One pass over the text, which stays
    where it is."""
    found = F.array(*(F.struct(F.lit(k).alias("pattern"), F.size(matches(F.col("bundle"), k)).cast("long").alias("match_count")) for k in PATTERNS))
    each = _text(records).select("file", "file_ord", "idx", "line", F.explode(F.filter(found, lambda x: x["match_count"] > 0)).alias("f"))
    return each.select("file", "file_ord", "idx", "line", "f.pattern", "f.match_count")


def pattern_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("file", "pattern").agg(F.sum("match_count").alias("n"), F.count("*").alias("records"))


def samples(found: DataFrame, records: DataFrame, n: int) -> DataFrame:
    """The first records of each file and pattern, redacted before they are cut, so that no cut leaves half a secret. Only
    their texts are joined."""
    some = first_n(found, n, ["file", "pattern"]).join(_text(records).select("file", "idx", "bundle"), ["file", "idx"])
    return some.withColumn("sample", F.left(redacted(F.col("bundle")), F.lit(1000))).drop("bundle")
