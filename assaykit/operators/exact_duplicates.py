"""Records that repeat an earlier record of their file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import redacted
from ..functions.text import bounded
from .shared import first_n


def _hashed(records: DataFrame) -> DataFrame:
    return records.where(F.col("kind") == "record").withColumn("hash", F.sha2("canonical", 256))


def duplicates(records: DataFrame) -> DataFrame:
    """file, idx, hash, first_idx: a row for each record that has an earlier equal. Only hashes are shuffled, and a
    hash's records meet their first by a join, so no hash is a task of its own."""
    hashed = _hashed(records).select("file", "file_ord", "idx", "line", "hash")
    groups = hashed.groupBy("file", "hash").agg(F.min_by(F.struct("idx", "line"), "idx").alias("first"), F.count("*").alias("n")).where("n > 1")
    out = hashed.join(groups, ["file", "hash"]).where(F.col("idx") > F.col("first.idx"))
    return out.select("file", "file_ord", "idx", "line", "hash", F.col("first.idx").alias("first_idx"), F.col("first.line").alias("first_line"))


def summary(records: DataFrame) -> DataFrame:
    """record_count (all rows), unique_records, duplicate_count, duplicate_rate by file."""
    real = F.col("kind") == "record"
    per_hash = records.groupBy("file", "file_ord", F.when(real, F.sha2("canonical", 256)).alias("hash")).agg(F.count("*").alias("n"))
    out = per_hash.groupBy("file", "file_ord").agg(F.sum("n").alias("record_count"), F.count("hash").alias("unique_records"), F.coalesce(F.sum(F.when(F.col("hash").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicate_count"))
    return out.withColumn("duplicate_rate", F.col("duplicate_count") / F.col("record_count"))


def examples(records: DataFrame, n: int) -> DataFrame:
    first = first_n(duplicates(records), n, ["file"])
    shown = first.join(records.select("file", "idx", "sample"), ["file", "idx"])
    return shown.withColumn("sample", redacted(bounded(F.col("sample"), 800)))


def not_comparable(records: DataFrame) -> DataFrame:
    """file, n and the first error of records that are read but have no canonical form."""
    return records.where((F.col("kind") == "record") & F.col("error").isNotNull()).groupBy("file").agg(F.count("*").alias("n"), F.min_by("error", "idx").alias("error"))
