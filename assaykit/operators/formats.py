"""Format detection: the shapes of a file's first records, and what they make of the file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import first_n, loc

SNIFFED = 2000
UNUSABLE = ("mixed", "invalid", "empty", "unreadable", "too_large")


def format_counts(records: DataFrame, sniffed: int = SNIFFED) -> DataFrame:
    """file, fmt, n and first (the place of the first such record) among each file's first records."""
    return records.where(F.col("idx") < sniffed).groupBy("file", "file_ord", "fmt").agg(F.count("*").alias("n"), F.min_by(loc(), "idx").alias("first"))


def file_formats(records: DataFrame, sniffed: int = SNIFFED) -> DataFrame:
    """file, format, sampled, invalid, critical of each file with records. Records that can't be read outweigh all, then
    several shapes in one file; records of no known shape don't count beside others."""
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    known = F.col("fmt") != "unknown"
    out = format_counts(records, sniffed).groupBy("file", "file_ord").agg(
        F.sum("n").alias("sampled"), n(F.col("fmt") == "invalid").alias("invalid"), F.count(F.when(known, 1)).alias("shapes"), F.max(F.when(known, F.col("fmt"))).alias("only"),
        F.map_from_entries(F.collect_list(F.struct("fmt", "n"))).alias("counts"),
    )
    fmt = F.when(F.col("invalid") > 0, "invalid").when(F.col("shapes") > 1, "mixed").when(F.col("shapes") == 1, F.col("only")).otherwise("unknown")
    return out.select("file", "file_ord", fmt.alias("format"), "sampled", "invalid", fmt.isin("invalid", "mixed").alias("critical"), "counts")


def invalid_examples(records: DataFrame, n: int = 5, sniffed: int = SNIFFED) -> DataFrame:
    return first_n(records.where((F.col("idx") < sniffed) & (F.col("fmt") == "invalid")), n, ["file"]).select("file", "idx", "line", "error", "rn")
