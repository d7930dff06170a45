"""Labels of classification records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .shared import first_n


def labelled(records: DataFrame) -> DataFrame:
    return records.where(F.col("fmt") == "classification")


def label_counts(records: DataFrame) -> DataFrame:
    return labelled(records).groupBy("file", "label").agg(F.count("*").alias("n"), F.min("idx").alias("first"))


def drift(counts: DataFrame) -> DataFrame:
    """file, normalized, variants: labels that differ by case or white space at the ends only."""
    groups = counts.groupBy("file", F.lower(strip(F.col("label"))).alias("normalized"))
    return groups.agg(F.count("*").alias("spellings"), F.sum("n").alias("records"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("variants"), F.min("first").alias("first")).where("spellings > 1")


def balance(counts: DataFrame) -> DataFrame:
    """file, records, majority over minority."""
    return counts.groupBy("file").agg(F.sum("n").alias("record_count"), (F.max("n") / F.greatest(F.lit(1), F.min("n"))).alias("ratio"))


def undeclared(records: DataFrame, declared: tuple[str, ...]) -> DataFrame:
    """Records whose label isn't declared, as it is spelled."""
    return labelled(records).where(~F.col("label").isin(*declared))


def undeclared_examples(records: DataFrame, declared: tuple[str, ...], n: int) -> DataFrame:
    return first_n(undeclared(records, declared), n, ["file"]).select("file", "idx", "line", "label", "sample", "rn")
