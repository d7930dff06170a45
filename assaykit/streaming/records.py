"""Checks that need one record at a time, over a stream of lines.

Everything here is a projection or an aggregate of counts, so a stream needs no window and its state is a few rows.
Checks that compare records need all of them and are batch plans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records
from ..operators import pii

_NAMES = list(records.rows_of(iter(())))


def stream_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the JSONL files that arrive in a folder. Their numbers within the file aren't known, and are 0."""
    lines = spark.readStream.format("text").load(folder).select("value", F.col("_metadata.file_path").alias("file"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(records.rows_of((f, 0, 0, None, *records.describe_line(v)) for f, v in zip(b["file"], b["value"])), columns=_NAMES)

    return lines.mapInPandas(run, records.RECORD)


def format_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("fmt").agg(F.count("*").alias("n"))


def pattern_counts(stream: DataFrame) -> DataFrame:
    return pii.hits(stream).groupBy("pattern").agg(F.sum("match_count").alias("n"))
