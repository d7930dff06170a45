"""A reproducible random sample for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import redacted
from ..functions.text import bounded
from .shared import first_n


def review_sample(records: DataFrame, total: int, files: int, seed: int = 0) -> DataFrame:
    """At most total records, the same number from each file, in the order of a hash of their place."""
    each = max(1, total // max(1, files))
    some = first_n(records.select("file", "file_ord", "idx", "line", "sample"), each, ["file"], F.md5(F.concat_ws(" ", "file", "idx", F.lit(seed))))
    return some.orderBy("file_ord", "rn").limit(total).withColumn("record", redacted(bounded(F.col("sample"), 800))).drop("sample")
