"""Steps that several checks share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOC = "struct<file:string,index:bigint,line:bigint>"


def loc() -> Column:
    return F.struct(F.col("file"), F.col("idx").alias("index"), F.col("line"))


def issue(severity: str, code: str, message: Column | str, sample: Column | None = None) -> Column:
    said = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), said.alias("message"), (sample if sample is not None else F.lit(None).cast("string")).alias("sample"))


def exploded(records: DataFrame, issues: Column, *more: str) -> DataFrame:
    """A row for each issue of an array, nulls left out, in the array's order within a record."""
    found = records.select("file", "file_ord", "idx", "line", *more, F.posexplode(F.array_compact(issues)).alias("ord", "issue"))
    return found.select("file", "file_ord", "idx", "line", "ord", *more, "issue.*")


def capped(issues: DataFrame, cap: int, uncapped: tuple[str, ...] = ()) -> DataFrame:
    """The issues that a list with room for cap keeps, with their number rn; uncapped codes are always kept. As long
    as rn <= cap all earlier ones are kept, and beyond that none is, so one number decides."""
    at = Window.partitionBy("file").orderBy("idx", "ord")
    if not uncapped:
        return issues.withColumn("rn", F.row_number().over(at)).where(F.col("rn") <= cap)
    # two limited windows instead of one over all issues
    first = issues.withColumn("rn", F.row_number().over(at)).where(F.col("rn") <= cap)
    always = issues.where(F.col("code").isin(*uncapped)).withColumn("rn", F.lit(cap + 1))
    late = always.join(first.select("file", "idx", "ord"), ["file", "idx", "ord"], "left_anti").select(*first.columns)
    return first.union(late)


def first_n(df: DataFrame, n: int, keys: list[str], *order: str | Column) -> DataFrame:
    at = Window.partitionBy(*keys).orderBy(*(order or ("idx",)))
    return df.withColumn("rn", F.row_number().over(at)).where(F.col("rn") <= n)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go where the cluster says; a folder of our own only where it says nothing and all runs in one process, as
    in tests."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="assaykit-"))
