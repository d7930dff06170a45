"""Records that appear in several splits, exactly or nearly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_of
from .near_duplicates import clusters


def with_splits(records: DataFrame) -> DataFrame:
    """Readable records with their split, and pos, their place in the order of files and rows."""
    pos = F.shiftleft(F.col("file_ord").cast("long"), 40) + F.col("idx")
    return records.where(F.col("kind") == "record").withColumn("split", split_of(F.col("own_split"), F.col("file"))).withColumn("pos", pos)


def split_counts(placed: DataFrame) -> DataFrame:
    """split, n, split_ord: splits number in order of their first record."""
    found = placed.groupBy("split").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return found.withColumn("split_ord", F.row_number().over(Window.orderBy("first")) - 1).drop("first")


def exact_leaks(placed: DataFrame) -> DataFrame:
    """A row for each record whose equal stands in an earlier split: hash, split_a, pos_a (the last equal record of
    the first split that has it), split_b, pos_b."""
    hashed = placed.select("split", "pos", F.sha2("canonical", 256).alias("hash")).join(split_counts(placed).select("split", "split_ord"), "split")
    per_split = hashed.groupBy("hash", "split_ord", "split").agg(F.max("pos").alias("last"))
    first = per_split.groupBy("hash").agg(F.min_by(F.struct("split_ord", "split", "last"), "split_ord").alias("a"), F.count("*").alias("splits")).where("splits > 1")
    out = hashed.join(first, "hash").where(F.col("split_ord") > F.col("a.split_ord"))
    return out.select("hash", F.col("a.split").alias("split_a"), F.col("a.last").alias("pos_a"), F.col("split").alias("split_b"), F.col("pos").alias("pos_b"))


def near_leaks(placed: DataFrame, threshold: float = 0.85, method: str = "exact", num_perm: int = 128, per_split: int | None = None) -> DataFrame:
    """Members of near-duplicate groups that span splits: cluster, size, split, pos. per_split, in parity mode, takes the
    first so many records of each split only."""
    some = placed
    if per_split is not None:
        at = Window.partitionBy("split").orderBy("pos")
        some = placed.withColumn("nth", F.row_number().over(at)).where(F.col("nth") <= per_split).drop("nth")
    found = clusters(some, threshold, across=True, method=method, num_perm=num_perm)
    member = found.join(some.select(F.col("pos").alias("id"), "split"), "id")
    spans = member.groupBy("cluster").agg(F.countDistinct("split").alias("splits")).where("splits > 1")
    return member.join(spans, "cluster").select("cluster", "size", "split", F.col("id").alias("pos"))
