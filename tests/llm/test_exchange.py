"""Scans that repeat themselves, and those that don't."""

import pytest
from pyspark.sql import functions as F

from assaykit.llm import exchange


def test_what_is_stable(spark, tmp_path):
    spark.range(50).select("id", F.lit("a").alias("text")).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert exchange.stable(scan) is scan
    assert exchange.stable(scan.where("id > 3").union(scan))._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    for moving in (scan.withColumn("x", F.randn()), scan.where(F.rand() < 0.5), scan.groupBy("id").count(), scan.orderBy("id"), scan.withColumn("i", F.monotonically_increasing_id())):
        assert exchange.stable(moving) is not moving


def test_a_moved_scan_fails(spark, tmp_path):
    """Decisions that meet other rows than those they were made on stop the job."""
    spark.range(40).select("id", F.concat(F.lit("text "), "id").alias("text")).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.range(40).select("id", F.concat(F.lit("text "), F.lit(39) - F.col("id")).alias("text")).coalesce(1).write.parquet(str(tmp_path / "b"))
    a, b = (spark.read.parquet(str(tmp_path / x)) for x in "ab")
    decided = exchange.with_row_id(a, "row").where("id % 7 = 0").select("row", exchange.mark("text"))
    assert {r.id % 7 for r in exchange.filter_rows(a, decided, True).collect()} == {0}
    assert exchange.filter_rows(a, decided, False).count() == 34
    with pytest.raises(Exception, match="another text"):
        exchange.filter_rows(b, decided, False).collect()
    with pytest.raises(Exception, match="were decided on"):
        exchange.filter_rows(a.where("id < 20"), decided, False).collect()


def test_session_settings_of_the_caller_stay(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "12345678")
    exchange.small_batches(spark.range(1))
    assert spark.conf.get(key) == "12345678"
    spark.conf.set(key, before)
