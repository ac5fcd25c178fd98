"""What a task takes follows a fixed size, not the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.session import scratch_path


def test_a_large_shuffle_has_more_tasks_than_a_small_one(spark):
    """The session's own number of shuffle partitions, 4, is no limit."""
    def files(rows):
        path = scratch_path(spark, "wide")
        wide = spark.range(rows).select("id", F.sha2(F.col("id").cast("string"), 512).alias("v"))
        wide.repartition("id").write.parquet(path)
        return len(spark.read.parquet(path).inputFiles())

    assert files(100) <= 4
    assert files(1_000_000) > 8
