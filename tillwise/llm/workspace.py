"""Intermediate tables in the shared folder, and what tasks on texts need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillwise.session import scratch_path, ship

# Rows and bytes in an Arrow batch on its way to a Python task; texts are long.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """The session with this package on its executors and batches of whole texts kept small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return ship(spark)


def plain_names(docs: DataFrame) -> DataFrame:
    """``docs`` with names that nothing clashes with: ``_0``, ``_1``, ..., but ``text`` and ``doc_id``."""
    return docs.toDF(*[c if c in ("text", "doc_id") else f"_{i}" for i, c in enumerate(docs.columns)])


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder (``spark.checkpoint.dir``) and read it back.

    The copy is a table of files: a lost executor costs no recomputation of
    what came before, and readers still prune columns.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
