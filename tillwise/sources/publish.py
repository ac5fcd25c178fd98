"""Publishing the frames of a job together.

All frames are written below a new version folder first; then one small file is
renamed to name that version. Readers see the version before or the one after,
never a mixture, and a job that fails half way leaves what was there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CURRENT = "current-version"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(frames: dict[str, DataFrame], target: str) -> str:
    """Write all frames and make them the current version of ``target``; gives its name."""
    spark = next(iter(frames.values())).sparkSession
    version = uuid.uuid4().hex
    for name, frame in frames.items():
        frame.write.parquet(f"{target}/{version}/{name}")
    staged, files = _file_system(spark, f"{target}/{CURRENT}-{version}")
    out = files.create(staged)
    out.writeBytes(version)
    out.close()
    current, _ = _file_system(spark, f"{target}/{CURRENT}")
    # The context renames over what is there in one step.
    rename = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        current.toUri(), spark._jsc.hadoopConfiguration()).rename(staged, current, options)
    return version


def published(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A frame of the current version."""
    version = spark.read.text(f"{target}/{CURRENT}").first()[0]
    return spark.read.parquet(f"{target}/{version}/{name}")
