"""Spark session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on: joins that meet a hot key are split by
# adaptive execution, also where the split costs one more shuffle. Shuffles start
# out in many partitions and are merged up to 8 MB, compressed, for a task: what a
# task sorts follows that size and not the input, and stays in its memory. So does
# what a task reads of a file.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def builder(app: str = "tillwise") -> SparkSession.Builder:
    made = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    for key, value in RUNTIME_SETTINGS.items():
        made = made.config(key, value)
    return made


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package.

    Needed where it is not installed on them, as when the driver only extends
    its own ``sys.path``. The archive is sent once per Spark context.
    """
    context = spark.sparkContext
    if not any(Path(f).name == "tillwise.zip" for f in context._python_includes):
        made = tempfile.mkdtemp(prefix="tillwise-package-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        package = Path(__file__).resolve().parent
        context.addPyFile(shutil.make_archive(
            f"{made}/tillwise", "zip", root_dir=package.parent, base_dir=package.name))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a session in one
    process may go without and gets a temporary folder, removed at its end:
    executors elsewhere could not read it back.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tillwise-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return named.rstrip("/")


def _root(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/tillwise/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for one intermediate table below the shared folder."""
    return f"{_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy.

    The copy is Parquet: readers take the columns they need, and a lost
    executor costs nothing that came before.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that are gone.

    It does so when the driver's memory is cleared, which a large driver seldom
    needs: a job of several steps would keep the files of all of them.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def kept_together(spark: SparkSession) -> Iterator[None]:
    """Inside, a join on several columns leaves rows where one of these has put them already.

    For actions whose rows belong together by that one column, such as an
    order's; what is run later is planned as ever.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; frames that read them end here."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
