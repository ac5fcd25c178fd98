"""Changing rows of a partitioned table without rewriting the rest of it.

A table is a folder of Parquet partitions by one column, which follows from the
other columns of a row (``place``). ``merge`` reads only the partitions that
hold changed rows or get some, puts the changes in, and writes these partitions
anew; the files of all others stay as they are.

The new partitions are staged first, as a table in the shared folder: the
write that replaces them reads nothing that it replaces, and a job that fails
before it leaves the table as it was. Run again, a merge gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.session import cut_lineage


def save_partitioned(df: DataFrame, path: str, partition: str, place: Column) -> None:
    """Write ``df`` as a table that ``merge`` can change."""
    df.withColumn(partition, place).write.partitionBy(partition).parquet(path)


def _in(partition: str, values: list) -> Column:
    """Whether the partition is one of ``values``, so that other folders are not read."""
    known = F.col(partition).isin([v for v in values if v is not None])
    return known | F.col(partition).isNull() if None in values else known


def located(table: DataFrame, changes: DataFrame, key: str, partition: str) -> DataFrame:
    """``changes`` with the partition of the row they change; those of no row are left out.

    Reads two columns of the table. Not needed where the changes name the partition.
    """
    return changes.join(table.select(key, partition), key)


def merge(
    spark: SparkSession, path: str, changes: DataFrame, *, key: str, partition: str, place: Column,
    deleted: str | None = None,
) -> list:
    """Put ``changes`` into the table at ``path``; gives the partitions written, in order.

    ``changes`` has at most one row per ``key``, the ``partition`` its row is in
    now (for a new row: where it belongs) and any of the table's columns: a row
    that is there takes their values, null included, and goes to another
    partition if ``place`` says so. A row that is not there is added. Rows with
    ``deleted`` true leave. A partition without rows loses its folder.
    """
    table = spark.read.parquet(path)
    columns = [c for c in table.columns if c != partition]
    given = [c for c in columns if c in changes.columns and c != key]
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    new = cut_lineage(changes.select(
        key, partition, *[F.col(c).alias(f"_new_{c}") for c in given], gone.alias("_gone"), F.lit(True).alias("_met")))
    # No more values than the table and the new rows have partitions.
    touched = [r[0] for r in new.select(partition).distinct().collect()]
    if not touched:
        return []
    old = table.where(_in(partition, touched))
    both = old.join(new.drop(partition), key, "full_outer")
    kept = both.where(~F.coalesce("_gone", F.lit(False))).select(*[
        F.when(F.col("_met"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c)
        for c in columns])
    staged = cut_lineage(kept.withColumn(partition, place))
    held = [r[0] for r in staged.select(partition).distinct().collect()]
    # Rows may have come to partitions that were not read: theirs stay with them.
    reached = [v for v in held if v not in touched]
    if reached:
        staged = cut_lineage(staged.unionByName(
            table.where(_in(partition, reached)).select(*columns, partition)))
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for value in touched:
        if value not in held:
            _drop_folder(spark, path, partition, value)
    return sorted([*touched, *reached], key=lambda v: (v is None, str(v)))


def _drop_folder(spark: SparkSession, path: str, partition: str, value) -> None:
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    name = "__HIVE_DEFAULT_PARTITION__" if value is None else escape(str(value))
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={name}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
