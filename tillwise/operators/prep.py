"""Preparing tables: computed columns, defaults, keys, partitioned orders, updates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise import model
from tillwise.functions.clock import ts
from tillwise.plans.skew import HOT_ROWS, numbered
from tillwise.sources.merge import located, merge


def with_category_level(df: DataFrame) -> DataFrame:
    """0 for a root, 1 for any other category, however deep."""
    return df.withColumn(
        "CategoryLevel", F.when(F.col("ParentCategoryID").isNull(), 0).otherwise(1))


def with_low_stock_flag(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "IsLowStock", F.when(F.col("StockQuantity") <= F.col("ReorderLevel"), 1).otherwise(0))


def with_line_total(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "LineTotal",
        (F.col("Quantity") * F.col("UnitPrice") - F.col("DiscountAmount")).cast("decimal(18,4)"))


def email_hash(email: Column) -> Column:
    """Digest of the address as people mean it: no outer blanks, no case."""
    return F.sha2(F.lower(F.trim(email)), 256)


def with_email_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("EmailHash", email_hash(F.col("Email")))


def apply_defaults(
    df: DataFrame, table: str, *, as_of: datetime, actor: str = "loader",
    application: str = "tillwise", fill_unknown: bool = False,
) -> DataFrame:
    """``df`` with the default of every column the table has one for.

    A missing column gets its default; an unknown value that was given stays
    unknown. With ``fill_unknown`` such a value gets the default too.
    """
    marks = {model.AS_OF: ts(as_of), model.ACTOR: F.lit(actor),
             model.APPLICATION: F.lit(application)}
    types = {f.name: f.dataType for f in model.schema(table).fields}
    added: dict[str, Column] = {}
    for name, value in model.DEFAULTS[table].items():
        default = (marks[value] if value in marks else F.lit(value)).cast(types[name])
        if name not in df.columns:
            added[name] = default
        elif fill_unknown:
            added[name] = F.coalesce(F.col(name), default)
    return df.withColumns(added)


def with_hash_key(df: DataFrame, name: str, *natural: str) -> DataFrame:
    """A surrogate key that the same row gets on every run.

    Different values, unknown ones included, never give the same text.
    """
    values = F.to_json(F.array(*[F.col(c).cast("string") for c in natural]))
    return df.withColumn(name, F.sha2(values, 256))


def with_sequence_key(
    df: DataFrame, name: str, order: Sequence[Column], *, after: int = 0,
    piece_rows: int = HOT_ROWS,
) -> DataFrame:
    """Whole numbers from ``after`` + 1 in ``order``, without gaps."""
    return numbered(df, order, "_nth", piece_rows=piece_rows).withColumn(
        name, (F.col("_nth") + after).cast("long")).drop("_nth")


def order_bucket(order_date: Column, boundaries: Sequence[datetime]) -> Column:
    """1 below the first boundary, one more from each boundary on."""
    bucket = F.lit(1)
    for boundary in boundaries:
        bucket = bucket + F.when(order_date >= ts(boundary), 1).otherwise(0)
    return bucket


def partitioned_orders(
    orders: DataFrame, boundaries: Sequence[datetime], path: str, *, mode: str = "errorifexists"
) -> DataFrame:
    """Write orders by date range below ``path`` and read them back.

    Rows stay in the tasks they are in: a range holding most orders is written
    by all of them. A filter on OrderRange reads only the folders it needs.
    """
    (
        orders.withColumn("OrderRange", order_bucket(F.col("OrderDate"), boundaries))
        .write.mode(mode).partitionBy("OrderRange").parquet(path)
    )
    return read_partitioned_orders(orders.sparkSession, path)


def read_partitioned_orders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


UPDATABLE = ("OrderDate", "OrderStatus", "PaymentStatus", "TrackingNumber",
             "ExpectedDeliveryDate", "ActualDeliveryDate", "CreatedDate")


def merge_order_updates(
    spark: SparkSession, path: str, updates: DataFrame, *, partition: str, place: Column
) -> list:
    """:func:`apply_order_updates` in the partitioned table at ``path``; gives the partitions written.

    Orders are found by their key and date only; an update of the date moves the order.
    """
    table = spark.read.parquet(path)
    changed = [c for c in UPDATABLE if c in updates.columns]
    found = located(table, updates.where(F.coalesce(*[F.col(c).cast("string") for c in changed]).isNotNull()),
                    "OrderID", partition).select("OrderID", partition)
    touched = [r[0] for r in found.select(partition).distinct().collect()]
    rows = table.where(F.col(partition).isin(touched)).join(found.select("OrderID"), "OrderID", "left_semi")
    renewed = apply_order_updates(rows, updates)
    return merge(spark, path, renewed.select("OrderID", partition, *changed), key="OrderID",
                 partition=partition, place=place)


def apply_order_updates(orders: DataFrame, updates: DataFrame) -> DataFrame:
    """Orders with the known values of ``updates``, one row per OrderID, put in."""
    changed = [c for c in UPDATABLE if c in updates.columns]
    renamed = updates.select("OrderID", *[F.col(c).alias(f"New{c}") for c in changed])
    return (
        orders.join(renamed, "OrderID", "left")
        .withColumns({c: F.coalesce(f"New{c}", c) for c in changed})
        .select(*orders.columns)
    )
