"""Structured Streaming jobs.

Results go to Parquet tables below a target path, one folder per micro-batch,
written over when a batch is run again after a failure: a batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tillwise import model
from tillwise.functions.clock import NTZ
from tillwise.functions.values import or_zero
from tillwise.operators.audit import alerts_of, order_audit_of

BATCH = "batch"


# Batches between two snapshots of the state a job builds up.
SNAPSHOT_EVERY = 50


def file_stream(
    spark: SparkSession, path: str, schema: StructType, *, files_per_batch: int | None = None
) -> DataFrame:
    """New Parquet files below ``path``, which may be a glob, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _start(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str,
    available_now: bool,
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(step)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def _history(spark: SparkSession, path: str, upto: int) -> DataFrame | None:
    """What batches before ``upto`` wrote: the last snapshot and what came after."""
    if upto == 0:
        return None
    last = (upto - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY - 1
    rows = spark.read.parquet(path).where(
        (F.col(BATCH) > last) & (F.col(BATCH) < upto))
    if last < 0:
        return rows
    kept = spark.read.parquet(f"{path}_snapshot/{BATCH}={last}").withColumn(BATCH, F.lit(last))
    return kept.unionByName(rows)


def _snapshot_due(batch_id: int) -> bool:
    return (batch_id + 1) % SNAPSHOT_EVERY == 0


def _instant(local: Column) -> Column:
    """A zone-free time as the instant it names in UTC, whatever the session's zone."""
    days = F.datediff(F.to_date(local), F.lit("1970-01-01").cast("date"))
    return F.timestamp_seconds(
        days * 86400 + F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local))


def _day_of(instant: Column) -> Column:
    days = F.floor(F.unix_seconds(instant) / 86400).cast("int")
    return (F.lit("1970-01-01").cast(NTZ) + F.make_dt_interval(days)).cast(NTZ)


def stream_sales_metrics(
    orders: DataFrame, target: str, *, lateness: str, available_now: bool = True
) -> StreamingQuery:
    """Orders and revenue per day and status.

    Every batch writes the groups it changed. An order that comes later than
    ``lateness`` behind the newest one seen is left out and counted:
    :func:`late_rows` has the counts.
    """
    live = (
        orders.withColumn("At", _instant(F.col("OrderDate")))
        .withWatermark("At", lateness)
        .groupBy(F.window("At", "1 day").alias("Day"), "OrderStatus")
        .agg(F.count("*").alias("Orders"), F.sum("TotalAmount").alias("Revenue"))
        .select(_day_of(F.col("Day.start")).alias("Day"), "OrderStatus", "Orders", "Revenue")
    )
    return _start(
        live, lambda batch, n: _write(batch, f"{target}/metrics", n), f"{target}/checkpoint",
        "update", available_now)


def late_rows(query: StreamingQuery) -> dict[int, int]:
    """Rows left out as late, by batch, over the progress the query still holds."""
    return {
        p["batchId"]: sum(s.get("numRowsDroppedByWatermark", 0) for s in p["stateOperators"])
        for p in query.recentProgress
    }


def sales_metrics(spark: SparkSession, target: str) -> DataFrame:
    """The latest state of each group :func:`stream_sales_metrics` has written."""
    return (
        spark.read.parquet(f"{target}/metrics")
        .groupBy("Day", "OrderStatus")
        .agg(F.max_by("Orders", BATCH).alias("Orders"), F.max_by("Revenue", BATCH).alias("Revenue"))
    )


def _totals(spark: SparkSession, target: str, batch_id: int | None = None) -> DataFrame:
    """ProductID and Moved: all movements up to that batch, or the last one finished, from the stream's state."""
    reader = spark.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    state = reader.load(f"{target}/checkpoint")
    return state.select("key.ProductID", F.col(f"value.{state.schema['value'].dataType.names[0]}").alias("Moved"))


def stream_stock_ledger(
    moves: DataFrame, products: DataFrame, target: str, *, as_of: datetime,
    available_now: bool = True,
) -> StreamingQuery:
    """Stock per product from a stream of signed movements, with alerts.

    ``moves`` has ProductID and Quantity. A batch adds up its movements per
    product before they are shuffled, so a product with most of the movements
    costs no more than another, and changes the stock of the products it
    touches: a row of ``ledger`` each. What was moved in all is kept per product
    in the stream's own state, a sum that Spark keeps without Python; what was
    moved before a batch is that state as the batch before left it, read whole,
    so that a batch that runs again finds it as it was.
    Movements of unknown products, null ones too, are ``rejects``, with what was
    rejected of the product before; they count once the product is known.
    Alerts compare the stock before and after a batch, as a table trigger
    compares it before and after a statement. A stock below zero is kept and
    listed, since the goods are gone already, and alerts like any other that
    falls to its level.
    """
    stated = moves.groupBy("ProductID").agg(F.sum(F.col("Quantity").cast("long")).alias("Moved"))
    levels = products.select(
        F.col("ProductID").alias("KnownID"), F.col("StockQuantity").cast("long").alias("FirstStock"),
        "ReorderLevel")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Written once: the state is run through for the first reader only.
        _write(batch, f"{target}/totals", batch_id)
        fresh = spark.read.schema(batch.schema).parquet(f"{target}/totals/{BATCH}={batch_id}")
        if batch_id:
            was = _totals(spark, target, batch_id - 1).toDF("_id", "_moved")
            fresh = fresh.join(was, fresh["ProductID"].eqNullSafe(was["_id"]), "left")
        before = or_zero(F.col("_moved")) if batch_id else F.lit(0).cast("long")
        net = fresh.select("ProductID", (or_zero(F.col("Moved")) - before).alias("Net"), before.alias("Before"))
        # The tables below are picked from the written join.
        joined = net.join(levels, net["ProductID"] == levels["KnownID"], "left")
        _write(joined, f"{target}/net", batch_id)
        held = spark.read.schema(joined.schema).parquet(f"{target}/net/{BATCH}={batch_id}")
        moved = held.where(F.col("KnownID").isNotNull()).select(
            "ProductID", "Net", "ReorderLevel", (F.col("FirstStock") + F.col("Before")).alias("OldStock"),
            (F.col("FirstStock") + F.col("Before") + F.col("Net")).alias("StockQuantity"),
            F.col("ReorderLevel").alias("OldLevel"))
        _write(moved.select("ProductID", F.col("Net").alias("Quantity"), F.col("OldStock").alias("PreviousStock"),
                            F.col("StockQuantity").alias("NewStock")), f"{target}/ledger", batch_id)
        _write(held.where(F.col("KnownID").isNull()).select(
            "ProductID", F.col("Net").alias("Quantity"), F.col("Before").alias("RejectedBefore"),
            F.lit(model.ADJUSTMENT_REJECTS["product"]).alias("ErrorMessage")), f"{target}/rejects", batch_id)
        _write(alerts_of(moved, as_of=as_of), f"{target}/alerts", batch_id)
        _write(moved.where("StockQuantity < 0").select("ProductID", "StockQuantity"), f"{target}/negative", batch_id)

    return _start(stated, step, f"{target}/checkpoint", "update", available_now)


def stock_levels(spark: SparkSession, products: DataFrame, target: str) -> DataFrame:
    """Stock of every product after the batches finished so far, from the stream's state."""
    net = _totals(spark, target).where("ProductID IS NOT NULL").withColumnRenamed("Moved", "Net")
    return products.select("ProductID", "StockQuantity", "ReorderLevel").join(
        net, "ProductID", "left"
    ).select(
        "ProductID",
        (F.col("StockQuantity") + or_zero(F.col("Net"))).cast("long").alias("StockQuantity"),
        "ReorderLevel",
    )


def stock_rejects(spark: SparkSession, target: str) -> DataFrame:
    """Movements of products nobody knows, by batch and product."""
    return spark.read.parquet(f"{target}/rejects").drop(BATCH)


def stock_ledger(spark: SparkSession, target: str) -> DataFrame:
    """What each batch did to the stock of each product it touched."""
    return spark.read.parquet(f"{target}/ledger").drop(BATCH)


def stock_alert_log(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/alerts").drop(BATCH)


def stream_order_audit(
    changes: DataFrame, before: DataFrame, target: str, *, as_of: datetime, sequence: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Audit rows from a stream of changed orders.

    A change carries OrderID, Deleted, the order's new CustomerID, TotalAmount
    and OrderStatus, and its place among the order's changes in the column
    ``sequence``. ``before`` is the table the stream starts from. A change is
    held against the one before it, in the same batch or in an earlier one.
    """
    columns = ["OrderID", "CustomerID", "TotalAmount", "OrderStatus"]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _write(batch.select(*columns, "Deleted", F.col(sequence).alias("Sequence")),
               f"{target}/changes", batch_id)
        fresh = spark.read.parquet(f"{target}/changes/{BATCH}={batch_id}")
        touched = fresh.select("OrderID").distinct()
        was = before.select(*columns).join(touched, "OrderID", "left_semi")
        history = _history(spark, f"{target}/changes", batch_id)
        if history is not None:
            seen = _latest(history.join(touched, "OrderID", "left_semi"), columns)
            kept = seen.where(~F.col("Deleted")).select(*columns)
            was = was.join(seen, "OrderID", "left_anti").unionByName(kept)
        turn = Window.partitionBy("OrderID").orderBy("Sequence")
        state = F.when(~F.col("Deleted"), F.struct(*columns))
        steps = fresh.select(
            "OrderID", state.alias("a"), F.lag(state).over(turn).alias("earlier"),
            (F.row_number().over(turn) == 1).alias("first"))
        held = was.select(F.col("OrderID").alias("_id"), F.struct(*columns).alias("held"))
        pairs = steps.join(held, steps["OrderID"] == held["_id"], "left").select(
            "a", F.when(F.col("first"), F.col("held")).otherwise(F.col("earlier")).alias("b"))
        _write(order_audit_of(pairs, as_of=as_of), f"{target}/audit", batch_id)
        if _snapshot_due(batch_id):
            _write(_latest(_history(spark, f"{target}/changes", batch_id + 1), columns),
                   f"{target}/changes_snapshot", batch_id)

    return _start(changes, step, f"{target}/checkpoint", "append", available_now)


def _latest(history: DataFrame | None, columns: list[str]) -> DataFrame | None:
    """The last change of each order."""
    if history is None:
        return None
    return history.groupBy("OrderID").agg(
        F.max_by(F.struct(*columns[1:], "Deleted", "Sequence"), F.struct(BATCH, "Sequence")).alias("Now")
    ).select("OrderID", "Now.*")


def order_audit_log(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/audit").drop(BATCH)

