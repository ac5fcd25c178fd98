"""Audit rows and stock checks from the state of a table before and after a change."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.clock import ts
from tillwise.functions.values import text


def audit_columns(
    table: str, operation: Column | str, key: Column, old: Column, new: Column, *,
    as_of: datetime, actor: str, application: str,
) -> list[Column]:
    return [
        F.lit(table).alias("TableName"),
        (operation if isinstance(operation, Column) else F.lit(operation)).alias("Operation"),
        text(key).alias("PrimaryKeyValue"),
        old.cast("string").alias("OldValues"),
        new.cast("string").alias("NewValues"),
        F.lit(actor).alias("ChangedBy"),
        ts(as_of).alias("ChangedDate"),
        F.lit(application).alias("Application"),
    ]


def order_audit_trail(
    before: DataFrame, after: DataFrame, *, as_of: datetime, actor: str = "loader",
    application: str = "tillwise",
) -> DataFrame:
    """A row per order added, removed, or changed in status or total."""
    columns = ["OrderID", "CustomerID", "TotalAmount", "OrderStatus"]
    pairs = before.select(*columns).alias("b").join(
        after.select(*columns).alias("a"), F.col("a.OrderID") == F.col("b.OrderID"), "full")
    return order_audit_of(pairs, as_of=as_of, actor=actor, application=application)


def order_audit_of(
    pairs: DataFrame, *, as_of: datetime, actor: str = "loader", application: str = "tillwise"
) -> DataFrame:
    """Audit rows of single changes: ``b`` is the order before, ``a`` after, either may be unknown."""
    def whole(side: str) -> Column:
        return F.concat(
            F.lit("CustomerID="), text(F.col(f"{side}.CustomerID")),
            F.lit(", TotalAmount="), text(F.col(f"{side}.TotalAmount")),
            F.lit(", OrderStatus="), F.col(f"{side}.OrderStatus"))

    def brief(side: str) -> Column:
        return F.concat(
            F.lit("OrderStatus="), F.col(f"{side}.OrderStatus"),
            F.lit(", TotalAmount="), text(F.col(f"{side}.TotalAmount")))

    added, removed = F.col("b.OrderID").isNull(), F.col("a.OrderID").isNull()
    changed = (F.col("a.OrderStatus") != F.col("b.OrderStatus")) | (
        F.col("a.TotalAmount") != F.col("b.TotalAmount"))
    return pairs.where((added != removed) | changed).select(*audit_columns(
        "Order",
        F.when(added, "INSERT").when(removed, "DELETE").otherwise("UPDATE"),
        F.coalesce("a.OrderID", "b.OrderID"),
        F.when(removed, whole("b")).when(~added, brief("b")),
        F.when(added, whole("a")).when(~removed, brief("a")),
        as_of=as_of, actor=actor, application=application,
    ))


def _product_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    columns = ["ProductID", "Price", "StockQuantity", "ReorderLevel"]
    return before.select(*columns).alias("b").join(
        after.select(*columns).alias("a"), F.col("a.ProductID") == F.col("b.ProductID"))


def product_audit_trail(
    before: DataFrame, after: DataFrame, *, as_of: datetime, actor: str = "loader",
    application: str = "tillwise",
) -> DataFrame:
    """A row per product changed in price or stock."""
    changed = (F.col("a.Price") != F.col("b.Price")) | (
        F.col("a.StockQuantity") != F.col("b.StockQuantity"))

    def values(side: str) -> Column:
        return F.concat(F.lit("Price="), text(F.col(f"{side}.Price")),
                        F.lit(", Stock="), text(F.col(f"{side}.StockQuantity")))

    return _product_pairs(before, after).where(changed).select(*audit_columns(
        "Product", "UPDATE", F.col("a.ProductID"), values("b"), values("a"),
        as_of=as_of, actor=actor, application=application,
    ))


def stock_alerts(
    before: DataFrame, after: DataFrame, *, as_of: datetime, actor: str = "loader",
    application: str = "tillwise",
) -> dict[str, DataFrame]:
    """Check a change of stock.

    ``rejects`` are products that would go below zero; ``products`` is the
    state afterwards, with rejected products as they were and a new
    ModifiedDate where stock changed; ``alerts`` are audit rows for products
    that fell to their reorder level or below.
    """
    negative = F.col("StockQuantity") < 0
    was = before.select(
        "ProductID", F.col("StockQuantity").alias("OldStock"),
        F.col("ReorderLevel").alias("OldLevel"))
    rejects = after.where(negative).select(
        "ProductID", "StockQuantity",
        F.lit("Stock quantity cannot be negative.").alias("ErrorMessage"))
    sound = after.where(~negative).join(was, "ProductID", "left")
    moved = F.col("StockQuantity") != F.col("OldStock")
    products = (
        sound.withColumn(
            "ModifiedDate", F.when(moved, ts(as_of)).otherwise(F.col("ModifiedDate")))
        .select(*after.columns)
        .unionByName(before.join(rejects.select("ProductID"), "ProductID", "left_semi")
                     .select(*after.columns))
    )
    alerts = alerts_of(sound, as_of=as_of, actor=actor, application=application)
    return {"products": products, "alerts": alerts, "rejects": rejects}


def alerts_of(
    moved: DataFrame, *, as_of: datetime, actor: str = "loader", application: str = "tillwise"
) -> DataFrame:
    """Alerts for products that went from above OldLevel (OldStock) to ReorderLevel or below."""
    crossed = (F.col("StockQuantity") <= F.col("ReorderLevel")) & (
        F.col("OldStock") > F.col("OldLevel"))
    return moved.where(crossed).select(*audit_columns(
        "Product", "STOCK_ALERT", F.col("ProductID"),
        F.concat(F.lit("Stock: "), text(F.col("OldStock"))),
        F.concat(F.lit("Stock: "), text(F.col("StockQuantity")),
                 F.lit(" (Below Reorder Level: "), text(F.col("ReorderLevel")), F.lit(")")),
        as_of=as_of, actor=actor, application=application,
    ))


def job_trail(
    *, products: tuple[DataFrame, DataFrame], orders: tuple[DataFrame, DataFrame] | None = None,
    as_of: datetime, actor: str = "loader", application: str = "tillwise",
) -> dict[str, DataFrame]:
    """What the tables' triggers write when a job changes them: ``audit`` rows of
    products and orders, and ``alerts``. Tables are given before and after the job."""
    said = {"as_of": as_of, "actor": actor, "application": application}
    audit = product_audit_trail(*products, **said)
    if orders is not None:
        audit = audit.unionByName(order_audit_trail(*orders, **said))
    return {"audit": audit, "alerts": stock_alerts(*products, **said)["alerts"]}


def validate_inventory_ledger(batch: DataFrame, products: DataFrame) -> DataFrame:
    """Movements of ``batch`` that disagree with their product or with themselves."""
    columns = ["TransactionID", "ProductID", "PreviousStock", "Quantity", "NewStock"]
    moves = batch.select(*columns)
    apart = moves.join(products.select("ProductID", "StockQuantity"), "ProductID").where(
        F.col("NewStock") != F.col("StockQuantity"))
    wrong = moves.where(F.col("PreviousStock") + F.col("Quantity") != F.col("NewStock"))
    return apart.select("TransactionID", "ProductID", F.lit("stock_differs").alias("Rule")).union(
        wrong.select("TransactionID", "ProductID", F.lit("sum_differs").alias("Rule")))
