"""Stock adjustments with their ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise import model
from tillwise.functions.clock import ts
from tillwise.functions.values import or_zero, text
from tillwise.operators.audit import job_trail
from tillwise.plans.claims import TAKEN, settle_singles
from tillwise.plans.skew import HOT_ROWS, per_key
from tillwise.session import cut_lineage
from tillwise.store import Store


def apply_inventory_adjustments(
    store: Store, adjustments: DataFrame, *, as_of: datetime, actor: str = "loader",
    hot_rows: int = HOT_ROWS,
) -> dict[str, DataFrame]:
    """Adjustments in the order of AdjustedAt and AdjustmentID.

    Adjustments have AdjustmentID, AdjustedAt, ProductID, AdjustmentType,
    Quantity (more or less stock), Notes and ReferenceID. Gives the ``ledger``,
    ``products`` with the new stock, and ``rejects``: unknown or inactive
    products, and draws beyond the stock at their turn.
    """
    products = store.scan("product")
    active = products.where("IsActive").select(
        "ProductID", F.col("StockQuantity").cast("long").alias("Stock"))
    known = adjustments.join(active, "ProductID", "left_semi")
    outcomes = settle_singles(
        known.select("AdjustmentID", "AdjustedAt", "ProductID",
                     F.col("Quantity").alias("Change")),
        active, unit="AdjustmentID", key="ProductID", order=["AdjustedAt"], hot_rows=hot_rows)
    marked = known.join(outcomes, "AdjustmentID").withColumn(
        "Moved", F.when(F.col("Outcome") == TAKEN, F.col("Quantity")).otherwise(0))
    # All outputs read what each adjustment met: written once.
    met = cut_lineage(per_key(
        marked, ["ProductID"], [F.col("AdjustedAt"), F.col("AdjustmentID")],
        before={"MovedBefore": "Moved"}, hot_rows=hot_rows,
        probe=adjustments.select("ProductID"),
    ).join(active, "ProductID").withColumn("Met", F.col("Stock") + F.col("MovedBefore")))
    taken = F.col("Outcome") == TAKEN
    ledger = met.where(taken).select(
        text(F.col("AdjustmentID")).alias("TransactionID"), "ProductID",
        F.col("AdjustmentType").alias("TransactionType"), "Quantity",
        F.col("Met").cast("long").alias("PreviousStock"),
        (F.col("Met") + F.col("Quantity")).cast("long").alias("NewStock"),
        text(F.col("ReferenceID")).alias("ReferenceID"), F.lit("Manual").alias("ReferenceType"),
        ts(as_of).alias("TransactionDate"), F.lit(actor).alias("UserId"),
        F.coalesce("Notes", F.lit("Manual inventory adjustment")).alias("Notes"),
    )
    rejects = adjustments.join(active, "ProductID", "left_anti").select(
        "AdjustmentID", "ProductID",
        F.lit(model.ADJUSTMENT_REJECTS["product"]).alias("ErrorMessage"),
    ).unionByName(met.where(~taken).select(
        "AdjustmentID", "ProductID",
        F.concat(F.lit(model.ADJUSTMENT_REJECTS["stock"]), text(F.col("Met").cast("long")))
        .alias("ErrorMessage"),
    ))
    moved = met.where(taken).groupBy("ProductID").agg(F.sum("Quantity").alias("Net"))
    after = (
        products.join(moved, "ProductID", "left")
        .withColumns({
            "StockQuantity": (F.col("StockQuantity") + or_zero(F.col("Net"))).cast("int"),
            "ModifiedDate": F.when(F.col("Net").isNotNull(), ts(as_of))
            .otherwise(F.col("ModifiedDate")),
        })
        .select(*products.columns)
    )
    trail = job_trail(products=(products, after), as_of=as_of, actor=actor)
    return {"ledger": ledger, "products": after, "rejects": rejects, **trail}
