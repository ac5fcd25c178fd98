"""Taking back goods: check, refund, restock, and close orders."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwise import model
from tillwise.functions.clock import ts
from tillwise.functions.values import money, or_zero, text
from tillwise.operators.audit import job_trail
from tillwise.operators.prep import with_hash_key
from tillwise.plans.claims import TAKEN, settle_singles
from tillwise.plans.skew import HOT_ROWS, per_key
from tillwise.session import cut_lineage, kept_together
from tillwise.sources.merge import merge
from tillwise.store import Store

RETURNABLE = ("Delivered", "Shipped")
# Requests for one line that are tried one after another within its rows.
IN_ROW = 1000


def _ordered(store: Store, requests: DataFrame) -> DataFrame:
    """Per order and product of the orders asked about: the line and its coverage.

    With several lines of one product the one with the lowest key is returned.
    A line is open if no approved return covers it yet. ``Unequal`` counts
    approved returns below the line they are for. ``OrderOpen``,
    ``OrderUnequal`` and ``Bought`` cover the whole order.
    """
    order = Window.partitionBy("OrderID")
    asked = requests.select("OrderID").distinct()
    lines = store.scan(
        "order_detail", "OrderDetailID", "OrderID", "ProductID", "Quantity", "UnitPrice"
    ).join(asked, "OrderID", "left_semi")
    approved = (
        store.scan("product_return", "OrderID", "ProductID", "ReturnQuantity", "ReturnStatus")
        .where("ReturnStatus = 'Approved'").join(asked, "OrderID", "left_semi")
        .groupBy("OrderID", "ProductID").agg(F.min("ReturnQuantity").alias("LeastApproved"))
    )
    return (
        lines.groupBy("OrderID", "ProductID")
        .agg(
            F.min_by(F.struct("Quantity", "UnitPrice"), "OrderDetailID").alias("Line"),
            F.count("*").alias("Lines"),
            F.max("Quantity").alias("MostQuantity"),
            F.sum("Quantity").alias("AllQuantity"),
        )
        .join(approved, ["OrderID", "ProductID"], "left")
        .select(
            "OrderID", "ProductID", "AllQuantity", "MostQuantity",
            F.col("Line.Quantity").alias("Ordered"), F.col("Line.UnitPrice").alias("UnitPrice"),
            F.when(F.col("LeastApproved").isNull(), F.col("Lines")).otherwise(0).alias("Open"),
            F.coalesce(F.col("LeastApproved") < F.col("MostQuantity"), F.lit(False))
            .cast("int").alias("Unequal"),
        )
        .withColumns({
            "OrderOpen": F.sum("Open").over(order),
            "OrderUnequal": F.sum("Unequal").over(order),
            "Bought": F.sum("AllQuantity").over(order),
        })
    )


def _reject(checks: dict[str, Column]) -> Column:
    return F.coalesce(*[
        F.when(F.coalesce(failed, F.lit(False)), model.RETURN_REJECTS[name])
        for name, failed in checks.items()
    ])


def validate_returns(
    store: Store, requests: DataFrame, *, corrected: bool = False, in_row: int = IN_ROW
) -> DataFrame:
    """Each request with its order, refund and the first thing wrong with it.

    Requests have ReturnID, RequestedAt, OrderID, ProductID, ReturnQuantity,
    ReturnReason, RefundAmount and RestockProduct; they are taken in the order
    of RequestedAt and ReturnID.

    A single return that leaves no line of its order open closes the order, and
    later requests for it are refused. Earlier returns are neither added up nor
    held against the quantity; ``corrected`` does both.

    Everything a request is held against belongs to its order: requests, lines
    and returns are brought together by OrderID once, and the result is written.
    """
    orders = store.scan("sales_order", "OrderID", "CustomerID", "OrderDate", "OrderStatus")
    quantity = F.col("ReturnQuantity")
    joined = (
        requests
        .join(orders.join(requests.select("OrderID").distinct(), "OrderID", "left_semi"),
              "OrderID", "left")
        .join(_ordered(store, requests), ["OrderID", "ProductID"], "left")
        .withColumn("RefundAmount", F.coalesce(
            money(F.col("RefundAmount")), money(quantity * F.col("UnitPrice"))))
    )
    checks = {
        "line": F.col("Ordered").isNull() | F.col("OrderStatus").isNull(),
        "status": ~F.col("OrderStatus").isin(*RETURNABLE),
        "quantity": (quantity <= 0) | (quantity > F.col("Ordered")),
    }
    columns = [*requests.columns, "CustomerID", "OrderDate"]
    if corrected:
        return _validated_in_total(store, requests, joined, checks, columns, in_row)
    joined = joined.withColumn("ErrorMessage", _reject(checks))
    closes = (
        F.col("ErrorMessage").isNull()
        & (F.col("OrderOpen") == F.col("Open")) & (F.col("OrderUnequal") == 0)
        & (quantity >= F.col("MostQuantity"))
    )
    at = F.struct("RequestedAt", "ReturnID")
    late = at > F.col("ClosedBy")
    unfound = F.col("ErrorMessage") == model.RETURN_REJECTS["line"]
    checked = joined.withColumn(
        "ClosedBy", F.min(F.when(closes, at)).over(Window.partitionBy("OrderID"))
    ).withColumns({
        "ErrorMessage": F.when(
            late & ~F.coalesce(unfound, F.lit(False)), model.RETURN_REJECTS["status"]
        ).otherwise(F.col("ErrorMessage")),
        "ClosesOrder": F.coalesce(F.col("ClosedBy") == at, F.lit(False)),
    }).select(*columns, "ErrorMessage", "ClosesOrder")
    with kept_together(store.spark):
        return cut_lineage(checked)


def _refused_of_line(turns: Column, room: Column) -> Column:
    """ReturnIDs refused when the requests of a line are tried in turn."""
    return F.aggregate(
        turns,
        F.struct(room.cast("long").alias("room"), F.array().cast("array<string>").alias("gone")),
        lambda so_far, turn: F.when(
            turn["ReturnQuantity"] > so_far["room"],
            F.struct(so_far["room"].alias("room"),
                     F.array_append(so_far["gone"], text(turn["ReturnID"])).alias("gone")),
        ).otherwise(F.struct((so_far["room"] - turn["ReturnQuantity"]).alias("room"),
                             so_far["gone"].alias("gone"))),
        lambda end: end["gone"])


def _validated_in_total(
    store: Store, requests: DataFrame, joined: DataFrame, checks: dict[str, Column],
    columns: list[str], in_row: int,
) -> DataFrame:
    """All returns of a line together stay within what was ordered.

    Lines asked for more than is left are tried request by request: within
    their rows up to ``in_row`` requests, else (``Later``) with their whole
    order by :func:`settle_singles`.
    """
    earlier = (
        store.scan("product_return", "OrderID", "ProductID", "ReturnQuantity", "ReturnStatus")
        .where("ReturnStatus IN ('Approved', 'Processed')")
        .join(requests.select("OrderID").distinct(), "OrderID", "left_semi")
        .groupBy("OrderID", "ProductID").agg(F.sum("ReturnQuantity").alias("Earlier"))
    )
    before = earlier.groupBy("OrderID").agg(F.sum("Earlier").alias("Before"))
    checks = {**checks, "quantity": F.col("ReturnQuantity") <= 0}
    line, order = Window.partitionBy("OrderID", "ProductID"), Window.partitionBy("OrderID")
    sound, at = F.col("ErrorMessage").isNull(), F.struct("RequestedAt", "ReturnID")
    few = F.col("Short") & (F.col("Claims") <= in_row)
    refused = few & F.array_contains(
        _refused_of_line(F.col("Turns"), F.col("Room")), text(F.col("ReturnID")))
    taken = sound & ~F.col("Refused")
    known = (
        joined.join(earlier, ["OrderID", "ProductID"], "left").join(before, "OrderID", "left")
        .withColumns({"Room": F.col("AllQuantity") - or_zero(F.col("Earlier")),
                      "Before": or_zero(F.col("Before")), "ErrorMessage": _reject(checks)})
        .withColumns({
            "Short": sound & (or_zero(
                F.sum(F.when(sound, F.col("ReturnQuantity"))).over(line)) > F.col("Room")),
            "Claims": F.count(F.when(sound, 1)).over(line),
        })
        .withColumn("Turns", F.sort_array(F.collect_list(
            F.when(few, F.struct("RequestedAt", "ReturnID", "ReturnQuantity"))).over(line)))
        .withColumns({
            "Refused": F.coalesce(refused, F.lit(False)),
            "Later": F.bool_or(F.col("Short") & (F.col("Claims") > in_row)).over(order),
        })
        .withColumns({
            "Taken": F.sum(F.when(taken, F.col("ReturnQuantity"))).over(order),
            "Last": F.max(F.when(taken, at)).over(order),
        })
        .withColumn("Full", F.col("Taken") + F.col("Before") >= F.col("Bought"))
        .withColumns({
            "ErrorMessage": F.when(
                ~F.col("Later") & F.col("Refused"), model.RETURN_REJECTS["quantity"]
            ).otherwise(F.col("ErrorMessage")),
            "ClosesOrder": F.coalesce(F.col("Full") & (at == F.col("Last")), F.lit(False)),
        })
    )
    told = [*columns, "ErrorMessage", "ClosesOrder"]
    with kept_together(store.spark):
        known = cut_lineage(known.select(*told, "Later", *[
            F.when(F.col("Later"), F.col(c)).alias(c) for c in ("Room", "Bought", "Before")]))
    later = known.where("Later")
    if later.isEmpty():
        return known.select(*told)
    return known.where("NOT Later").select(*told).unionByName(_settled(later).select(*told))


def _settled(known: DataFrame) -> DataFrame:
    """Checked requests of whole orders with their lines settled."""
    line = F.to_json(F.array(F.col("OrderID").cast("string"), F.col("ProductID").cast("string")))
    known = known.withColumn("Line", line)
    sound = known.where(F.col("ErrorMessage").isNull())
    outcomes = settle_singles(
        sound.select("ReturnID", "RequestedAt", "Line", (-F.col("ReturnQuantity")).alias("Change")),
        sound.select("Line", F.col("Room").alias("Stock")).distinct(),
        unit="ReturnID", key="Line", order=["RequestedAt"])
    decided = known.join(outcomes, "ReturnID", "left").withColumn(
        "ErrorMessage",
        F.when(F.col("Outcome") != TAKEN, model.RETURN_REJECTS["quantity"])
        .otherwise(F.col("ErrorMessage")))
    full = (
        decided.where(F.col("Outcome") == TAKEN).groupBy("OrderID").agg(
            F.sum("ReturnQuantity").alias("Taken"), F.max("Before").alias("Most"),
            F.max("Bought").alias("All"),
            F.max(F.struct("RequestedAt", "ReturnID")).alias("Last"))
        .where(F.col("Taken") + F.col("Most") >= F.col("All"))
        .select("OrderID", "Last")
    )
    return decided.join(full, "OrderID", "left").withColumn(
        "ClosesOrder", F.coalesce(
            F.struct("RequestedAt", "ReturnID") == F.col("Last"), F.lit(False)))


def merge_closed_orders(
    spark: SparkSession, path: str, checked: DataFrame, *, as_of: datetime, partition: str, place: Column
) -> list:
    """Close the orders that ``checked`` (of :func:`validate_returns`) closes, in the table at ``path``.

    ``place`` gives the partition of an order from its OrderDate, which the
    checked requests carry: nothing but the partitions of closed orders is
    read or written. Gives these.
    """
    closed = checked.where(F.col("ErrorMessage").isNull() & F.col("ClosesOrder")).select(
        "OrderID", place.alias(partition), F.lit("Returned").alias("OrderStatus"),
        ts(as_of).alias("ModifiedDate"))
    return merge(spark, path, closed, key="OrderID", partition=partition, place=place)


def process_returns(
    store: Store, requests: DataFrame, *, as_of: datetime, actor: str = "loader",
    corrected: bool = False, hot_rows: int = HOT_ROWS,
) -> dict[str, DataFrame]:
    """Carry out the sound requests.

    Gives the new ``returns``, the ``ledger`` of what went back on the shelf,
    ``products`` with the new stock, ``orders`` with the closed ones, and
    ``rejects``.
    """
    checked = validate_returns(store, requests, corrected=corrected)
    sound = checked.where(F.col("ErrorMessage").isNull())
    returns = sound.select(
        "ReturnID", "OrderID", "OrderDate", "ProductID", "CustomerID", "ReturnQuantity",
        "RefundAmount", "ReturnReason", F.lit("Processed").alias("ReturnStatus"),
        "RestockProduct", ts(as_of).alias("ProcessedDate"), ts(as_of).alias("CreatedDate"),
        F.lit(actor).alias("CreatedBy"),
    )
    products = store.scan("product")
    back = sound.where("RestockProduct")
    met = per_key(
        back.select("ReturnID", "RequestedAt", "ProductID", "ReturnQuantity"),
        ["ProductID"], [F.col("RequestedAt"), F.col("ReturnID")],
        before={"BackBefore": "ReturnQuantity"}, hot_rows=hot_rows,
    ).join(products.select("ProductID", "StockQuantity"), "ProductID").withColumn(
        "Met", F.col("StockQuantity") + F.col("BackBefore"))
    ledger = with_hash_key(
        met.select(
            "ProductID", F.lit("Return").alias("TransactionType"),
            F.col("ReturnQuantity").alias("Quantity"),
            F.col("Met").cast("long").alias("PreviousStock"),
            (F.col("Met") + F.col("ReturnQuantity")).cast("long").alias("NewStock"),
            text(F.col("ReturnID")).alias("ReferenceID"), F.lit("Return").alias("ReferenceType"),
            ts(as_of).alias("TransactionDate"), F.lit(actor).alias("UserId"),
            F.concat(F.lit("Product return - ReturnID: "), text(F.col("ReturnID")))
            .alias("Notes"),
        ),
        "TransactionID", "TransactionType", "ReferenceID")
    units = back.groupBy("ProductID").agg(F.sum("ReturnQuantity").alias("Units"))
    after = (
        products.join(units, "ProductID", "left")
        .withColumns({
            "StockQuantity": (F.col("StockQuantity") + or_zero(F.col("Units"))).cast("int"),
            "ModifiedDate": F.when(F.col("Units").isNotNull(), ts(as_of))
            .otherwise(F.col("ModifiedDate")),
        })
        .select(*products.columns)
    )
    closed = sound.where("ClosesOrder").select("OrderID", F.lit(True).alias("Closed"))
    all_orders = store.scan("sales_order")
    orders = (
        all_orders.join(closed, "OrderID", "left")
        .withColumns({
            "OrderStatus": F.when(F.col("Closed"), "Returned").otherwise(F.col("OrderStatus")),
            "ModifiedDate": F.when(F.col("Closed"), ts(as_of))
            .otherwise(F.col("ModifiedDate")),
        })
        .select(*all_orders.columns)
    )
    rejects = checked.where(F.col("ErrorMessage").isNotNull()).select(
        "ReturnID", "OrderID", "ProductID", "ErrorMessage")
    trail = job_trail(products=(products, after), orders=(all_orders, orders), as_of=as_of, actor=actor)
    return {"returns": returns, "ledger": ledger, "products": after, "orders": orders,
            "rejects": rejects, **trail}
