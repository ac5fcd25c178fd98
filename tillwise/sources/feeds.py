"""Changes, faults and requests made from the retail tables by fixed arithmetic.

Each feed keeps every row of the table it starts from: rows are edited by
their key, moved to another key, or added to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.store import Store

SECOND_ADDRESS = 10_000_000_000
THIRD_ADDRESS = 20_000_000_000


def _edited(df: DataFrame, **edits: str) -> DataFrame:
    """``df`` with columns replaced by SQL expressions over the old values."""
    return df.select(*[
        F.expr(edits[f.name]).cast(f.dataType).alias(f.name) if f.name in edits else f.name
        for f in df.schema.fields
    ])


def orders_after(store: Store) -> DataFrame:
    """Orders after a day of changes: some re-keyed, some moved on, some re-priced."""
    return _edited(
        store.scan("sales_order"),
        OrderID="CASE WHEN OrderID % 50 = 9 THEN -OrderID ELSE OrderID END",
        OrderStatus="CASE WHEN OrderID % 10 = 3 THEN 'Shipped' ELSE OrderStatus END",
        TotalAmount="CASE WHEN OrderID % 10 = 4 THEN TotalAmount + 10 ELSE TotalAmount END",
    )


def order_changes(orders: DataFrame) -> DataFrame:
    """A change per order, batch or stream: as :func:`orders_after`, but re-keyed
    orders are deleted under their old key and added under the new one."""
    new = {
        "OrderStatus": "CASE WHEN OrderID % 10 = 3 THEN 'Shipped' ELSE OrderStatus END",
        "TotalAmount": "CAST(CASE WHEN OrderID % 10 = 4 THEN TotalAmount + 10"
                       " ELSE TotalAmount END AS DECIMAL(12,4))",
    }
    keys = "CASE WHEN OrderID % 50 = 9 THEN array(OrderID, -OrderID) ELSE array(OrderID) END"
    return orders.selectExpr(
        "OrderID AS OldID", "CustomerID",
        *[f"{value} AS {name}" for name, value in new.items()],
        f"explode({keys}) AS OrderID",
    ).selectExpr(
        "OrderID", "CustomerID", "TotalAmount", "OrderStatus",
        "OldID % 50 = 9 AND OrderID = OldID AS Deleted")


def order_steps(orders: DataFrame) -> DataFrame:
    """:func:`order_changes` with a Step; every tenth order is returned first and then put back."""
    steps = F.when(F.col("OrderID") % 10 == 6, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    return order_changes(orders).withColumn("Step", F.explode(steps)).withColumn(
        "OrderStatus", F.when(F.col("Step") == 1, "Returned").otherwise(F.col("OrderStatus")))


def products_after(store: Store) -> DataFrame:
    """Products after a day of sales and price changes; some stocks fall below zero."""
    return _edited(
        store.scan("product"),
        Price="CASE WHEN ProductID % 9 = 2 THEN Price + 1 ELSE Price END",
        StockQuantity="CASE WHEN ProductID % 3 = 1 THEN StockQuantity - 40 ELSE StockQuantity END",
    )


def details_after(store: Store) -> DataFrame:
    """Order lines after one more unit on lines of every other product."""
    return _edited(
        store.scan("order_detail"),
        Quantity="Quantity + CAST(ProductID % 2 AS INT)",
        LineTotal="(Quantity + CAST(ProductID % 2 AS INT)) * UnitPrice - DiscountAmount",
    )


def untaxed_orders(store: Store) -> DataFrame:
    return _edited(
        store.scan("sales_order"),
        TaxAmount="CASE WHEN OrderID % 13 = 0 THEN 0 ELSE TaxAmount END",
    )


def addresses_after(store: Store, table: str, key: str) -> tuple[DataFrame, DataFrame]:
    """All addresses after two more per customer were added, and the added ones."""
    old = store.scan(table)
    second = _edited(old, **{key: f"{key} + {SECOND_ADDRESS}",
                             "IsDefault": "CustomerID % 3 = 0"})
    third = _edited(old, **{key: f"{key} + {THIRD_ADDRESS}",
                            "IsDefault": "CustomerID % 4 = 0"})
    new = second.unionByName(third)
    return old.unionByName(new), new


def order_updates(store: Store) -> DataFrame:
    """One update per order, with unknown where nothing changes."""
    return store.scan("sales_order", "OrderID", "OrderDate").selectExpr(
        "OrderID",
        "CASE OrderID % 3 WHEN 0 THEN 'Shipped' WHEN 1 THEN 'Delivered' END AS OrderStatus",
        "CASE WHEN OrderID % 2 = 0 THEN 'Captured' END AS PaymentStatus",
        "CASE WHEN OrderID % 5 = 0 THEN 'UPD' || OrderID END AS TrackingNumber",
        "CASE WHEN OrderID % 3 = 1 THEN OrderDate + make_dt_interval(3) END"
        " AS ActualDeliveryDate",
    )


def nested_categories(store: Store) -> Store:
    """The store with categories up to six deep, two that are above each other, and one below those."""
    return store.replacing(category=store.scan("category").withColumn("ParentCategoryID", F.expr("""
        CASE WHEN CategoryID IN (59, 60) THEN 119 - CategoryID WHEN CategoryID = 1000 THEN 60
             WHEN CategoryID > 25 THEN CategoryID - 10 WHEN CategoryID > 5 THEN CategoryID - 15 END""")))


def customer_changes(store: Store) -> DataFrame:
    """Every customer with a new name or number, and as many new customers."""
    old = store.scan("customer")
    changed = _edited(
        old,
        CustomerName="CustomerName || ' II'",
        Email="CASE WHEN CustomerID % 2 = 0 THEN '  ' || upper(Email) END",
        PhoneNumber="CASE WHEN CustomerID % 5 = 0 THEN '555-9999' END",
        IsActive="CASE WHEN CustomerID % 6 = 0 THEN false END",
    )
    added = _edited(
        old,
        CustomerID="-CustomerID - 1",
        Email="'new.' || Email",
        IsActive="CAST(NULL AS BOOLEAN)",
    )
    return changed.unionByName(added)


def reconciled(store: Store) -> Store:
    """Orders whose subtotal is the sum of their lines, off by one on some."""
    sums = store.scan("order_detail", "OrderID", "LineTotal").groupBy("OrderID").agg(
        F.sum("LineTotal").alias("LineSum"))
    orders = store.scan("sales_order")
    told = orders.join(sums, "OrderID", "left").withColumn(
        "SubTotal",
        F.expr("CAST(coalesce(LineSum, 0) + CASE WHEN OrderID % 50 = 7 THEN 1 ELSE 0 END"
               " AS DECIMAL(12,4))"),
    ).select(*orders.columns)
    return store.replacing(sales_order=told)


def with_faults(store: Store) -> Store:
    """The store with rows of every table broken by key."""
    sound = reconciled(store)
    return sound.replacing(
        category=_edited(
            store.scan("category"),
            ParentCategoryID="CASE WHEN CategoryID = 20 THEN 20 WHEN CategoryID = 21 THEN 77"
                             " ELSE ParentCategoryID END",
        ),
        product=_edited(
            store.scan("product"),
            CategoryID="CASE WHEN ProductID % 500 = 3 THEN 999 ELSE CategoryID END",
            StockQuantity="CASE WHEN ProductID % 400 = 7 THEN -5 ELSE StockQuantity END",
            Price="CASE WHEN ProductID % 700 = 11 THEN 0 ELSE Price END",
            ProductSKU="CASE WHEN ProductID % 900 = 1 THEN 'SKU-SHARED' ELSE ProductSKU END",
        ),
        customer=_edited(
            store.scan("customer"),
            Email="CASE WHEN CustomerID % 500 = 2 THEN 'shared@example.com' ELSE Email END",
        ),
        shipping_address=_edited(
            store.scan("shipping_address"),
            AddressType="CASE WHEN CustomerID % 250 = 6 THEN 'Home' ELSE AddressType END",
        ),
        sales_order=_edited(
            sound.scan("sales_order"),
            CustomerID="CASE WHEN OrderID % 444 = 5 THEN -1 ELSE CustomerID END",
            OrderStatus="CASE WHEN OrderID % 333 = 4 THEN 'Unknown' ELSE OrderStatus END",
            ExpectedDeliveryDate="CASE WHEN OrderID % 300 = 9 THEN OrderDate"
                                 " ELSE ExpectedDeliveryDate END",
            PaymentStatus="CASE WHEN OrderID % 600 = 1 THEN NULL ELSE PaymentStatus END",
        ),
        order_detail=_edited(
            store.scan("order_detail"),
            OrderID="CASE WHEN OrderID % 200 = 17 THEN -OrderID ELSE OrderID END",
            DiscountAmount="CASE WHEN ProductID % 800 = 5 THEN 99999 ELSE DiscountAmount END",
        ),
        inventory_transaction=_edited(
            store.scan("inventory_transaction"),
            NewStock="CASE WHEN CAST(ReferenceID AS BIGINT) % 97 = 13 THEN NewStock + 1"
                     " ELSE NewStock END",
        ),
    )


def order_requests(store: Store) -> DataFrame:
    """One request per order line, with one to three items as JSON.

    Some lists are broken, empty, ask for an unknown product or name a product
    twice; some addresses are someone else's.
    """
    item = ("'{\"ProductID\":' || {p} || ',\"Quantity\":' || {q}"
            " || ',\"UnitPrice\":' || UnitPrice || '}'")
    first = item.replace("{p}", "CASE WHEN OrderID % 89 = 3 THEN -1 ELSE ProductID END").replace(
        "{q}", "CASE WHEN OrderID % 97 = 5 THEN '\"many\"' ELSE CAST(Quantity AS STRING) END")
    second = item.replace("{p}", "(ProductID DIV 2)").replace("{q}", "(1 + Quantity % 5)")
    third = item.replace("{p}", "ProductID").replace("{q}", "1")
    return store.scan(
        "order_detail", "OrderDetailID", "OrderID", "ProductID", "Quantity", "UnitPrice",
        "CreatedDate",
    ).withColumn("Buyer", F.expr("OrderID DIV 10")).selectExpr(
        "OrderDetailID AS OrderID",
        "Buyer AS CustomerID",
        "CreatedDate AS RequestDate",
        "CASE WHEN OrderID % 7 = 0 THEN NULL WHEN OrderID % 11 = 0 THEN Buyer + 1"
        " ELSE Buyer END AS ShippingAddressID",
        "CASE WHEN OrderID % 5 = 0 THEN NULL WHEN OrderID % 13 = 0 THEN -1"
        " ELSE Buyer END AS BillingAddressID",
        "CASE OrderID % 3 WHEN 0 THEN 'Express' WHEN 1 THEN 'Economy' END AS ShippingMethod",
        "CASE WHEN OrderID % 101 = 7 THEN '[]' WHEN OrderID % 103 = 9 THEN 'no list'"
        f" ELSE '[' || {first}"
        f" || CASE WHEN Quantity % 2 = 0 THEN ',' || {second} ELSE '' END"
        f" || CASE WHEN Quantity % 7 = 3 THEN ',' || {third} ELSE '' END"
        " || ']' END AS OrderItems",
        "CASE WHEN OrderID % 4 = 0 THEN CAST(0.05 AS DECIMAL(5,4)) END AS TaxRate",
        "CAST(5.99 AS DECIMAL(12,4)) AS ShippingAmount",
        "CAST(OrderID % 3 AS DECIMAL(12,4)) AS DiscountAmount",
    )


def roomy(store: Store, times: int = 10, plus: int = 0) -> Store:
    """The store with that many times the stock, and some more."""
    return store.replacing(product=_edited(
        store.scan("product"), StockQuantity=f"StockQuantity * {times} + {plus}"))


def stock_adjustments(store: Store) -> DataFrame:
    """One adjustment per order line, a quarter of them deliveries."""
    return store.scan("order_detail", "OrderDetailID", "OrderID", "ProductID", "Quantity",
                      "CreatedDate").selectExpr(
        "OrderDetailID AS AdjustmentID",
        "CreatedDate AS AdjustedAt",
        "ProductID",
        "CASE OrderID % 4 WHEN 0 THEN 'Restock' WHEN 1 THEN 'Damage' WHEN 2 THEN 'Transfer'"
        " ELSE 'Adjustment' END AS AdjustmentType",
        "CASE WHEN OrderID % 4 = 0 THEN Quantity * 2 ELSE -Quantity END AS Quantity",
        "CASE WHEN OrderID % 2 = 0 THEN 'count of ' || OrderID END AS Notes",
        "CAST(OrderID AS STRING) AS ReferenceID",
    )


def return_requests(store: Store) -> DataFrame:
    """One request per order line: whole, half, too many, or for another product."""
    return store.scan("order_detail", "OrderDetailID", "OrderID", "ProductID", "Quantity",
                      "UnitPrice", "CreatedDate").selectExpr(
        "'Q-' || OrderDetailID AS ReturnID",
        "CreatedDate AS RequestedAt",
        "OrderID",
        "CASE WHEN Quantity % 17 = 5 THEN ProductID + 1 ELSE ProductID END AS ProductID",
        "CAST(CASE WHEN Quantity % 13 = 1 THEN Quantity + 1 WHEN Quantity % 11 = 1 THEN 0"
        "     WHEN OrderID % 2 = 0 THEN Quantity ELSE 1 + Quantity DIV 2 END AS INT)"
        " AS ReturnQuantity",
        "CASE WHEN Quantity % 2 = 0 THEN 'Damaged' END AS ReturnReason",
        "CASE WHEN OrderID % 3 = 0 THEN CAST(9.99 AS DECIMAL(12,4)) END AS RefundAmount",
        "OrderID % 5 <> 0 AS RestockProduct",
    )
