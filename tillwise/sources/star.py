"""The retail tables, bound to a star schema of orders, lines, parts and customers.

The star schema has no stock, tiers, returns or status flow of its own, so
those columns follow from its keys by fixed arithmetic. Every row of every
source table is used.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.plans.skew import per_key
from tillwise.store import Store

# The moment all reports look back from: the last order day of the data.
AS_OF = datetime(2001, 8, 1, 12, 0, 0)
HISTORY_START = datetime(1995, 1, 1)

OPENING_STOCK = 10_000
RESTOCK_EVERY = 10
RESTOCK_QUANTITY = 255

_EPOCH = "TIMESTAMP_NTZ'1995-01-01 00:00:00'"
_ACTOR = "'loader'"

_CATEGORY_COLUMNS = f"""
    CategoryID, CategoryName, CategoryDescription, ParentCategoryID,
    CASE WHEN ParentCategoryID IS NULL THEN 0 ELSE 1 END AS CategoryLevel,
    true AS IsActive, {_EPOCH} AS CreatedDate, {_EPOCH} AS ModifiedDate
"""

_PRODUCT = f"""
    p_partkey AS ProductID,
    p_name AS ProductName,
    CAST(substring(p_brand, 7) AS INT) + 5 AS CategoryID,
    CAST(p_retailprice AS DECIMAL(12,4)) AS Price,
    CAST((p_partkey * 7) % 120 AS INT) AS StockQuantity,
    p_size AS ReorderLevel,
    p_type AS ProductDescription,
    CAST(NULL AS BINARY) AS ProductImage,
    'SKU-' || lpad(CAST(p_partkey AS STRING), 8, '0') AS ProductSKU,
    p_partkey % 25 <> 0 AS IsActive,
    {_EPOCH} AS CreatedDate,
    {_EPOCH} + make_dt_interval(CAST(p_partkey % 2000 AS INT)) AS ModifiedDate
"""

_CUSTOMER = f"""
    c_custkey AS CustomerID,
    c_name AS CustomerName,
    lower(replace(c_name, '#', '.')) || '@example.com' AS Email,
    CASE WHEN c_custkey % 7 <> 0
         THEN '555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') END AS PhoneNumber,
    CAST(c_custkey AS STRING) || ' Market St' AS Address,
    CAST(NULL AS STRING) AS ShippingAddress,
    CAST(NULL AS STRING) AS BillingAddress,
    c_custkey % 20 <> 0 AS IsActive,
    {_EPOCH} + make_dt_interval(CAST(c_custkey % 1000 AS INT)) AS CreatedDate,
    {_EPOCH} + make_dt_interval(CAST(c_custkey % 1000 AS INT)) AS ModifiedDate,
    CASE WHEN c_custkey % 3 <> 0
         THEN TIMESTAMP_NTZ'2001-08-01 12:00:00'
              - make_dt_interval(CAST(c_custkey % 60 AS INT)) END AS LastLoginDate
"""

# Prices come as doubles of whole cents: half a cent more, cut off, gives the
# cents. From there on numbers are exact.
_ORDER_CORE = """
    o_orderkey AS OrderID,
    CASE WHEN o_custkey % 40 = 39 THEN o_custkey - 1 ELSE o_custkey END AS CustomerID,
    o_orderdate AS OrderDate,
    CASE WHEN o_orderkey % 20 = 0 THEN 'Cancelled'
         WHEN o_orderstatus = 'F' AND o_orderkey % 20 = 1 THEN 'Returned'
         WHEN o_orderstatus = 'F' THEN 'Delivered'
         WHEN o_orderstatus = 'P' THEN 'Processing'
         WHEN o_orderkey % 2 = 0 THEN 'Pending'
         ELSE 'Shipped' END AS OrderStatus,
    CAST(CAST(CAST(o_totalprice * 100 + 0.5 AS BIGINT)
              DIV (CASE WHEN o_custkey % 25 = 0 THEN 100 ELSE 1000 END) AS DECIMAL(10,0))
         * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,4)) AS SubTotal,
    CAST(o_orderkey % 3 AS DECIMAL(12,4)) AS WantedDiscount
"""

_ORDER = """
    OrderID, CustomerID, OrderDate, OrderStatus,
    CASE WHEN CustomerID % 10 <> 0 THEN CustomerID END AS ShippingAddressID,
    CASE WHEN CustomerID % 10 <> 5 THEN CustomerID END AS BillingAddressID,
    SubTotal,
    CAST(SubTotal * CAST(0.0875 AS DECIMAL(5,4)) AS DECIMAL(12,4)) AS TaxAmount,
    CAST(5.99 AS DECIMAL(12,4)) AS ShippingAmount,
    CASE WHEN WantedDiscount > SubTotal THEN CAST(0 AS DECIMAL(12,4))
         ELSE WantedDiscount END AS DiscountAmount,
    CASE OrderID % 4 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Authorized'
                     WHEN 2 THEN 'Captured' ELSE 'Failed' END AS PaymentStatus,
    CASE OrderID % 5 WHEN 0 THEN 'Standard' WHEN 1 THEN 'Express'
                     WHEN 2 THEN 'Overnight' WHEN 3 THEN 'Economy' END AS ShippingMethod,
    CASE WHEN OrderStatus IN ('Shipped', 'Delivered', 'Returned')
         THEN 'TRK' || lpad(CAST(OrderID AS STRING), 10, '0') END AS TrackingNumber,
    OrderDate + make_dt_interval(5) AS ExpectedDeliveryDate,
    CASE WHEN OrderStatus IN ('Delivered', 'Returned')
         THEN OrderDate + make_dt_interval(CAST(OrderID % 9 AS INT)) END AS ActualDeliveryDate,
    CAST(NULL AS STRING) AS Notes,
    OrderDate AS CreatedDate,
    OrderDate AS ModifiedDate
"""

_LINE_CORE = """
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
              unix_date(CAST(l_shipdate AS DATE)), CAST(l_extendedprice * 100 + 0.5 AS BIGINT))
        AS OrderDetailID,
    l_orderkey AS OrderID,
    l_partkey AS ProductID,
    CAST(l_quantity AS INT) AS Quantity,
    CAST(CAST(greatest(CAST(l_extendedprice * 100 + 0.5 AS BIGINT)
                       DIV (CAST(l_quantity AS BIGINT) * 1000), 1) AS DECIMAL(10,0))
         * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,4)) AS UnitPrice,
    CAST(CAST(CAST(l_discount * 100 + 0.5 AS INT) AS DECIMAL(4,0))
         * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(4,2)) AS Rate,
    l_shipdate AS CreatedDate,
    l_returnflag, l_linestatus
"""

_LINE = """
    OrderDetailID, OrderID, ProductID, Quantity, UnitPrice,
    CAST(Quantity * UnitPrice * Rate AS DECIMAL(12,4)) AS DiscountAmount,
    CreatedDate, l_returnflag, l_linestatus
"""


def split_columns(text: str) -> list[str]:
    """The select expressions of ``text``, cut at commas outside brackets."""
    parts, depth, start = [], 0, 0
    for at, sign in enumerate(text):
        depth += (sign == "(") - (sign == ")")
        if sign == "," and depth == 0:
            parts.append(text[start:at])
            start = at + 1
    return [p.strip() for p in [*parts, text[start:]]]


def order_columns(raw: DataFrame) -> DataFrame:
    """Orders of the star schema as sales orders; row by row, batch or stream."""
    return (
        raw.selectExpr(*split_columns(_ORDER_CORE))
        .selectExpr(*split_columns(_ORDER))
        .withColumn(
            "TotalAmount",
            F.expr("CAST(SubTotal + TaxAmount + ShippingAmount - DiscountAmount"
                   " AS DECIMAL(12,4))"),
        )
    )


def line_columns(raw: DataFrame) -> DataFrame:
    """Lines of the star schema as order details; row by row, batch or stream."""
    return (
        raw.selectExpr(*split_columns(_LINE_CORE))
        .selectExpr(*split_columns(_LINE))
        .withColumn(
            "LineTotal",
            F.expr("CAST(Quantity * UnitPrice - DiscountAmount AS DECIMAL(18,4))"),
        )
    )


class StarTables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A source table; its footer is read for the schema once."""
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._raw[name]

    def category(self, _wanted: frozenset[str] | None) -> DataFrame:
        fixed = self.spark.sql("""
            SELECT CAST(id AS INT) AS CategoryID, 'Dept ' || id AS CategoryName,
                   'Department ' || id AS CategoryDescription,
                   CAST(NULL AS INT) AS ParentCategoryID
            FROM range(1, 6)
            UNION ALL SELECT 1000, 'Clearance', 'Nothing on sale yet', 5
        """)
        brands = (
            self.raw("part").select("p_brand").distinct()
            .selectExpr("p_brand", "CAST(substring(p_brand, 7) AS INT) AS n")
            .selectExpr("n + 5 AS CategoryID", "p_brand AS CategoryName",
                        "'Range ' || n AS CategoryDescription",
                        "(n - 1) % 5 + 1 AS ParentCategoryID")
        )
        return fixed.unionByName(brands).selectExpr(*split_columns(_CATEGORY_COLUMNS))

    def product(self, _wanted: frozenset[str] | None) -> DataFrame:
        return self.raw("part").selectExpr(*split_columns(_PRODUCT)).withColumn(
            "IsLowStock", F.expr("CASE WHEN StockQuantity <= ReorderLevel THEN 1 ELSE 0 END")
        )

    def customer(self, _wanted: frozenset[str] | None) -> DataFrame:
        return self.raw("customer").selectExpr(*split_columns(_CUSTOMER))

    def _address(self, wanted: frozenset[str] | None, key: str) -> DataFrame:
        people = self.raw("customer")
        if wanted is None or wanted & {"City", "StateProvince"}:
            places = self.raw("nation").join(
                self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")
            ).select("n_nationkey", "n_name", "r_name")
            people = people.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        else:
            people = people.selectExpr("*", "'' AS n_name", "'' AS r_name")
        return people.selectExpr(
            f"c_custkey AS {key}",
            "c_custkey AS CustomerID",
            "CAST(c_custkey AS STRING) || ' Market St' AS AddressLine1",
            "CASE WHEN c_custkey % 2 = 0 THEN 'Unit ' || (c_custkey % 50) END AS AddressLine2",
            "n_name AS City",
            "r_name AS StateProvince",
            "lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') AS PostalCode",
            "'USA' AS Country",
            "CASE WHEN c_custkey % 4 = 0 THEN 'Both' ELSE 'Shipping' END AS AddressType",
            "true AS IsDefault",
            "c_custkey % 30 <> 1 AS IsActive",
            f"{_EPOCH} AS CreatedDate",
        )

    def shipping_address(self, wanted: frozenset[str] | None) -> DataFrame:
        return self._address(wanted, "ShippingAddressID")

    def billing_address(self, wanted: frozenset[str] | None) -> DataFrame:
        return self._address(wanted, "BillingAddressID").drop("AddressType")

    def sales_order(self, _wanted: frozenset[str] | None) -> DataFrame:
        return order_columns(self.raw("orders"))

    def order_detail(self, _wanted: frozenset[str] | None) -> DataFrame:
        return line_columns(self.raw("lineitem")).drop("l_returnflag", "l_linestatus")

    def product_return(self, wanted: frozenset[str] | None) -> DataFrame:
        """Lines flagged as returned."""
        lines = line_columns(self.raw("lineitem")).where("l_returnflag = 'R'").selectExpr(
            "'R-' || OrderDetailID AS ReturnID",
            "OrderID", "ProductID",
            "CAST(1 + Quantity DIV 10 AS INT) AS ReturnQuantity",
            "CAST((1 + Quantity DIV 10) * UnitPrice AS DECIMAL(12,4)) AS RefundAmount",
            "CASE WHEN Quantity % 2 = 0 THEN 'Changed mind' ELSE 'Damaged' END AS ReturnReason",
            "CASE WHEN l_linestatus = 'F' THEN 'Processed' ELSE 'Approved' END AS ReturnStatus",
            "true AS RestockProduct",
            "CASE WHEN l_linestatus = 'F' THEN CreatedDate END AS ProcessedDate",
            "CreatedDate",
            f"{_ACTOR} AS CreatedBy",
        )
        if wanted is not None and not wanted & {"OrderDate", "CustomerID"}:
            return lines
        return lines.join(
            self.sales_order(None).select("OrderID", "OrderDate", "CustomerID"), "OrderID", "left"
        )

    def inventory_transaction(self, wanted: frozenset[str] | None) -> DataFrame:
        """Every line as a sale, with a delivery after each tenth sale of a product."""
        lines = self.order_detail(None).select(
            "OrderDetailID", "OrderID", "ProductID", "Quantity", "CreatedDate"
        )
        placed = per_key(
            lines, ["ProductID"], [F.col("CreatedDate"), F.col("OrderDetailID")],
            rank="Nth", before={"SoldBefore": "Quantity"},
            probe=self.raw("lineitem").select(F.col("l_partkey").alias("ProductID")),
        )
        sale_from = (f"{OPENING_STOCK} - SoldBefore"
                     f" + {RESTOCK_QUANTITY} * ((Nth - 1) DIV {RESTOCK_EVERY})")
        moves = f"""
            CASE WHEN Nth % {RESTOCK_EVERY} = 0
            THEN array(
                named_struct('k', 'Sale', 'q', -Quantity, 'p', {sale_from}),
                named_struct('k', 'Restock', 'q', {RESTOCK_QUANTITY},
                             'p', {sale_from} - Quantity))
            ELSE array(named_struct('k', 'Sale', 'q', -Quantity, 'p', {sale_from})) END
        """
        return placed.select("*", F.inline(F.expr(moves))).selectExpr(
            "k || '-' || OrderDetailID AS TransactionID",
            "ProductID",
            "k AS TransactionType",
            "q AS Quantity",
            "CAST(p AS BIGINT) AS PreviousStock",
            "CAST(p + q AS BIGINT) AS NewStock",
            "CAST(OrderID AS STRING) AS ReferenceID",
            "CASE k WHEN 'Sale' THEN 'Order' ELSE 'Restock' END AS ReferenceType",
            "CASE k WHEN 'Sale' THEN CreatedDate"
            " ELSE CreatedDate + make_dt_interval(0, 1) END AS TransactionDate",
            f"{_ACTOR} AS UserId",
            "CAST(NULL AS STRING) AS Notes",
        )

    def inventory_transactions(self) -> DataFrame:
        """How many rows :meth:`inventory_transaction` has, from the number of lines per product."""
        sales = self.raw("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
        return sales.agg(F.coalesce(F.sum(F.expr(f"n + n DIV {RESTOCK_EVERY}")), F.lit(0)).alias("RecordCount"))


def star_store(spark: SparkSession, path: str) -> Store:
    tables = StarTables(spark, path)
    builds: dict[str, Callable[[frozenset[str] | None], DataFrame]] = {
        name: getattr(tables, name)
        for name in ("category", "product", "customer", "shipping_address", "billing_address",
                     "sales_order", "order_detail", "product_return", "inventory_transaction")
    }
    return Store(spark, builds, {"inventory_transaction": tables.inventory_transactions})
