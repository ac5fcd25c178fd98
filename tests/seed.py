"""A small shop whose results were worked out by hand."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tillwise import model
from tillwise.operators import audit, inventory, orders, prep, returns
from tillwise.operators.prep import (
    apply_defaults,
    with_category_level,
    with_low_stock_flag,
)
from tillwise.store import Store

AS_OF = datetime(2024, 6, 14, 15, 30)
OLD = AS_OF - timedelta(days=45)

# ---------------------------------------------------------------- fixed values
ROOTS = ["Electronics", "Clothing", "Home & Garden", "Books", "Sports & Outdoors"]
CHILDREN = [("Smartphones", 1), ("Laptops", 1), ("Audio", 1), ("Men's Clothing", 2),
            ("Women's Clothing", 2), ("Kitchen", 3), ("Furniture", 3), ("Fiction", 4),
            ("Non-Fiction", 4), ("Fitness", 5)]
# SKU, category, price, stock, reorder level
PRODUCTS = [
    ("IPH15PRO-001", 6, "999.99", 50, 10), ("SGS24-001", 6, "899.99", 45, 10),
    ("MBP14-001", 7, "1999.99", 25, 5), ("DXPS13-001", 7, "1299.99", 30, 8),
    ("SXMN5-001", 8, "399.99", 75, 15), ("APPRO-001", 8, "249.99", 100, 20),
    ("BQCFRT-001", 8, "329.99", 60, 12), ("MCT-001", 9, "19.99", 200, 50),
    ("MJ-001", 9, "79.99", 150, 30), ("MDS-001", 9, "49.99", 100, 25),
    ("WB-001", 10, "39.99", 120, 30), ("WD-001", 10, "89.99", 80, 20),
    ("WL-001", 10, "29.99", 180, 40), ("KASM-001", 11, "379.99", 40, 8),
    ("IPD-001", 11, "99.99", 85, 20), ("NB-001", 11, "149.99", 65, 15),
    ("OC-001", 12, "299.99", 55, 12), ("CT-001", 12, "199.99", 35, 8),
    ("BS-001", 12, "159.99", 45, 10), ("TGG-001", 13, "12.99", 150, 30),
    ("TKAM-001", 13, "13.99", 120, 25), ("N1984-001", 13, "14.99", 200, 40),
    ("SAP-001", 14, "16.99", 100, 20), ("AH-001", 14, "18.99", 180, 35),
    ("POM-001", 14, "15.99", 90, 20), ("YM-001", 15, "29.99", 120, 25),
    ("DS-001", 15, "149.99", 60, 12), ("RB-001", 15, "19.99", 200, 40),
    ("RS-001", 15, "129.99", 100, 20), ("WA-001", 15, "24.99", 300, 60),
]
# order, customer, shipping and billing address, method, shipping, discount, items
REQUESTS = [
    ("O1", 1, 1, 1, "Standard", "9.99", "0",
     [("IPH15PRO-001", 1, "999.99"), ("APPRO-001", 1, "249.99")]),
    ("O2", 2, 3, 2, "Express", "15.99", "10",
     [("MCT-001", 3, "19.99"), ("MJ-001", 1, "79.99")]),
    ("O3", 3, 4, 3, "Standard", "12.99", "0",
     [("KASM-001", 1, "379.99"), ("IPD-001", 1, "99.99")]),
    ("O4", 4, 5, 4, "Economy", "5.99", "5",
     [("TGG-001", 2, "12.99"), ("SAP-001", 1, "16.99"), ("AH-001", 1, "18.99")]),
    ("O5", 5, 6, 5, "Standard", "8.99", "15",
     [("YM-001", 2, "29.99"), ("DS-001", 1, "149.99"), ("WB-001", 1, "24.99")]),
    ("H1", 1, 1, 1, "Express", "12.99", "50",
     [("SGS24-001", 1, "899.99"), ("SXMN5-001", 1, "399.99")]),
]
STATUSES = [("O1", "Processing", "Captured"), ("O2", "Shipped", "Captured"),
            ("O3", "Delivered", "Captured"), ("O4", "Processing", "Authorized"),
            ("O5", "Shipped", "Captured"), ("H1", "Delivered", "Captured")]
# ------------------------------------------------------------ end fixed values


def opening_store(spark) -> Store:
    categories = [(i + 1, n, None) for i, n in enumerate(ROOTS)]
    categories += [(i + 6, n, parent) for i, (n, parent) in enumerate(CHILDREN)]
    category = with_category_level(apply_defaults(
        spark.createDataFrame(
            [(i, n, None, p) for i, n, p in categories],
            "CategoryID int, CategoryName string, CategoryDescription string,"
            " ParentCategoryID int"),
        "category", as_of=OLD))
    product = with_low_stock_flag(apply_defaults(
        spark.createDataFrame(
            [(s, f"Product {s}", c, Decimal(p), n, r, s) for s, c, p, n, r in PRODUCTS],
            "ProductID string, ProductName string, CategoryID int, Price decimal(12,4),"
            " StockQuantity int, ReorderLevel int, ProductSKU string"),
        "product", as_of=OLD))
    customer = apply_defaults(
        spark.createDataFrame(
            [(f"C{i:02}", f"Customer {i}", f"c{i}@example.com", f"555-01{i:02}")
             for i in range(1, 11)],
            "CustomerID string, CustomerName string, Email string, PhoneNumber string"),
        "customer", as_of=OLD).withColumn("LastLoginDate", F.lit(None).cast("timestamp_ntz"))
    places = "CustomerID string, AddressLine1 string, City string, StateProvince string," \
             " PostalCode string, IsDefault boolean"
    shipping = apply_defaults(
        spark.createDataFrame(
            [(1, "C01", "1 Main St", "Here", "ST", "12345", True),
             (2, "C01", "1 Work Plaza", "Here", "ST", "12345", False),
             *[(i + 1, f"C{i:02}", f"{i} Main St", "Here", "ST", f"1234{i}", True)
               for i in range(2, 6)]],
            f"ShippingAddressID int, {places}"),
        "shipping_address", as_of=OLD)
    billing = apply_defaults(
        spark.createDataFrame(
            [(i, f"C{i:02}", f"{i} Main St", "Here", "ST", f"1234{i}", True)
             for i in range(1, 6)],
            f"BillingAddressID int, {places}"),
        "billing_address", as_of=OLD)
    second = F.lit(None).cast("string")
    tables = {name: spark.createDataFrame([], model.schema(name)) for name in model.TABLES}
    tables.update(
        category=category, product=product, customer=customer,
        shipping_address=shipping.withColumn("AddressLine2", second),
        billing_address=billing.withColumn("AddressLine2", second))
    return Store(spark, tables)


def request_frame(spark):
    def listed(items):
        return "[" + ",".join(
            f'{{"ProductID":"{p}","Quantity":{q},"UnitPrice":{u}}}' for p, q, u in items) + "]"

    return spark.createDataFrame(
        [(o, f"C{c:02}", AS_OF + timedelta(seconds=i), s, b, m, listed(items),
          Decimal("0.0875"), Decimal(ship), Decimal(off))
         for i, (o, c, s, b, m, ship, off, items) in enumerate(REQUESTS)],
        "OrderID string, CustomerID string, RequestDate timestamp_ntz, ShippingAddressID int,"
        " BillingAddressID int, ShippingMethod string, OrderItems string,"
        " TaxRate decimal(5,4), ShippingAmount decimal(12,4), DiscountAmount decimal(12,4)")


def run_shop(spark) -> tuple[Store, dict]:
    """The shop after its orders, updates, one return, adjustments and edits."""
    start = opening_store(spark)
    made = orders.process_orders(start, request_frame(spark), as_of=AS_OF)
    blank = F.lit(None)
    placed = made["orders"].withColumns({
        "TrackingNumber": blank.cast("string"),
        "ExpectedDeliveryDate": blank.cast("timestamp_ntz"),
        "ActualDeliveryDate": blank.cast("timestamp_ntz"), "Notes": blank.cast("string")})
    updates = spark.createDataFrame(
        [(o, s, p, OLD if o == "H1" else None) for o, s, p in STATUSES],
        "OrderID string, OrderStatus string, PaymentStatus string, OrderDate timestamp_ntz")
    moved = prep.apply_order_updates(placed, updates)
    sold = start.replacing(
        sales_order=moved, order_detail=made["details"], product=made["products"])
    ask = spark.createDataFrame(
        [("R1", AS_OF, "O3", "KASM-001", 1, "Changed mind", Decimal("99.99"), True)],
        "ReturnID string, RequestedAt timestamp_ntz, OrderID string, ProductID string,"
        " ReturnQuantity int, ReturnReason string, RefundAmount decimal(12,4),"
        " RestockProduct boolean")
    back = returns.process_returns(sold, ask, as_of=AS_OF)
    returned = sold.replacing(
        sales_order=back["orders"], product=back["products"], product_return=back["returns"])
    changes = spark.createDataFrame(
        [("A1", AS_OF, "IPH15PRO-001", "Restock", 25, "New shipment", None),
         ("A2", AS_OF, "MCT-001", "Damage", -5, None, None)],
        "AdjustmentID string, AdjustedAt timestamp_ntz, ProductID string,"
        " AdjustmentType string, Quantity int, Notes string, ReferenceID string")
    adjusted = inventory.apply_inventory_adjustments(returned, changes, as_of=AS_OF)
    sku = F.col("ProductSKU")
    edited = adjusted["products"].withColumns({
        "StockQuantity": F.when(sku == "MBP14-001", 3).when(sku == "DXPS13-001", 0)
        .when(sku == "SXMN5-001", 8).otherwise(F.col("StockQuantity")),
        "ReorderLevel": F.when(sku == "MBP14-001", 5).when(sku == "SXMN5-001", 15)
        .otherwise(F.col("ReorderLevel")),
    })
    ledger = made["ledger"].unionByName(back["ledger"]).unionByName(adjusted["ledger"])
    states = [start.scan("product"), made["products"], back["products"], adjusted["products"],
              edited]
    log = audit.order_audit_trail(placed.limit(0), placed, as_of=AS_OF).unionByName(
        audit.order_audit_trail(placed, back["orders"], as_of=AS_OF))
    for old, new in zip(states, states[1:], strict=False):
        log = log.unionByName(audit.product_audit_trail(old, new, as_of=AS_OF))
        log = log.unionByName(audit.stock_alerts(old, new, as_of=AS_OF)["alerts"])
    log = prep.with_hash_key(
        log, "AuditID", "TableName", "Operation", "PrimaryKeyValue", "OldValues", "NewValues")
    # Each step is kept, so the checks below do not run them again.
    kept = {
        "product": edited, "sales_order": back["orders"], "order_detail": made["details"],
        "product_return": back["returns"], "inventory_transaction": ledger, "audit_log": log,
    }
    return start.replacing(**{n: df.checkpoint() for n, df in kept.items()}), {
        **made, "returns": back, "adjusted": adjusted}
