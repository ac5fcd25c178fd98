"""SQL for the queries on table preparation, audit, quality and privacy."""

from __future__ import annotations

from tillwise.checks.oracle import (
    HISTORY,
    NOW,
    RECOMMENDED,
    _performance,
    base,
)

AUDIT_TAIL = f"'tillwise' AS Application, {NOW} AS ChangedDate"

ORDERS_AFTER = """
    , later AS (
      SELECT CASE WHEN OrderID % 50 = 9 THEN -OrderID ELSE OrderID END AS OrderID, CustomerID,
             CASE WHEN OrderID % 10 = 3 THEN 'Shipped' ELSE OrderStatus END AS OrderStatus,
             CAST(CASE WHEN OrderID % 10 = 4 THEN TotalAmount + 10 ELSE TotalAmount END
                  AS DECIMAL(12,4)) AS TotalAmount
      FROM sale
    ), trail AS (
      SELECT 'UPDATE' AS Operation, CAST(a.OrderID AS VARCHAR) AS PrimaryKeyValue,
             'OrderStatus=' || b.OrderStatus || ', TotalAmount=' || b.TotalAmount AS OldValues,
             'OrderStatus=' || a.OrderStatus || ', TotalAmount=' || a.TotalAmount AS NewValues
      FROM sale b JOIN later a ON a.OrderID = b.OrderID
      WHERE a.OrderStatus <> b.OrderStatus OR a.TotalAmount <> b.TotalAmount
      UNION ALL
      SELECT 'INSERT', CAST(OrderID AS VARCHAR), NULL, 'CustomerID=' || CustomerID
             || ', TotalAmount=' || TotalAmount || ', OrderStatus=' || OrderStatus
      FROM later WHERE OrderID NOT IN (SELECT OrderID FROM sale)
      UNION ALL
      SELECT 'DELETE', CAST(OrderID AS VARCHAR), 'CustomerID=' || CustomerID
             || ', TotalAmount=' || TotalAmount || ', OrderStatus=' || OrderStatus, NULL
      FROM sale WHERE OrderID NOT IN (SELECT OrderID FROM later))"""

PRODUCTS_AFTER = """
    , later AS (
      SELECT * REPLACE (
        CAST(CASE WHEN ProductID % 9 = 2 THEN Price + 1 ELSE Price END AS DECIMAL(12,4)) AS Price,
        CASE WHEN ProductID % 3 = 1 THEN StockQuantity - 40 ELSE StockQuantity END
          AS StockQuantity)
      FROM prod)"""

FAULTS = """
    , f_cat AS (
      SELECT * REPLACE (CASE CategoryID WHEN 20 THEN 20 WHEN 21 THEN 77 ELSE ParentCategoryID END
                        AS ParentCategoryID) FROM cat
    ), f_prod AS (
      SELECT * REPLACE (
        CASE WHEN ProductID % 500 = 3 THEN 999 ELSE CategoryID END AS CategoryID,
        CASE WHEN ProductID % 400 = 7 THEN -5 ELSE StockQuantity END AS StockQuantity,
        CASE WHEN ProductID % 700 = 11 THEN 0 ELSE Price END AS Price,
        CASE WHEN ProductID % 900 = 1 THEN 'SKU-SHARED' ELSE ProductSKU END AS ProductSKU)
      FROM prod
    ), f_cust AS (
      SELECT * REPLACE (CASE WHEN CustomerID % 500 = 2 THEN 'shared@example.com' ELSE Email END
                        AS Email) FROM cust
    ), f_sale AS (
      SELECT o.* REPLACE (
        CAST(coalesce(s.v, 0) + CASE WHEN o.OrderID % 50 = 7 THEN 1 ELSE 0 END
             AS DECIMAL(12,4)) AS SubTotal,
        CASE WHEN o.OrderID % 444 = 5 THEN -1 ELSE o.CustomerID END AS CustomerID,
        CASE WHEN o.OrderID % 333 = 4 THEN 'Unknown' ELSE o.OrderStatus END AS OrderStatus,
        CASE WHEN o.OrderID % 300 = 9 THEN o.OrderDate ELSE o.ExpectedDeliveryDate END
          AS ExpectedDeliveryDate,
        CASE WHEN o.OrderID % 600 = 1 THEN NULL ELSE o.PaymentStatus END AS PaymentStatus)
      FROM sale o
      LEFT JOIN (SELECT OrderID AS k, sum(LineTotal) AS v FROM line GROUP BY 1) s
        ON s.k = o.OrderID
    ), f_line AS (
      SELECT * REPLACE (
        CASE WHEN OrderID % 200 = 17 THEN -OrderID ELSE OrderID END AS OrderID,
        CAST(CASE WHEN ProductID % 800 = 5 THEN 99999 ELSE DiscountAmount END AS DECIMAL(12,4))
          AS DiscountAmount)
      FROM line
    ), f_led AS (
      SELECT * REPLACE (CASE WHEN ReferenceID % 97 = 13 THEN NewStock + 1 ELSE NewStock END
                        AS NewStock) FROM led)"""

REPAIRED_ORDERS = """
    , sums AS (SELECT OrderID AS k, sum(LineTotal) AS v FROM f_line GROUP BY 1
    ), fixed AS (
      SELECT o.OrderID, o.SubTotal, o.TotalAmount, o.OrderDate, s.v,
             o.TaxAmount + o.ShippingAmount - o.DiscountAmount AS rest,
             coalesce(abs(o.SubTotal - s.v) > 0.01, false) AS wrong
      FROM f_sale o LEFT JOIN sums s ON s.k = o.OrderID)"""


def _new_addresses(key: str) -> str:
    return f"""
    , fresh AS (
      SELECT AddressID + 10000000000 AS id, CustomerID, CustomerID % 3 = 0 AS IsDefault FROM addr
      UNION ALL
      SELECT AddressID + 20000000000, CustomerID, CustomerID % 4 = 0 FROM addr
    ), everyone AS (
      SELECT AddressID AS id, CustomerID, true AS IsDefault FROM addr
      UNION ALL SELECT * FROM fresh)
    SELECT e.id AS {key}, e.CustomerID, """


def _default_check(key: str) -> str:
    return base("addr") + _new_addresses(key) + """
           e.IsDefault AND NOT EXISTS (
             SELECT 1 FROM fresh f
             WHERE f.CustomerID = e.CustomerID AND f.IsDefault AND f.id <> e.id) AS IsDefault
    FROM everyone e"""


def _violations() -> str:
    rows: list[str] = []

    def add(table: str, name: str, query: str) -> None:
        rows.append(f"SELECT '{table}', '{name}', CAST(({query}) AS BIGINT)")

    def missing(table: str, columns: str, source: str | None, listed: str = "") -> None:
        """Rows without a value; columns the bindings fill with constants have none."""
        for column in columns.split():
            add(table, f"{column}_required",
                f"SELECT count(*) FILTER ({column} IS NULL) FROM {source}"
                if column in listed.split() else "SELECT 0")

    def failing(table: str, name: str, source: str, wrong: str) -> None:
        add(table, name, f"SELECT count(*) FROM {source} WHERE {wrong}")

    def repeated(table: str, name: str, source: str, columns: str) -> None:
        add(table, name, "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n "
            f"FROM {source} GROUP BY {columns} HAVING count(*) > 1)")

    def dangling(table: str, name: str, source: str, column: str, other: str, key: str) -> None:
        add(table, name, f"SELECT count(*) FROM {source} x WHERE {column} IS NOT NULL AND "
            f"NOT EXISTS (SELECT 1 FROM {other} y WHERE y.{key} = x.{column})")

    for table, source, keys in (
            ("category", "f_cat", "CategoryID"), ("product", "f_prod", "ProductID"),
            ("customer", "f_cust", "CustomerID"), ("shipping_address", "addr", "ShippingAddressID"),
            ("billing_address", "addr", "BillingAddressID"), ("sales_order", "f_sale", "OrderID OrderDate"),
            ("order_detail", "f_line", "OrderDetailID"), ("inventory_transaction", "f_led", "TransactionID"),
            ("product_return", "own_ret", "ReturnID")):
        missing(table, keys, source, "" if source == "addr" else keys)
    missing("category", "CategoryName IsActive CreatedDate ModifiedDate", "f_cat", "CategoryName")
    failing("category", "not_own_parent", "f_cat", "CategoryID = ParentCategoryID")
    repeated("category", "primary_key", "f_cat", "CategoryID")
    repeated("category", "category_name", "f_cat", "CategoryName, ParentCategoryID")
    dangling("category", "parent_category", "f_cat", "ParentCategoryID", "f_cat", "CategoryID")

    missing("product", "ProductName CategoryID Price StockQuantity ReorderLevel ProductSKU"
            " IsActive CreatedDate ModifiedDate", "f_prod",
            "ProductName CategoryID Price StockQuantity ReorderLevel ProductSKU IsActive"
            " ModifiedDate")
    failing("product", "price_positive", "f_prod", "Price <= 0")
    failing("product", "stock_not_negative", "f_prod", "StockQuantity < 0")
    failing("product", "reorder_level_not_negative", "f_prod", "ReorderLevel < 0")
    repeated("product", "primary_key", "f_prod", "ProductID")
    repeated("product", "product_sku", "f_prod", "ProductSKU")
    dangling("product", "product_category", "f_prod", "CategoryID", "f_cat", "CategoryID")

    missing("customer", "CustomerName Email IsActive CreatedDate ModifiedDate", "f_cust",
            "CustomerName Email IsActive CreatedDate")
    repeated("customer", "primary_key", "f_cust", "CustomerID")
    repeated("customer", "customer_email", "f_cust", "Email")

    places = "CustomerID AddressLine1 City StateProvince PostalCode Country"
    flags = "IsDefault IsActive CreatedDate"
    told = "CustomerID AddressLine1 City StateProvince PostalCode IsActive"
    missing("shipping_address", f"{places} AddressType {flags}", "addr", told)
    failing("shipping_address", "address_type_known", "addr", "CustomerID % 250 = 6")
    repeated("shipping_address", "primary_key", "addr", "AddressID")
    dangling("shipping_address", "address_customer", "addr", "CustomerID", "f_cust", "CustomerID")
    missing("billing_address", f"{places} {flags}", "addr", told)
    repeated("billing_address", "primary_key", "addr", "AddressID")
    dangling("billing_address", "address_customer", "addr", "CustomerID", "f_cust", "CustomerID")

    money = "SubTotal TaxAmount ShippingAmount DiscountAmount TotalAmount"
    missing("sales_order", f"CustomerID OrderStatus {money} PaymentStatus CreatedDate"
            " ModifiedDate", "f_sale", f"CustomerID OrderStatus {money} PaymentStatus")
    failing("sales_order", "order_status_known", "f_sale",
            "OrderStatus NOT IN ('Pending', 'Processing', 'Shipped', 'Delivered', 'Cancelled',"
            " 'Returned')")
    failing("sales_order", "payment_status_known", "f_sale",
            "PaymentStatus NOT IN ('Pending', 'Authorized', 'Captured', 'Failed', 'Refunded')")
    failing("sales_order", "amounts_not_negative", "f_sale",
            "SubTotal < 0 OR TaxAmount < 0 OR ShippingAmount < 0 OR DiscountAmount < 0"
            " OR TotalAmount < 0")
    failing("sales_order", "expected_after_order", "f_sale", "ExpectedDeliveryDate <= OrderDate")
    failing("sales_order", "delivered_not_before_order", "f_sale",
            "ActualDeliveryDate < OrderDate")
    repeated("sales_order", "primary_key", "f_sale", "OrderID, OrderDate")
    dangling("sales_order", "order_customer", "f_sale", "CustomerID", "f_cust", "CustomerID")
    dangling("sales_order", "order_shipping_address", "f_sale", "ShippingAddressID", "addr",
             "AddressID")
    dangling("sales_order", "order_billing_address", "f_sale", "BillingAddressID", "addr",
             "AddressID")

    missing("order_detail", "OrderID ProductID Quantity UnitPrice DiscountAmount CreatedDate",
            "f_line", "OrderID ProductID Quantity UnitPrice DiscountAmount CreatedDate")
    failing("order_detail", "quantity_positive", "f_line", "Quantity <= 0")
    failing("order_detail", "unit_price_positive", "f_line", "UnitPrice <= 0")
    failing("order_detail", "discount_within_line", "f_line",
            "DiscountAmount < 0 OR DiscountAmount > Quantity * UnitPrice")
    repeated("order_detail", "primary_key", "f_line", "OrderDetailID")
    dangling("order_detail", "detail_product", "f_line", "ProductID", "f_prod", "ProductID")

    missing("inventory_transaction", "ProductID TransactionType Quantity PreviousStock NewStock"
            " TransactionDate UserId", "f_led",
            "ProductID TransactionType Quantity PreviousStock NewStock TransactionDate")
    failing("inventory_transaction", "transaction_type_known", "f_led",
            "TransactionType NOT IN ('Sale', 'Return', 'Adjustment', 'Restock', 'Damage',"
            " 'Transfer')")
    repeated("inventory_transaction", "primary_key", "f_led", "TransactionID")
    dangling("inventory_transaction", "transaction_product", "f_led", "ProductID", "f_prod",
             "ProductID")

    missing("product_return", "OrderID OrderDate ProductID CustomerID ReturnQuantity RefundAmount"
            " ReturnStatus RestockProduct CreatedDate CreatedBy", "own_ret",
            "OrderID OrderDate ProductID CustomerID ReturnQuantity RefundAmount ReturnStatus")
    failing("product_return", "return_quantity_positive", "own_ret", "ReturnQuantity <= 0")
    failing("product_return", "refund_not_negative", "own_ret", "RefundAmount < 0")
    failing("product_return", "return_status_known", "own_ret",
            "ReturnStatus NOT IN ('Pending', 'Approved', 'Rejected', 'Processed')")
    repeated("product_return", "primary_key", "own_ret", "ReturnID")
    add("product_return", "return_order",
        "SELECT count(*) FROM own_ret x WHERE OrderDate IS NOT NULL AND NOT EXISTS (SELECT 1"
        " FROM f_sale y WHERE y.OrderID = x.OrderID AND y.OrderDate = x.OrderDate)")
    dangling("product_return", "return_product", "own_ret", "ProductID", "f_prod", "ProductID")
    dangling("product_return", "return_customer", "own_ret", "CustomerID", "f_cust",
             "CustomerID")
    return base("cat", "prod", "cust", "addr", "sale", "ret", "led") + FAULTS + """
    , own_ret AS (
      SELECT r.*, o.OrderDate, o.CustomerID
      FROM ret r LEFT JOIN sale o ON o.OrderID = r.OrderID
    ), v(TableName, ConstraintName, ViolatingRows) AS (
    """ + "\n    UNION ALL ".join(rows) + ") SELECT * FROM v"


def statements() -> dict[str, str]:
    counted = {
        "Categories": "cat", "Products": "prod", "Customers": "cust", "Orders": "sale",
        "Order Details": "line", "Inventory Transactions": "led", "Product Returns": "ret",
        "Shipping Addresses": "addr", "Billing Addresses": "addr", "Audit Log Entries": "trail",
    }
    bucket = "1 + " + " + ".join(
        f"CAST(OrderDate >= TIMESTAMP '{day}' AS INT)"
        for day in ("1996-01-01", "1997-01-01", "1998-07-01", "2000-01-01", "2001-01-01"))
    wide = ("cat", "prod", "sale", "line", "ret")
    faulty = ("cat", "prod", "cust", "sale", "led")
    checks = [
        ("Critical", "OrderDetail", "Order details without corresponding orders",
         "SELECT count(*) FROM f_line WHERE OrderID NOT IN (SELECT OrderID FROM f_sale)"),
        ("Warning", "Order", "Orders without order details",
         "SELECT count(*) FROM f_sale WHERE OrderStatus <> 'Cancelled'"
         " AND OrderID NOT IN (SELECT OrderID FROM f_line)"),
        ("Critical", "Product", "Products with negative inventory",
         "SELECT count(*) FROM f_prod WHERE StockQuantity < 0"),
        ("Critical", "Product", "Products without valid categories",
         "SELECT count(*) FROM f_prod WHERE CategoryID NOT IN (SELECT CategoryID FROM f_cat)"),
        ("Warning", "Order", "Orders with incorrect total calculations",
         "SELECT count(*) FROM f_sale o JOIN (SELECT OrderID AS k, sum(LineTotal) AS v"
         " FROM f_line GROUP BY 1) ON k = o.OrderID WHERE abs(o.SubTotal - v) > 0.01"),
        ("Info", "Customer", "Active customers without shipping addresses",
         "SELECT count(*) FROM f_cust WHERE IsActive"
         " AND CustomerID NOT IN (SELECT CustomerID FROM addr WHERE IsActive)"),
        ("Warning", "InventoryTransaction", "Inventory transactions with calculation errors",
         "SELECT count(*) FROM f_led WHERE PreviousStock + Quantity <> NewStock"),
    ]
    listed = " UNION ALL ".join(
        f"SELECT '{a}', '{b}', '{c}', ({q}), 'No'" for a, b, c, q in checks)
    made = {
        "table_counts": base(*PARTS_FOR_COUNTS) + ORDERS_AFTER + " SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{label}' AS DataType, count(*) AS RecordCount FROM {part}"
            for label, part in counted.items()) + ")",
        "orders_by_status": base("sale") + """
    SELECT OrderStatus, count(*) AS OrderCount, CAST(sum(TotalAmount) AS DOUBLE) AS TotalValue
    FROM sale GROUP BY 1""",
        "products_by_category": base("cat", "prod") + """
    SELECT c.CategoryName, count(p.ProductID) AS ProductCount,
           CAST(sum(p.Price) AS DOUBLE) / nullif(count(p.Price), 0) AS AvgPrice,
           CAST(sum(p.StockQuantity) AS BIGINT) AS TotalStock
    FROM cat c LEFT JOIN prod p ON p.CategoryID = c.CategoryID
    WHERE c.ParentCategoryID IS NOT NULL GROUP BY 1""",
        "low_stock_list": base("prod") + """
    SELECT ProductName, ProductSKU, StockQuantity, ReorderLevel,
           CASE WHEN StockQuantity = 0 THEN 'OUT OF STOCK' ELSE 'LOW STOCK' END AS Status
    FROM prod WHERE StockQuantity <= ReorderLevel""",
        "update_last_login": base("cust") + f"""
    SELECT CustomerID, CustomerName,
           CASE WHEN r <= 3 THEN {NOW} - INTERVAL 1 DAY WHEN r <= 6 THEN {NOW} - INTERVAL 7 DAY
                WHEN r <= 8 THEN {NOW} - INTERVAL 30 DAY ELSE LastLoginDate END AS LastLoginDate
    FROM (SELECT *, row_number() OVER (ORDER BY CreatedDate, CustomerID) AS r FROM cust)""",
        "apply_order_updates": base("sale") + """
    SELECT OrderID,
           CASE OrderID % 3 WHEN 0 THEN 'Shipped' WHEN 1 THEN 'Delivered' ELSE OrderStatus END
             AS OrderStatus,
           CASE WHEN OrderID % 2 = 0 THEN 'Captured' ELSE PaymentStatus END AS PaymentStatus,
           CASE WHEN OrderID % 5 = 0 THEN 'UPD' || OrderID ELSE TrackingNumber END
             AS TrackingNumber,
           CASE WHEN OrderID % 3 = 1 THEN OrderDate + INTERVAL 3 DAY ELSE ActualDeliveryDate END
             AS ActualDeliveryDate
    FROM sale""",
        "history_by_customer_name": base("cat", "prod", "cust", "addr", "sale", "line") + HISTORY
        + " SELECT * FROM hist WHERE CustomerName = 'Customer#000000007'",
        "products_with_status": base(*wide) + _performance("LEFT JOIN")
        + " SELECT * FROM perf WHERE StockStatus = 'Low Stock'",
        "recommendations_by_customer_name": base("cust", *wide) + _performance("LEFT JOIN")
        + RECOMMENDED + """ SELECT * FROM recs WHERE CustomerID IN
        (SELECT CustomerID FROM cust WHERE CustomerName = 'Customer#000000007')""",
        "computed_columns_category": base("cat") + """
    SELECT CategoryID, ParentCategoryID,
           CAST(ParentCategoryID IS NOT NULL AS INT) AS CategoryLevel FROM cat""",
        "computed_columns_product": base("prod") + """
    SELECT ProductID, StockQuantity, ReorderLevel,
           CAST(StockQuantity <= ReorderLevel AS INT) AS IsLowStock FROM prod""",
        "computed_columns_order_detail": base("line") + """
    SELECT OrderDetailID, Quantity, CAST(UnitPrice AS DOUBLE) AS UnitPrice,
           CAST(DiscountAmount AS DOUBLE) AS DiscountAmount,
           CAST(Quantity * UnitPrice - DiscountAmount AS DOUBLE) AS LineTotal FROM line""",
        "computed_columns_customer": base("cust") + """
    SELECT CustomerID, Email, sha256(lower(trim(Email))) AS EmailHash FROM cust""",
        "partitioned_orders": base("sale") + f"""
    SELECT {bucket} AS OrderRange, count(*) AS Orders,
           CAST(sum(TotalAmount) AS DOUBLE) AS Total, min(OrderDate) AS FirstDate,
           max(OrderDate) AS LastDate
    FROM sale GROUP BY 1""",
        "partitioned_orders_pruned": base("sale") + """
    SELECT OrderID, OrderDate, CAST(TotalAmount AS DOUBLE) AS TotalAmount FROM sale
    WHERE OrderDate >= TIMESTAMP '1997-01-01' AND OrderDate < TIMESTAMP '1998-07-01'""",
        "apply_defaults": base("sale") + f"""
    SELECT OrderID, CustomerID,
           nullif(PaymentStatus, 'Failed') AS PaymentStatus,
           {NOW} AS OrderDate, 'Pending' AS OrderStatus, CAST(0 AS DOUBLE) AS SubTotal,
           CAST(0 AS DOUBLE) AS TaxAmount, CAST(0 AS DOUBLE) AS ShippingAmount,
           CAST(0 AS DOUBLE) AS DiscountAmount, CAST(0 AS DOUBLE) AS TotalAmount,
           {NOW} AS CreatedDate, {NOW} AS ModifiedDate,
           sha256('["' || OrderID || '","' || CustomerID || '"]') AS RowKey
    FROM sale""",
        "apply_defaults_filled": base("sale") + f"""
    SELECT OrderID, CustomerID,
           CASE PaymentStatus WHEN 'Failed' THEN 'Pending' ELSE PaymentStatus END AS PaymentStatus,
           {NOW} AS OrderDate, 'Pending' AS OrderStatus, CAST(0 AS DOUBLE) AS SubTotal,
           CAST(0 AS DOUBLE) AS TaxAmount, CAST(0 AS DOUBLE) AS ShippingAmount,
           CAST(0 AS DOUBLE) AS DiscountAmount, CAST(0 AS DOUBLE) AS TotalAmount,
           {NOW} AS CreatedDate, {NOW} AS ModifiedDate,
           sha256('["' || OrderID || '","' || CustomerID || '"]') AS RowKey
    FROM sale""",
        "sequence_keys": base("sale") + """
    SELECT OrderID, OrderDate,
           row_number() OVER (ORDER BY OrderDate, OrderID) + 1000 AS SequenceID FROM sale""",
        "order_audit_trail": base("sale") + ORDERS_AFTER + f"""
    SELECT 'Order' AS TableName, *, 'loader' AS ChangedBy, {AUDIT_TAIL} FROM trail""",
        "product_audit_trail": base("prod") + PRODUCTS_AFTER + f"""
    SELECT 'Product' AS TableName, 'UPDATE' AS Operation,
           CAST(a.ProductID AS VARCHAR) AS PrimaryKeyValue,
           'Price=' || b.Price || ', Stock=' || b.StockQuantity AS OldValues,
           'Price=' || a.Price || ', Stock=' || a.StockQuantity AS NewValues,
           'loader' AS ChangedBy, {AUDIT_TAIL}
    FROM prod b JOIN later a ON a.ProductID = b.ProductID
    WHERE a.Price <> b.Price OR a.StockQuantity <> b.StockQuantity""",
        "stock_alerts": base("prod") + PRODUCTS_AFTER + f"""
    SELECT 'Product' AS TableName, 'STOCK_ALERT' AS Operation,
           CAST(a.ProductID AS VARCHAR) AS PrimaryKeyValue,
           'Stock: ' || b.StockQuantity AS OldValues,
           'Stock: ' || a.StockQuantity || ' (Below Reorder Level: ' || a.ReorderLevel || ')'
             AS NewValues,
           'loader' AS ChangedBy, {AUDIT_TAIL}
    FROM prod b JOIN later a ON a.ProductID = b.ProductID
    WHERE a.StockQuantity BETWEEN 0 AND a.ReorderLevel AND b.StockQuantity > b.ReorderLevel""",
        "stock_alerts_products": base("prod") + PRODUCTS_AFTER + f"""
    SELECT b.ProductID,
           CASE WHEN a.StockQuantity < 0 THEN b.StockQuantity ELSE a.StockQuantity END
             AS StockQuantity,
           CAST(CASE WHEN a.StockQuantity < 0 THEN b.Price ELSE a.Price END AS DOUBLE) AS Price,
           CASE WHEN a.StockQuantity >= 0 AND a.StockQuantity <> b.StockQuantity THEN {NOW}
                ELSE b.ModifiedDate END AS ModifiedDate
    FROM prod b JOIN later a ON a.ProductID = b.ProductID""",
        "stock_alerts_rejects": base("prod") + PRODUCTS_AFTER + """
    SELECT ProductID, StockQuantity, 'Stock quantity cannot be negative.' AS ErrorMessage
    FROM later WHERE StockQuantity < 0""",
        "validate_inventory_ledger": base(*faulty) + FAULTS + """
    , closing AS (
      SELECT ProductID AS k, NewStock AS stock FROM f_led
      QUALIFY row_number() OVER (PARTITION BY ProductID
                                 ORDER BY TransactionDate DESC, TransactionID DESC) = 1)
    SELECT TransactionID, ProductID, 'stock_differs' AS Rule
    FROM f_led JOIN closing ON k = ProductID WHERE NewStock <> stock
    UNION ALL
    SELECT TransactionID, ProductID, 'sum_differs' FROM f_led
    WHERE NewStock - Quantity <> PreviousStock""",
        "recompute_order_totals": base("sale", "line") + f"""
    , sums AS (
      SELECT OrderID AS k,
             sum((Quantity + ProductID % 2) * UnitPrice - DiscountAmount) AS v
      FROM line GROUP BY 1
    ), t AS (
      SELECT o.*, CAST(v AS DECIMAL(12,4)) AS s, OrderID % 13 = 0 OR TaxAmount = 0 AS untaxed
      FROM sale o JOIN sums ON k = OrderID)
    SELECT OrderID, CAST(s AS DOUBLE) AS SubTotal,
           CAST(CASE WHEN untaxed THEN CAST(s * 0.0875 AS DECIMAL(12,4)) ELSE TaxAmount END
                AS DOUBLE) AS TaxAmount,
           CAST(ShippingAmount AS DOUBLE) AS ShippingAmount,
           CAST(DiscountAmount AS DOUBLE) AS DiscountAmount,
           CAST(CAST(CASE WHEN untaxed THEN s + s * 0.0875 + ShippingAmount - DiscountAmount
                          ELSE s + TaxAmount + ShippingAmount - DiscountAmount END
                     AS DECIMAL(12,4)) AS DOUBLE) AS TotalAmount,
           {NOW} AS ModifiedDate
    FROM t""",
        "enforce_default_address_shipping": _default_check("ShippingAddressID"),
        "enforce_default_address_billing": _default_check("BillingAddressID"),
        "enforce_default_address_corrected": base("addr") + _new_addresses("ShippingAddressID")
        + """
           e.IsDefault AND e.id = coalesce(
             (SELECT max(f.id) FROM fresh f WHERE f.CustomerID = e.CustomerID AND f.IsDefault),
             e.id) AS IsDefault
    FROM everyone e""",
        "protect_customer_pii": base("cust") + """
    SELECT CustomerID, Email, PhoneNumber, sha256(lower(trim(Email))) AS EmailHash FROM cust""",
        "upsert_customers": base("cust") + f"""
    , told AS (
      SELECT CustomerID, CustomerName || ' II' AS CustomerName,
             CASE WHEN CustomerID % 2 = 0 THEN '  ' || upper(Email) ELSE Email END AS Email,
             CASE WHEN CustomerID % 5 = 0 THEN '555-9999' ELSE PhoneNumber END AS PhoneNumber,
             CASE WHEN CustomerID % 6 = 0 THEN false ELSE IsActive END AS IsActive
      FROM cust
      UNION ALL
      SELECT -CustomerID - 1, CustomerName, 'new.' || Email, PhoneNumber, true FROM cust)
    SELECT *, sha256(lower(trim(Email))) AS EmailHash, {NOW} AS ModifiedDate FROM told""",
        "check_data_integrity": base(*faulty, "addr") + FAULTS + f"""
    , c(Severity, TableName, IssueDescription, RecordCount, FixApplied) AS ({listed})
    SELECT * FROM c WHERE RecordCount > 0""",
        "fix_data_integrity_orders": base(*faulty) + FAULTS + REPAIRED_ORDERS + f"""
    SELECT OrderID, CAST(CASE WHEN wrong THEN v ELSE SubTotal END AS DOUBLE) AS SubTotal,
           CAST(CASE WHEN wrong THEN v + rest ELSE TotalAmount END AS DOUBLE) AS TotalAmount,
           CASE WHEN wrong THEN {NOW} ELSE OrderDate END AS ModifiedDate
    FROM fixed""",
        "fix_data_integrity_products": base(*faulty) + FAULTS + f"""
    SELECT ProductID, greatest(StockQuantity, 0) AS StockQuantity,
           CASE WHEN StockQuantity < 0 THEN {NOW} ELSE ModifiedDate END AS ModifiedDate
    FROM f_prod""",
        "fix_data_integrity_audit": base(*faulty) + FAULTS + f"""
    SELECT 'Product' AS TableName, 'FIX' AS Operation,
           CAST(ProductID AS VARCHAR) AS PrimaryKeyValue,
           'NegativeStock=' || StockQuantity AS OldValues, 'CorrectedStock=0' AS NewValues,
           'INTEGRITY_CHECK' AS ChangedBy, {AUDIT_TAIL}
    FROM f_prod WHERE StockQuantity < 0""",
        "constraint_violations": _violations(),
        "stream_sales_metrics": base("sale") + """
    SELECT date_trunc('day', OrderDate) AS Day, OrderStatus, count(*) AS Orders,
           CAST(sum(TotalAmount) AS DOUBLE) AS Revenue
    FROM sale GROUP BY ALL""",
        "stream_stock_ledger": base("prod", "line") + """
    SELECT p.ProductID, CAST(p.StockQuantity * 10 - coalesce(sum(l.Quantity), 0) AS BIGINT)
             AS StockQuantity, p.ReorderLevel
    FROM prod p LEFT JOIN line l ON l.ProductID = p.ProductID
    GROUP BY p.ProductID, p.StockQuantity, p.ReorderLevel""",
        "stream_stock_alerts": base("prod", "line") + f"""
    , moved AS (
      SELECT p.ProductID, p.StockQuantity * 10 AS old, p.ReorderLevel,
             p.StockQuantity * 10 - (SELECT sum(Quantity) FROM line l
                                     WHERE l.ProductID = p.ProductID) AS new
      FROM prod p)
    SELECT 'Product' AS TableName, 'STOCK_ALERT' AS Operation,
           CAST(ProductID AS VARCHAR) AS PrimaryKeyValue, 'Stock: ' || old AS OldValues,
           'Stock: ' || new || ' (Below Reorder Level: ' || ReorderLevel || ')' AS NewValues,
           'loader' AS ChangedBy, {AUDIT_TAIL}
    FROM moved WHERE old > ReorderLevel AND new <= ReorderLevel""",
        "stream_stock_movements": base("prod", "line") + """
    SELECT p.ProductID, CAST(p.StockQuantity * 10 AS BIGINT) AS FirstStock,
           -CAST(sum(l.Quantity) AS BIGINT) AS Quantity,
           CAST(p.StockQuantity * 10 - sum(l.Quantity) AS BIGINT) AS LastStock
    FROM prod p JOIN line l ON l.ProductID = p.ProductID GROUP BY p.ProductID, p.StockQuantity""",
        "stream_stock_rejects": base("line") + """
    SELECT ProductID, 'Product not found or inactive.' AS ErrorMessage,
           -CAST(sum(Quantity) AS BIGINT) AS Quantity, CAST(0 AS BIGINT) AS FirstBefore
    FROM line WHERE ProductID % 20 = 0 GROUP BY ProductID""",
        "stream_order_audit": base("sale") + ORDERS_AFTER + f"""
    , returned AS (
      SELECT CAST(OrderID AS VARCHAR) AS k, 'OrderStatus=' || OrderStatus || ', TotalAmount='
               || TotalAmount AS own, 'OrderStatus=Returned, TotalAmount=' || TotalAmount AS other
      FROM sale WHERE OrderID % 10 = 6 AND OrderStatus <> 'Returned')
    SELECT 'Order' AS TableName, *, 'loader' AS ChangedBy, {AUDIT_TAIL} FROM (
      SELECT * FROM trail
      UNION ALL SELECT 'UPDATE', k, own, other FROM returned
      UNION ALL SELECT 'UPDATE', k, other, own FROM returned)""",
    }
    # The stored table is to be as the whole one rewritten.
    made["apply_order_updates_merged"] = made["apply_order_updates"]
    return made


PARTS_FOR_COUNTS = ("cat", "prod", "cust", "addr", "sale", "ret", "led")
