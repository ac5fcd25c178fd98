"""Independent SQL for DuckDB, one statement per registered query.

Each statement starts from the driver's tables: ``base`` holds the bindings of
those tables to the retail model, as common table expressions.
"""

from __future__ import annotations

CATEGORY = """
cat AS (
  SELECT CAST(i AS INT) AS CategoryID, 'Dept ' || i AS CategoryName,
         'Department ' || i AS CategoryDescription, CAST(NULL AS INT) AS ParentCategoryID
  FROM range(1, 6) t(i)
  UNION ALL
  SELECT CAST(n + 5 AS INT), 'Brand#' || n, 'Range ' || n, CAST((n - 1) % 5 + 1 AS INT)
  FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS n FROM part)
  UNION ALL
  SELECT 1000, 'Clearance', 'Nothing on sale yet', 5
)"""

# The categories nested as in feeds.nested_categories, and every way up from each.
NESTED = """
    , nested AS (
      SELECT CategoryID, CategoryName, CASE
             WHEN CategoryID IN (59, 60) THEN 119 - CategoryID WHEN CategoryID = 1000 THEN 60
             WHEN CategoryID > 25 THEN CategoryID - 10 WHEN CategoryID > 5 THEN CategoryID - 15 END AS up
      FROM cat),
    walk AS (
      SELECT CategoryID, CategoryID AS top, [CategoryID] AS path, false AS own, false AS repeated FROM nested
      UNION ALL
      SELECT w.CategoryID, p.CategoryID, list_append(w.path, p.CategoryID), p.CategoryID = w.CategoryID,
             list_contains(w.path, p.CategoryID)
      FROM walk w JOIN nested n ON n.CategoryID = w.top JOIN nested p ON p.CategoryID = n.up WHERE NOT w.repeated)
"""

PRODUCT = """
prod AS (
  SELECT p_partkey AS ProductID, p_name AS ProductName,
         CAST(substr(p_brand, 7) AS INT) + 5 AS CategoryID,
         CAST(p_retailprice AS DECIMAL(12,4)) AS Price,
         CAST((p_partkey * 7) % 120 AS INT) AS StockQuantity,
         CAST(p_size AS INT) AS ReorderLevel,
         'SKU-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS ProductSKU,
         p_partkey % 25 <> 0 AS IsActive,
         TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 2000 AS INT)) AS ModifiedDate
  FROM part
)"""

CUSTOMER = """
cust AS (
  SELECT c_custkey AS CustomerID, c_name AS CustomerName,
         replace(lower(c_name), '#', '.') || '@example.com' AS Email,
         CASE WHEN c_custkey % 7 = 0 THEN NULL
              ELSE '555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS PhoneNumber,
         c_custkey % 20 <> 0 AS IsActive,
         TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 1000 AS INT)) AS CreatedDate,
         CASE WHEN c_custkey % 3 = 0 THEN NULL
              ELSE TIMESTAMP '2001-08-01 12:00:00' - to_days(CAST(c_custkey % 60 AS INT))
         END AS LastLoginDate
  FROM customer
)"""

ADDRESS = """
addr AS (
  SELECT c_custkey AS AddressID, c_custkey AS CustomerID,
         c_custkey || ' Market St' AS AddressLine1,
         CASE WHEN c_custkey % 2 = 0 THEN 'Unit ' || (c_custkey % 50) END AS AddressLine2,
         n_name AS City, r_name AS StateProvince,
         lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS PostalCode,
         c_custkey % 30 <> 1 AS IsActive
  FROM customer
  JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey
)"""

ORDER = """
sale0 AS (
  SELECT o_orderkey AS OrderID, o_orderdate AS OrderDate,
         o_custkey - CASE WHEN o_custkey % 40 = 39 THEN 1 ELSE 0 END AS CustomerID,
         CASE WHEN o_orderkey % 20 = 0 THEN 'Cancelled'
              WHEN o_orderstatus = 'F' THEN
                   CASE WHEN o_orderkey % 20 = 1 THEN 'Returned' ELSE 'Delivered' END
              WHEN o_orderstatus = 'P' THEN 'Processing'
              WHEN o_orderkey % 2 = 0 THEN 'Pending' ELSE 'Shipped' END AS OrderStatus,
         CAST(CAST(CAST(CAST(o_totalprice AS DECIMAL(16,2)) * 100 AS BIGINT)
                   // CASE WHEN o_custkey % 25 = 0 THEN 100 ELSE 1000 END AS DECIMAL(10,0))
              * 0.01 AS DECIMAL(12,4)) AS SubTotal
  FROM orders
), sale AS (
  SELECT *, CAST(SubTotal + TaxAmount + ShippingAmount - DiscountAmount AS DECIMAL(12,4))
            AS TotalAmount
  FROM (
    SELECT *, CAST(SubTotal * 0.0875 AS DECIMAL(12,4)) AS TaxAmount,
           CAST(5.99 AS DECIMAL(12,4)) AS ShippingAmount,
           CAST(CASE WHEN OrderID % 3 > SubTotal THEN 0 ELSE OrderID % 3 END AS DECIMAL(12,4))
             AS DiscountAmount,
           CASE OrderID % 4 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Authorized'
                            WHEN 2 THEN 'Captured' ELSE 'Failed' END AS PaymentStatus,
           CASE OrderID % 5 WHEN 0 THEN 'Standard' WHEN 1 THEN 'Express'
                            WHEN 2 THEN 'Overnight' WHEN 3 THEN 'Economy' END AS ShippingMethod,
           CASE WHEN CustomerID % 10 = 0 THEN NULL ELSE CustomerID END AS ShippingAddressID,
           CASE WHEN CustomerID % 10 = 5 THEN NULL ELSE CustomerID END AS BillingAddressID,
           CASE WHEN OrderStatus IN ('Shipped', 'Delivered', 'Returned')
                THEN 'TRK' || lpad(CAST(OrderID AS VARCHAR), 10, '0') END AS TrackingNumber,
           OrderDate + INTERVAL 5 DAY AS ExpectedDeliveryDate,
           CASE WHEN OrderStatus IN ('Delivered', 'Returned')
                THEN OrderDate + to_days(CAST(OrderID % 9 AS INT)) END AS ActualDeliveryDate
    FROM sale0)
)"""

LINE = """
line AS (
  SELECT *, CAST(Quantity * UnitPrice - DiscountAmount AS DECIMAL(18,4)) AS LineTotal
  FROM (
    SELECT *, CAST(Quantity * UnitPrice * Rate AS DECIMAL(12,4)) AS DiscountAmount
    FROM (
      SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                       date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)),
                       CAST(CAST(l_extendedprice AS DECIMAL(16,2)) * 100 AS BIGINT))
               AS OrderDetailID,
             l_orderkey AS OrderID, l_partkey AS ProductID,
             CAST(l_quantity AS INT) AS Quantity,
             CAST(CAST(greatest(CAST(CAST(l_extendedprice AS DECIMAL(16,2)) * 100 AS BIGINT)
                                // (CAST(l_quantity AS BIGINT) * 1000), 1) AS DECIMAL(10,0))
                  * 0.01 AS DECIMAL(12,4)) AS UnitPrice,
             CAST(l_discount AS DECIMAL(4,2)) AS Rate,
             l_shipdate AS CreatedDate, l_returnflag, l_linestatus
      FROM lineitem))
)"""

RETURN = """
ret AS (
  SELECT 'R-' || OrderDetailID AS ReturnID, OrderID, ProductID,
         CAST(1 + Quantity // 10 AS INT) AS ReturnQuantity,
         CAST((1 + Quantity // 10) * UnitPrice AS DECIMAL(12,4)) AS RefundAmount,
         CASE l_linestatus WHEN 'F' THEN 'Processed' ELSE 'Approved' END AS ReturnStatus
  FROM line WHERE l_returnflag = 'R'
)"""

LEDGER = """
led0 AS (
  SELECT OrderDetailID, OrderID, ProductID, Quantity, CreatedDate,
         row_number() OVER w AS nth, sum(Quantity) OVER w AS gone
  FROM line
  WINDOW w AS (PARTITION BY ProductID ORDER BY CreatedDate, OrderDetailID
               ROWS UNBOUNDED PRECEDING)
), led AS (
  SELECT 'Sale-' || OrderDetailID AS TransactionID, ProductID, 'Sale' AS TransactionType,
         -Quantity AS Quantity,
         CAST(10000 - gone + Quantity + 255 * ((nth - 1) // 10) AS BIGINT) AS PreviousStock,
         CAST(10000 - gone + 255 * ((nth - 1) // 10) AS BIGINT) AS NewStock,
         CreatedDate AS TransactionDate, OrderID AS ReferenceID
  FROM led0
  UNION ALL
  SELECT 'Restock-' || OrderDetailID, ProductID, 'Restock', 255,
         CAST(10000 - gone + 255 * (nth // 10 - 1) AS BIGINT),
         CAST(10000 - gone + 255 * (nth // 10) AS BIGINT),
         CreatedDate + INTERVAL 1 HOUR, OrderID
  FROM led0 WHERE nth % 10 = 0
)"""

PARTS = {
    "cat": CATEGORY, "prod": PRODUCT, "cust": CUSTOMER, "addr": ADDRESS, "sale": ORDER,
    "line": LINE, "ret": RETURN, "led": LEDGER,
}
NEEDS = {"ret": ["line"], "led": ["line"]}
NOW = "TIMESTAMP '2001-08-01 12:00:00'"
START = "TIMESTAMP '1995-01-01'"


def base(*names: str) -> str:
    wanted: list[str] = []
    for name in names:
        for part in [*NEEDS.get(name, []), name]:
            if part not in wanted:
                wanted.append(part)
    return "WITH " + ",".join(PARTS[p].strip() for p in wanted)


def _reports() -> dict[str, str]:
    sold = f"""
      FROM line l JOIN sale o ON o.OrderID = l.OrderID
      JOIN prod p ON p.ProductID = l.ProductID
      JOIN cat c ON c.CategoryID = p.CategoryID
      WHERE o.OrderDate BETWEEN {START} AND {NOW} AND o.OrderStatus <> 'Cancelled'"""

    def summary(start: str) -> str:
        return base("sale", "line") + f"""
    SELECT 'Sales Summary' AS ReportType, {start} AS StartDate, {NOW} AS EndDate,
           count(DISTINCT o.OrderID) AS TotalOrders,
           count(DISTINCT o.CustomerID) AS UniqueCustomers,
           CAST(sum(o.TotalAmount) AS DOUBLE) AS TotalRevenue,
           CAST(sum(o.SubTotal) AS DOUBLE) AS TotalSubTotal,
           CAST(sum(o.TaxAmount) AS DOUBLE) AS TotalTax,
           CAST(sum(o.ShippingAmount) AS DOUBLE) AS TotalShipping,
           CAST(sum(o.DiscountAmount) AS DOUBLE) AS TotalDiscounts,
           CAST(sum(o.TotalAmount) AS DOUBLE) / count(*) AS AverageOrderValue,
           CAST(sum(l.Quantity) AS BIGINT) AS TotalItemsSold
    FROM sale o JOIN line l ON l.OrderID = o.OrderID
    WHERE o.OrderDate BETWEEN {start} AND {NOW} AND o.OrderStatus <> 'Cancelled'"""

    return {
        "sales_report_summary": summary(START),
        "sales_report_summary_last_30_days": summary("TIMESTAMP '2001-07-02 12:00:00'"),
        "sales_report_summary_corrected": base("sale", "line") + f"""
    SELECT 'Sales Summary' AS ReportType, {START} AS StartDate, {NOW} AS EndDate,
           count(*) AS TotalOrders, count(DISTINCT CustomerID) AS UniqueCustomers,
           CAST(sum(TotalAmount) AS DOUBLE) AS TotalRevenue,
           CAST(sum(SubTotal) AS DOUBLE) AS TotalSubTotal,
           CAST(sum(TaxAmount) AS DOUBLE) AS TotalTax,
           CAST(sum(ShippingAmount) AS DOUBLE) AS TotalShipping,
           CAST(sum(DiscountAmount) AS DOUBLE) AS TotalDiscounts,
           CAST(sum(TotalAmount) AS DOUBLE) / count(*) AS AverageOrderValue,
           CAST(sum((SELECT sum(Quantity) FROM line l WHERE l.OrderID = o.OrderID)) AS BIGINT)
             AS TotalItemsSold
    FROM sale o
    WHERE OrderDate BETWEEN {START} AND {NOW} AND OrderStatus <> 'Cancelled'
      AND OrderID IN (SELECT OrderID FROM line)""",
        "sales_report_category": base("cat", "prod", "sale", "line") + f"""
    SELECT c.CategoryID, c.CategoryName, c.CategoryDescription,
           count(DISTINCT o.OrderID) AS OrderCount,
           CAST(sum(l.Quantity) AS BIGINT) AS QuantitySold,
           CAST(sum(l.LineTotal) AS DOUBLE) AS TotalRevenue,
           CAST(sum(l.UnitPrice) AS DOUBLE) / count(*) AS AveragePrice,
           count(DISTINCT p.ProductID) AS ProductsInCategory,
           min(o.OrderDate) AS FirstSaleDate, max(o.OrderDate) AS LastSaleDate
    {sold} GROUP BY ALL""",
        "category_tree": base("cat").replace("WITH", "WITH RECURSIVE", 1) + NESTED + """
    SELECT CategoryID, CAST(CASE WHEN Place = 'tree' THEN Depth END AS INT) AS Depth,
           CASE WHEN Place = 'tree' THEN RootID END AS RootID, Place
    FROM (SELECT n.CategoryID, max(len(path)) - 1 AS Depth, arg_max(top, len(path)) AS RootID,
                 CASE WHEN bool_or(own) THEN 'cycle' WHEN bool_or(repeated) THEN 'below cycle' ELSE 'tree' END AS Place
          FROM nested n JOIN walk USING (CategoryID) GROUP BY n.CategoryID)""",
        "sales_report_subtree": base("cat", "prod", "sale", "line").replace("WITH", "WITH RECURSIVE", 1) + NESTED + f"""
    , own AS (SELECT c.CategoryID, sum(l.Quantity) AS q, sum(l.LineTotal) AS r {sold} GROUP BY 1)
    SELECT a.CategoryID, any_value(a.CategoryName) AS CategoryName, count(*) AS Categories,
           CAST(coalesce(sum(q), 0) AS BIGINT) AS QuantitySold, CAST(coalesce(sum(r), 0) AS DOUBLE) AS TotalRevenue
    FROM nested a JOIN (SELECT DISTINCT CategoryID, top FROM walk) w ON w.top = a.CategoryID
    LEFT JOIN own ON own.CategoryID = w.CategoryID GROUP BY 1""",
        "sales_report_product": base("cat", "prod", "sale", "line") + f"""
    SELECT p.ProductID, p.ProductName, p.ProductSKU, c.CategoryName,
           CAST(p.Price AS DOUBLE) AS CurrentPrice,
           CAST(sum(l.UnitPrice) AS DOUBLE) / count(*) AS AverageSoldPrice,
           CAST(sum(l.Quantity) AS BIGINT) AS QuantitySold,
           CAST(sum(l.LineTotal) AS DOUBLE) AS TotalRevenue,
           count(DISTINCT l.OrderID) AS OrderCount,
           p.StockQuantity AS CurrentStock,
           CASE WHEN p.StockQuantity <= p.ReorderLevel THEN 'Low Stock'
                WHEN p.StockQuantity = 0 THEN 'Out of Stock' ELSE 'In Stock' END AS StockStatus,
           min(o.OrderDate) AS FirstSaleDate, max(o.OrderDate) AS LastSaleDate
    {sold} GROUP BY ALL""",
        "sales_report_monthly": base("sale") + f"""
    SELECT 'Performance Metrics' AS MetricType,
           monthname(OrderDate) || ' ' || year(OrderDate) AS Period,
           count(DISTINCT OrderID) AS MonthlyOrders,
           CAST(sum(TotalAmount) AS DOUBLE) AS MonthlyRevenue,
           CAST(sum(TotalAmount) AS DOUBLE) / count(*) AS MonthlyAOV,
           count(DISTINCT CustomerID) AS MonthlyCustomers
    FROM sale
    WHERE OrderDate BETWEEN {START} AND {NOW} AND OrderStatus <> 'Cancelled'
    GROUP BY 2""",
        "low_stock_products": base("cat", "prod", "sale", "line") + f"""
    , recent AS (
      SELECT l.ProductID, CAST(sum(l.Quantity) AS BIGINT) AS n
      FROM line l JOIN sale o ON o.OrderID = l.OrderID
      WHERE o.OrderDate >= {NOW} - INTERVAL 30 DAY AND o.OrderStatus <> 'Cancelled' GROUP BY 1)
    SELECT p.ProductID, p.ProductName, p.ProductSKU, c.CategoryName, p.StockQuantity,
           p.ReorderLevel, CAST(p.Price AS DOUBLE) AS Price,
           CASE WHEN p.StockQuantity = 0 THEN 'Out of Stock' ELSE 'Low Stock' END AS StockStatus,
           p.ReorderLevel - p.StockQuantity AS SuggestedOrderQuantity,
           p.ModifiedDate AS LastStockUpdate,
           coalesce(r.n, 0) AS QuantitySoldLast30Days,
           CASE WHEN r.n > 0 THEN CAST(p.StockQuantity AS DOUBLE) / (CAST(r.n AS DOUBLE) / 30.0)
                ELSE 999 END AS DaysOfInventoryRemaining
    FROM prod p JOIN cat c ON c.CategoryID = p.CategoryID
    LEFT JOIN recent r ON r.ProductID = p.ProductID
    WHERE p.IsActive AND p.StockQuantity <= p.ReorderLevel""",
    }


def _performance(lines: str) -> str:
    """Common table expressions ending in ``perf``, product performance."""
    return f"""
    , sold AS (
      SELECT l.ProductID, count(DISTINCT l.OrderID) AS TotalOrders,
             CAST(sum(l.Quantity) AS BIGINT) AS TotalQuantitySold, sum(l.LineTotal) AS Revenue,
             CAST(sum(l.UnitPrice) AS DOUBLE) / count(*) AS AverageSellingPrice,
             min(o.OrderDate) AS FirstSaleDate, max(o.OrderDate) AS LastSaleDate,
             coalesce(CAST(sum(l.Quantity) FILTER (o.OrderDate >= {NOW} - INTERVAL 30 DAY)
                           AS BIGINT), 0) AS q30,
             coalesce(sum(l.LineTotal) FILTER (o.OrderDate >= {NOW} - INTERVAL 30 DAY), 0) AS r30,
             coalesce(CAST(sum(l.Quantity) FILTER (o.OrderDate >= {NOW} - INTERVAL 90 DAY)
                           AS BIGINT), 0) AS q90,
             coalesce(sum(l.LineTotal) FILTER (o.OrderDate >= {NOW} - INTERVAL 90 DAY), 0) AS r90
      FROM line l {lines} sale o ON o.OrderID = l.OrderID AND o.OrderStatus <> 'Cancelled'
      GROUP BY 1
    ), back AS (
      SELECT ProductID, count(*) AS n, CAST(sum(ReturnQuantity) AS BIGINT) AS q,
             sum(RefundAmount) AS refund
      FROM ret WHERE ReturnStatus = 'Processed' GROUP BY 1
    ), perf AS (
      SELECT p.ProductID, p.ProductName, p.ProductSKU, c.CategoryName,
             CAST(p.Price AS DOUBLE) AS CurrentPrice, p.StockQuantity, p.ReorderLevel, p.IsActive,
             coalesce(s.TotalOrders, 0) AS TotalOrders,
             coalesce(s.TotalQuantitySold, 0) AS TotalQuantitySold,
             CAST(coalesce(s.Revenue, 0) AS DOUBLE) AS TotalRevenue,
             coalesce(s.AverageSellingPrice, CAST(p.Price AS DOUBLE)) AS AverageSellingPrice,
             s.FirstSaleDate, s.LastSaleDate,
             coalesce(s.q30, 0) AS QuantitySoldLast30Days,
             CAST(coalesce(s.r30, 0) AS DOUBLE) AS RevenueLast30Days,
             coalesce(s.q90, 0) AS QuantitySoldLast90Days,
             CAST(coalesce(s.r90, 0) AS DOUBLE) AS RevenueLast90Days,
             CASE WHEN p.StockQuantity = 0 THEN 'Out of Stock'
                  WHEN p.StockQuantity <= p.ReorderLevel THEN 'Low Stock'
                  WHEN p.StockQuantity > 3 * p.ReorderLevel THEN 'Overstock'
                  ELSE 'In Stock' END AS StockStatus,
             CASE WHEN s.q30 > 0 THEN CAST(s.q30 AS DOUBLE) / 30.0 ELSE 0.0 END
               AS SalesVelocity30Days,
             CASE WHEN p.StockQuantity = 0 THEN 0.0
                  WHEN s.q30 > 0
                  THEN CAST(p.StockQuantity AS DOUBLE) / (CAST(s.q30 AS DOUBLE) / 30.0)
                  ELSE 999.0 END AS DaysOfInventoryRemaining,
             coalesce(b.n, 0) AS TotalReturns, coalesce(b.q, 0) AS TotalReturnQuantity,
             CAST(coalesce(b.refund, 0) AS DOUBLE) AS TotalRefundAmount,
             CASE WHEN s.TotalQuantitySold > 0
                  THEN CAST(coalesce(b.q, 0) AS DOUBLE) / s.TotalQuantitySold
                  ELSE 0.0 END AS ReturnRate,
             CASE WHEN s.Revenue > 0
                  THEN CAST(s.Revenue - coalesce(b.refund, 0) AS DOUBLE)
                       / CAST(s.Revenue AS DOUBLE)
                  ELSE 0.0 END AS ProfitabilityScore
      FROM prod p JOIN cat c ON c.CategoryID = p.CategoryID
      LEFT JOIN sold s ON s.ProductID = p.ProductID
      LEFT JOIN back b ON b.ProductID = p.ProductID)"""


HISTORY = """
    , hist AS (
    SELECT o.OrderID, o.CustomerID, c.CustomerName, o.OrderDate, o.OrderStatus, o.PaymentStatus,
           CAST(o.TotalAmount AS DOUBLE) AS TotalAmount, CAST(o.SubTotal AS DOUBLE) AS SubTotal,
           CAST(o.TaxAmount AS DOUBLE) AS TaxAmount,
           CAST(o.ShippingAmount AS DOUBLE) AS ShippingAmount,
           CAST(o.DiscountAmount AS DOUBLE) AS DiscountAmount,
           o.TrackingNumber, o.ExpectedDeliveryDate, o.ActualDeliveryDate,
           s.AddressLine1 || coalesce(', ' || s.AddressLine2, '') || ', ' || s.City || ', '
             || s.StateProvince || ' ' || s.PostalCode AS ShippingAddress,
           b.AddressLine1 || coalesce(', ' || b.AddressLine2, '') || ', ' || b.City || ', '
             || b.StateProvince || ' ' || b.PostalCode AS BillingAddress,
           l.OrderDetailID, l.ProductID, p.ProductName, p.ProductSKU, g.CategoryName, l.Quantity,
           CAST(l.UnitPrice AS DOUBLE) AS UnitPrice, CAST(l.LineTotal AS DOUBLE) AS LineTotal,
           row_number() OVER (PARTITION BY o.CustomerID
             ORDER BY o.OrderDate DESC, o.OrderID, l.OrderDetailID) AS OrderRank,
           count(*) OVER (PARTITION BY o.CustomerID) AS CustomerTotalOrders,
           CAST(sum(o.TotalAmount) OVER (PARTITION BY o.CustomerID) AS DOUBLE)
             AS CustomerTotalSpent,
           CAST(date_diff('day', o.ExpectedDeliveryDate, o.ActualDeliveryDate) AS INT)
             AS DeliveryVarianceDays,
           CAST(date_diff('day', o.OrderDate, o.ActualDeliveryDate) AS INT) AS TotalDeliveryDays
    FROM sale o JOIN cust c ON c.CustomerID = o.CustomerID AND c.IsActive
    JOIN line l ON l.OrderID = o.OrderID
    JOIN prod p ON p.ProductID = l.ProductID
    JOIN cat g ON g.CategoryID = p.CategoryID
    LEFT JOIN addr s ON s.AddressID = o.ShippingAddressID
    LEFT JOIN addr b ON b.AddressID = o.BillingAddressID)"""

# In the first form each row shows its own movement's date.
DASHBOARD = f"""
    , recent AS (
      SELECT l.ProductID, CAST(sum(l.Quantity) AS BIGINT) AS n
      FROM line l JOIN sale o ON o.OrderID = l.OrderID
      WHERE o.OrderDate >= {NOW} - INTERVAL 30 DAY AND o.OrderStatus <> 'Cancelled' GROUP BY 1
    ), moves AS (
      SELECT DISTINCT ProductID, TransactionType, Quantity, TransactionDate FROM led
    ), seen AS (
      SELECT ProductID, TransactionDate,
             first_value(TransactionType) OVER w AS kind, first_value(Quantity) OVER w AS q,
             row_number() OVER w AS nth
      FROM moves
      WINDOW w AS (PARTITION BY ProductID
                   ORDER BY TransactionDate DESC, TransactionType, Quantity))
    SELECT p.ProductID, p.ProductName, p.ProductSKU, c.CategoryName, p.StockQuantity,
           p.ReorderLevel, CAST(p.Price AS DOUBLE) AS Price,
           CASE WHEN p.StockQuantity = 0 THEN 'OUT_OF_STOCK'
                WHEN p.StockQuantity <= p.ReorderLevel THEN 'LOW_STOCK'
                WHEN p.StockQuantity > 3 * p.ReorderLevel THEN 'OVERSTOCK'
                ELSE 'NORMAL' END AS StockStatus,
           CASE WHEN p.StockQuantity = 0 THEN 'CRITICAL'
                WHEN p.StockQuantity <= p.ReorderLevel THEN 'WARNING'
                WHEN p.StockQuantity > 3 * p.ReorderLevel THEN 'INFO'
                ELSE 'OK' END AS AlertLevel,
           CASE WHEN p.StockQuantity <= p.ReorderLevel
                THEN 2 * p.ReorderLevel - p.StockQuantity ELSE 0 END AS SuggestedReorderQuantity,
           m.TransactionDate AS LastTransaction, m.kind AS LastTransactionType,
           m.q AS LastTransactionQuantity,
           coalesce(r.n, 0) AS QuantitySoldLast30Days,
           CASE WHEN r.n > 0 THEN CAST(r.n AS DOUBLE) / 30.0 ELSE 0.0 END AS SalesVelocity30Days,
           CASE WHEN p.StockQuantity = 0 THEN 0.0
                WHEN r.n > 0 THEN CAST(p.StockQuantity AS DOUBLE) / (CAST(r.n AS DOUBLE) / 30.0)
                ELSE 999.0 END AS DaysOfInventoryRemaining
    FROM prod p JOIN cat c ON c.CategoryID = p.CategoryID
    LEFT JOIN seen m ON m.ProductID = p.ProductID
    LEFT JOIN recent r ON r.ProductID = p.ProductID
    WHERE p.IsActive"""

TIER = """CASE WHEN {spent} >= 10000 OR ({spent} >= 5000 AND {n} >= 50) THEN 'Platinum'
                WHEN {spent} >= 2500 OR ({spent} >= 1000 AND {n} >= 20) THEN 'Gold'
                WHEN {spent} >= 500 OR ({spent} >= 250 AND {n} >= 5) THEN 'Silver'
                ELSE 'Bronze' END"""

TIERS = f"""
    , tiers AS (
      SELECT CustomerID, TotalSpent, OrderCount,
             {TIER.format(spent='TotalSpent', n='OrderCount')} AS CustomerTier
      FROM (SELECT c.CustomerID, coalesce(sum(o.TotalAmount), 0) AS TotalSpent,
                   count(o.OrderID) AS OrderCount
            FROM cust c LEFT JOIN sale o
              ON o.CustomerID = c.CustomerID AND o.OrderStatus <> 'Cancelled'
            GROUP BY 1))"""


def _views() -> dict[str, str]:
    return {
        "customer_order_history": base("cat", "prod", "cust", "addr", "sale", "line") + HISTORY
        + " SELECT * FROM hist",
        "product_performance": base("cat", "prod", "sale", "line", "ret")
        + _performance("LEFT JOIN") + " SELECT * FROM perf",
        "product_performance_corrected": base("cat", "prod", "sale", "line", "ret")
        + _performance("JOIN") + " SELECT * FROM perf",
        "inventory_dashboard": base("cat", "prod", "sale", "led") + DASHBOARD,
        "inventory_dashboard_corrected": base("cat", "prod", "sale", "led") + DASHBOARD
        + " AND (m.nth = 1 OR m.nth IS NULL)",
        "customer_analytics": base("cust", "sale", "line", "ret") + f"""
    , m AS (
      SELECT c.CustomerID, c.CustomerName, c.CreatedDate, c.LastLoginDate,
             count(o.OrderID) AS n, coalesce(sum(o.TotalAmount), 0) AS spent,
             min(o.OrderDate) AS first_at, max(o.OrderDate) AS last_at,
             count(*) FILTER (o.OrderDate >= {NOW} - INTERVAL 30 DAY) AS n30,
             count(*) FILTER (o.OrderDate >= {NOW} - INTERVAL 90 DAY) AS n90,
             count(*) FILTER (o.OrderDate >= {NOW} - INTERVAL 1 YEAR) AS n365,
             coalesce(sum(o.TotalAmount) FILTER (o.OrderDate >= {NOW} - INTERVAL 30 DAY), 0) AS s30,
             coalesce(sum(o.TotalAmount) FILTER (o.OrderDate >= {NOW} - INTERVAL 90 DAY), 0) AS s90,
             coalesce(sum(o.TotalAmount) FILTER (o.OrderDate >= {NOW} - INTERVAL 1 YEAR), 0) AS s365
      FROM cust c LEFT JOIN sale o
        ON o.CustomerID = c.CustomerID AND o.OrderStatus <> 'Cancelled'
      WHERE c.IsActive GROUP BY ALL
    ), r AS (
      SELECT o.CustomerID, count(*) AS n, sum(t.RefundAmount) AS refund
      FROM ret t JOIN sale o ON o.OrderID = t.OrderID
      WHERE t.ReturnStatus = 'Processed' GROUP BY 1)
    SELECT m.CustomerID, m.CustomerName, m.CreatedDate, m.LastLoginDate,
           {TIER.format(spent='m.spent', n='m.n')} AS CustomerTier,
           m.n AS TotalOrders, CAST(m.spent AS DOUBLE) AS TotalSpent,
           CASE WHEN m.n = 0 THEN 0.0 ELSE CAST(m.spent AS DOUBLE) / m.n END AS AverageOrderValue,
           m.first_at AS FirstOrderDate, m.last_at AS LastOrderDate,
           CAST(date_diff('day', m.CreatedDate, {NOW}) AS INT) AS DaysAsCustomer,
           CASE WHEN m.last_at IS NULL THEN 'Never Ordered'
                WHEN m.last_at >= {NOW} - INTERVAL 30 DAY THEN 'Active'
                WHEN m.last_at >= {NOW} - INTERVAL 90 DAY THEN 'At Risk'
                ELSE 'Inactive' END AS CustomerStatus,
           CAST(coalesce(date_diff('day', m.last_at, {NOW}), 0) AS INT) AS DaysSinceLastOrder,
           CASE WHEN date_diff('month', m.first_at, {NOW}) > 0
                THEN CAST(m.n AS DOUBLE) / date_diff('month', m.first_at, {NOW})
                ELSE 0.0 END AS OrdersPerMonth,
           m.n30 AS OrdersLast30Days, m.n90 AS OrdersLast90Days, m.n365 AS OrdersLastYear,
           CAST(m.s30 AS DOUBLE) AS SpentLast30Days, CAST(m.s90 AS DOUBLE) AS SpentLast90Days,
           CAST(m.s365 AS DOUBLE) AS SpentLastYear,
           coalesce(r.n, 0) AS TotalReturns,
           CAST(coalesce(r.refund, 0) AS DOUBLE) AS TotalRefundAmount,
           CASE WHEN m.n > 0 THEN CAST(coalesce(r.n, 0) AS DOUBLE) / m.n ELSE 0.0 END
             AS ReturnRate,
           CASE WHEN m.spent = 0 THEN 0.0
                ELSE CAST(m.spent AS DOUBLE) * CAST(0.6 AS DOUBLE)
                     + CAST(m.n AS DOUBLE) * 10 * CAST(0.3 AS DOUBLE)
                     + CAST(CASE WHEN m.n90 > 0 THEN 100 ELSE 0 END AS DOUBLE)
                       * CAST(0.1 AS DOUBLE) END AS CustomerValueScore
    FROM m LEFT JOIN r ON r.CustomerID = m.CustomerID""",
        "sales_performance_dashboard": base("sale") + f"""
    , live AS (SELECT * FROM sale WHERE OrderStatus <> 'Cancelled'
    ), k AS (
      SELECT count(*) FILTER (d >= day0) AS nt, coalesce(sum(v) FILTER (d >= day0), 0) AS rt,
             count(*) FILTER (d >= day0 - INTERVAL 1 DAY AND d < day0) AS ny,
             coalesce(sum(v) FILTER (d >= day0 - INTERVAL 1 DAY AND d < day0), 0) AS ry,
             count(*) FILTER (d >= asof_ - INTERVAL 7 DAY) AS n7,
             coalesce(sum(v) FILTER (d >= asof_ - INTERVAL 7 DAY), 0) AS r7,
             count(*) FILTER (d >= asof_ - INTERVAL 30 DAY) AS n30,
             coalesce(sum(v) FILTER (d >= asof_ - INTERVAL 30 DAY), 0) AS r30,
             count(*) FILTER (d >= date_trunc('month', asof_)) AS nm,
             coalesce(sum(v) FILTER (d >= date_trunc('month', asof_)), 0) AS rm,
             count(*) FILTER (d >= date_trunc('year', asof_)) AS nyr,
             coalesce(sum(v) FILTER (d >= date_trunc('year', asof_)), 0) AS ryr,
             count(DISTINCT CustomerID) FILTER (d >= asof_ - INTERVAL 30 DAY) AS u30,
             count(DISTINCT CustomerID) FILTER (d >= date_trunc('month', asof_)) AS um
      FROM (SELECT CustomerID, OrderDate AS d, TotalAmount AS v, {NOW} AS asof_,
                   date_trunc('day', {NOW}) AS day0 FROM live))
    SELECT nt AS OrdersToday, CAST(rt AS DOUBLE) AS RevenueToday, ny AS OrdersYesterday,
           CAST(ry AS DOUBLE) AS RevenueYesterday,
           CASE WHEN ny > 0 THEN (CAST(nt AS DOUBLE) - ny) / ny * 100 ELSE 0.0 END
             AS OrderGrowthRate,
           CASE WHEN ry > 0 THEN (CAST(rt AS DOUBLE) - CAST(ry AS DOUBLE)) / CAST(ry AS DOUBLE)
                                 * 100 ELSE 0.0 END AS RevenueGrowthRate,
           n7 AS OrdersLast7Days, CAST(r7 AS DOUBLE) AS RevenueLast7Days,
           n30 AS OrdersLast30Days, CAST(r30 AS DOUBLE) AS RevenueLast30Days,
           nm AS OrdersThisMonth, CAST(rm AS DOUBLE) AS RevenueThisMonth,
           nyr AS OrdersThisYear, CAST(ryr AS DOUBLE) AS RevenueThisYear,
           CAST(r30 AS DOUBLE) / nullif(n30, 0) AS AOVLast30Days,
           CAST(rm AS DOUBLE) / nullif(nm, 0) AS AOVThisMonth,
           u30 AS UniqueCustomersLast30Days, um AS UniqueCustomersThisMonth,
           CASE WHEN u30 > 0 THEN CAST(r30 AS DOUBLE) / u30 ELSE 0.0 END
             AS RevenuePerCustomerLast30Days,
           CASE WHEN u30 > 0 THEN CAST(n30 AS DOUBLE) / u30 ELSE 0.0 END
             AS OrdersPerCustomerLast30Days
    FROM k""",
    }


RECOMMENDED = """
    , bought AS (
      SELECT DISTINCT o.CustomerID, l.ProductID, p.CategoryID
      FROM sale o JOIN line l ON l.OrderID = o.OrderID JOIN prod p ON p.ProductID = l.ProductID
      WHERE o.OrderStatus <> 'Cancelled'
    ), liked AS (
      SELECT b.CustomerID, b.CategoryID,
             count(*) * any_value(s.n) AS score
      FROM bought b
      JOIN (SELECT CategoryID, count(*) AS n FROM prod GROUP BY 1) s
        ON s.CategoryID = b.CategoryID
      GROUP BY 1, 2
    ), recs AS (
      SELECT k.CustomerID, f.ProductID, f.ProductName, f.ProductSKU, f.CurrentPrice AS Price,
             f.CategoryName, f.TotalQuantitySold, f.AverageSellingPrice,
             CAST(k.score AS BIGINT) AS PopularityScore,
             CAST(row_number() OVER (PARTITION BY k.CustomerID
                    ORDER BY k.score DESC, f.TotalQuantitySold DESC, f.ProductID) AS INT)
               AS RecommendationRank
      FROM liked k JOIN prod p ON p.CategoryID = k.CategoryID
      JOIN perf f ON f.ProductID = p.ProductID
      ANTI JOIN bought b ON b.CustomerID = k.CustomerID AND b.ProductID = p.ProductID
      WHERE p.IsActive AND p.StockQuantity > 0
      QUALIFY RecommendationRank <= 5)"""


def _functions() -> dict[str, str]:
    return {
        "customer_tier": base("cust", "sale") + TIERS + """
    SELECT CustomerID, CAST(TotalSpent AS DOUBLE) AS TotalSpent, OrderCount, CustomerTier
    FROM tiers""",
        "shipping_cost": base("line") + """
    , parcel AS (
      SELECT OrderDetailID, CAST(Quantity * 0.35 AS DECIMAL(8,2)) AS w,
             CASE OrderID % 6 WHEN 0 THEN 'LOCAL' WHEN 1 THEN 'REGIONAL' WHEN 2 THEN 'NATIONAL'
                  WHEN 3 THEN 'INTERNATIONAL' WHEN 4 THEN 'MOON' END AS zone,
             CASE OrderID % 5 WHEN 0 THEN 'Standard' WHEN 1 THEN 'Express'
                  WHEN 2 THEN 'Overnight' WHEN 3 THEN 'Economy' END AS way
      FROM line
    ), rate(way, base, pound) AS (
      VALUES ('Economy', 3.99, 0.89), ('Standard', 5.99, 1.25), ('Express', 12.99, 2.50),
             ('Overnight', 24.99, 4.99)
    ), far(zone, f) AS (
      VALUES ('LOCAL', 0.8), ('REGIONAL', 1.0), ('NATIONAL', 1.3), ('INTERNATIONAL', 2.5)
    ), c1 AS (
      SELECT p.*, coalesce(pound, 1.25) AS pound, coalesce(f, 1.0) AS f,
             CAST(coalesce(base, 5.99) * coalesce(f, 1.0) AS DECIMAL(8,2)) AS c
      FROM parcel p LEFT JOIN rate r ON r.way = p.way LEFT JOIN far z ON z.zone = p.zone
    ), c2 AS (
      SELECT *, greatest(CAST(CASE WHEN w > 1 THEN c + (w - 1) * pound * f ELSE c END
                              AS DECIMAL(8,2)), 1.99) AS cc
      FROM c1)
    SELECT OrderDetailID, CAST(w AS DOUBLE) AS Weight, zone AS Zone, way AS ShippingMethod,
           CAST(CASE WHEN zone <> 'INTERNATIONAL' AND cc > 99.99 THEN 99.99 ELSE cc END AS DOUBLE)
             AS ShippingCost
    FROM c2""",
        "product_discount": base("prod", "cust", "sale", "line") + TIERS + """
    SELECT l.OrderDetailID, o.CustomerID, l.ProductID, l.Quantity,
           CAST(l.UnitPrice AS DOUBLE) AS UnitPrice,
           CAST(CAST(l.UnitPrice * l.Quantity * least(0.25,
             CASE t.CustomerTier WHEN 'Platinum' THEN 0.15 WHEN 'Gold' THEN 0.10
                                 WHEN 'Silver' THEN 0.05 ELSE 0.00 END
             + CASE WHEN l.Quantity >= 10 THEN 0.05 WHEN l.Quantity >= 5 THEN 0.02 ELSE 0.00 END
             + CASE WHEN p.CategoryID IN (6, 7, 8) THEN 0.03 ELSE 0.00 END)
             AS DECIMAL(12,4)) AS DOUBLE) AS DiscountAmount
    FROM line l JOIN sale o ON o.OrderID = l.OrderID
    LEFT JOIN tiers t ON t.CustomerID = o.CustomerID
    LEFT JOIN prod p ON p.ProductID = l.ProductID""",
        # One calendar day at a time: the weekdays after the order, counted.
        "delivery_estimate": base("sale") + """
    , plan AS (
      SELECT OrderID, OrderDate + to_hours(CAST(OrderID % 24 AS INT)) AS placed,
             ShippingMethod,
             CASE OrderID % 6 WHEN 0 THEN 'LOCAL' WHEN 1 THEN 'REGIONAL' WHEN 2 THEN 'NATIONAL'
                  WHEN 3 THEN 'INTERNATIONAL' WHEN 4 THEN 'MOON' END AS Zone
      FROM sale
    ), need AS (
      SELECT *, CASE ShippingMethod WHEN 'Overnight' THEN 1 WHEN 'Express' THEN 2
                     WHEN 'Standard' THEN 5 WHEN 'Economy' THEN 7 ELSE 5 END
              + CASE Zone WHEN 'LOCAL' THEN 0 WHEN 'REGIONAL' THEN 1 WHEN 'NATIONAL' THEN 2
                     WHEN 'INTERNATIONAL' THEN 5 ELSE 1 END AS days
      FROM plan
    ), walk AS (
      SELECT n.*, placed + to_days(CAST(i AS INT)) AS day_,
             row_number() OVER (PARTITION BY OrderID ORDER BY i) AS nth
      FROM need n, range(1, 31) t(i)
      WHERE dayofweek(placed + to_days(CAST(i AS INT))) NOT IN (0, 6))
    SELECT OrderID, placed AS OrderDate, ShippingMethod, Zone, day_ AS EstimatedDelivery
    FROM walk WHERE nth = days""",
        "product_recommendations": base("cat", "prod", "sale", "line", "ret")
        + _performance("LEFT JOIN") + RECOMMENDED + " SELECT * FROM recs",
    }


def _variants(made: dict[str, str]) -> dict[str, str]:
    """Options of reports as filters on the whole reports, and the same work done another way."""
    sets = [("category", "CategoryID", "TotalRevenue"), ("product", "ProductID", "TotalRevenue"),
            ("monthly", "Period", "MonthlyRevenue")]
    of_category = base("cat", "prod") + " SELECT ProductID FROM prod WHERE CategoryID = 7"
    return {
        "sales_report_detailed": " UNION ALL ".join(
            f"SELECT '{name}' AS ResultSet, CAST({label} AS VARCHAR) AS Label, {revenue} AS Revenue"
            f" FROM ({made[f'sales_report_{name}']})" for name, label, revenue in sets),
        "sales_report_category_filtered":
            f"SELECT * FROM ({made['sales_report_category']}) WHERE CategoryID = 7",
        "sales_report_product_filtered":
            f"SELECT * FROM ({made['sales_report_product']}) WHERE ProductID IN ({of_category})",
        "low_stock_products_available":
            f"SELECT * FROM ({made['low_stock_products']}) WHERE StockQuantity > 0",
        "customer_order_history_split": made["customer_order_history"],
        **{f"sql_{name}": f"SELECT {columns} FROM ({made[name]})" for name, columns in (
            ("shipping_cost", "OrderDetailID, ShippingCost"),
            ("delivery_estimate", "OrderID, EstimatedDelivery"),
            ("customer_tier", "CustomerID, CustomerTier"))},
    }


def statements() -> dict[str, str]:
    made: dict[str, str] = {}
    for group in (_reports, _views, _functions):
        made.update(group())
    return made | _variants(made)
