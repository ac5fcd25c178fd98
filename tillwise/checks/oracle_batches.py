"""SQL for the order, return and adjustment jobs.

Where rows are decided one after another, the SQL steps through them by their
turn on each key.
"""

from __future__ import annotations

from tillwise.checks.oracle import NOW, base

REQUESTS = """
    , req0 AS (
      SELECT *, OrderID // 10 AS Buyer,
             CASE WHEN OrderID % 89 = 3 THEN -1 ELSE ProductID END AS p1,
             CASE WHEN OrderID % 97 = 5 THEN '"many"' ELSE CAST(Quantity AS VARCHAR) END AS q1
      FROM line
    ), req AS (
      SELECT OrderDetailID AS OrderID, Buyer AS CustomerID,
             CASE WHEN OrderID % 7 = 0 THEN NULL WHEN OrderID % 11 = 0 THEN Buyer + 1
                  ELSE Buyer END AS ship,
             CASE WHEN OrderID % 5 = 0 THEN NULL WHEN OrderID % 13 = 0 THEN -1
                  ELSE Buyer END AS bill,
             CASE WHEN OrderID % 4 = 0 THEN 0.05 ELSE 0.0875 END AS TaxRate,
             OrderID % 3 AS off,
             CASE WHEN OrderID % 101 = 7 THEN '[]' WHEN OrderID % 103 = 9 THEN 'no list'
             ELSE '[{"ProductID":' || p1 || ',"Quantity":' || q1 || ',"UnitPrice":' || UnitPrice
               || '}'
               || CASE WHEN Quantity % 2 = 0
                  THEN ',{"ProductID":' || (ProductID // 2) || ',"Quantity":'
                       || (1 + Quantity % 5) || ',"UnitPrice":' || UnitPrice || '}' ELSE '' END
               || CASE WHEN Quantity % 7 = 3
                  THEN ',{"ProductID":' || ProductID || ',"Quantity":1,"UnitPrice":' || UnitPrice
                       || '}' ELSE '' END || ']' END AS items
      FROM req0
    ), listed AS (
      SELECT OrderID, unnest(CAST(items AS JSON[])) AS item,
             generate_subscripts(CAST(items AS JSON[]), 1) - 1 AS ItemNo
      FROM req WHERE json_valid(items)
    ), item AS (
      SELECT OrderID, CAST(ItemNo AS INT) AS ItemNo,
             TRY_CAST(item ->> '$.ProductID' AS BIGINT) AS ProductID,
             TRY_CAST(item ->> '$.Quantity' AS INT) AS Quantity,
             TRY_CAST(item ->> '$.UnitPrice' AS DECIMAL(12,4)) AS UnitPrice
      FROM listed
    ), good AS (
      SELECT *, coalesce(ProductID IS NOT NULL AND Quantity > 0 AND UnitPrice > 0, false)
                AS IsValid FROM item)"""

ADJUSTMENTS = """
    , adj AS (
      SELECT OrderDetailID AS AdjustmentID, CreatedDate AS AdjustedAt, ProductID,
             CASE OrderID % 4 WHEN 0 THEN 'Restock' WHEN 1 THEN 'Damage' WHEN 2 THEN 'Transfer'
                  ELSE 'Adjustment' END AS AdjustmentType,
             CASE WHEN OrderID % 4 = 0 THEN 2 * Quantity ELSE -Quantity END AS q,
             CASE WHEN OrderID % 2 = 0 THEN 'count of ' || OrderID END AS Notes,
             CAST(OrderID AS VARCHAR) AS ReferenceID,
             row_number() OVER (PARTITION BY ProductID ORDER BY CreatedDate, OrderDetailID) AS n
      FROM line
    ), step AS (
      SELECT ProductID, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS AdjustmentID,
             CAST(0 AS BIGINT) AS met, {stock} AS stock, true AS ok
      FROM prod WHERE IsActive
      UNION ALL
      SELECT s.ProductID, a.n, a.AdjustmentID, s.stock,
             CASE WHEN a.q < 0 AND s.stock + a.q < 0 THEN s.stock ELSE s.stock + a.q END,
             NOT (a.q < 0 AND s.stock + a.q < 0)
      FROM step s JOIN adj a ON a.ProductID = s.ProductID AND a.n = s.n + 1)"""

LEDGER_OF_STEPS = f"""
    SELECT a.AdjustmentID AS TransactionID, a.ProductID, a.AdjustmentType AS TransactionType,
           a.q AS Quantity, s.met AS PreviousStock, s.stock AS NewStock, a.ReferenceID,
           'Manual' AS ReferenceType, {NOW} AS TransactionDate, 'loader' AS UserId,
           coalesce(a.Notes, 'Manual inventory adjustment') AS Notes
    FROM step s JOIN adj a ON a.AdjustmentID = s.AdjustmentID WHERE s.ok"""

RETURNS = """
    , ask AS (
      SELECT 'Q-' || OrderDetailID AS ReturnID, CreatedDate AS RequestedAt, OrderID,
             CASE WHEN Quantity % 17 = 5 THEN ProductID + 1 ELSE ProductID END AS ProductID,
             CASE WHEN Quantity % 13 = 1 THEN Quantity + 1 WHEN Quantity % 11 = 1 THEN 0
                  WHEN OrderID % 2 = 0 THEN Quantity ELSE 1 + Quantity // 2 END AS q,
             CASE WHEN Quantity % 2 = 0 THEN 'Damaged' END AS ReturnReason,
             CASE WHEN OrderID % 3 = 0 THEN CAST(9.99 AS DECIMAL(12,4)) END AS told,
             OrderID % 5 <> 0 AS RestockProduct
      FROM line
    ), own AS (
      SELECT OrderID, ProductID, Quantity AS ordered, UnitPrice FROM line
      QUALIFY row_number() OVER (PARTITION BY OrderID, ProductID ORDER BY OrderDetailID) = 1
    ), held AS (
      SELECT a.*, o.CustomerID, o.OrderDate, w.ordered, o.OrderStatus,
             coalesce(a.told, CAST(a.q * w.UnitPrice AS DECIMAL(12,4))) AS refund,
             CASE WHEN w.ordered IS NULL OR o.OrderID IS NULL THEN 'Order or product not found.'
                  WHEN o.OrderStatus NOT IN ('Delivered', 'Shipped')
                  THEN 'Returns are only allowed for delivered or shipped orders.'
                  WHEN a.q <= 0 OR {limit} THEN 'Invalid return quantity.' END AS wrong
      FROM ask a LEFT JOIN sale o ON o.OrderID = a.OrderID
      LEFT JOIN own w ON w.OrderID = a.OrderID AND w.ProductID = a.ProductID)"""

# Lines of the order still open were this request the only one approved just now.
CLOSING = RETURNS.replace("{limit}", "a.q > w.ordered") + """
    , part AS (
      SELECT h.ReturnID, l.OrderDetailID, l.Quantity,
             CASE WHEN l.ProductID = h.ProductID THEN h.q END AS mine,
             (SELECT min(r.ReturnQuantity) FROM ret r WHERE r.OrderID = l.OrderID
                AND r.ProductID = l.ProductID AND r.ReturnStatus = 'Approved') AS least
      FROM held h JOIN line l ON l.OrderID = h.OrderID
      WHERE h.wrong IS NULL
    ), closer AS (
      SELECT ReturnID FROM part GROUP BY 1
      HAVING count(*) FILTER ((mine IS NULL AND least IS NULL)
                              OR Quantity > mine OR Quantity > least) = 0
    ), shut AS (
      SELECT OrderID, arg_min(ReturnID, (RequestedAt, ReturnID)) AS ReturnID,
             min((RequestedAt, ReturnID)) AS at_
      FROM held WHERE ReturnID IN (SELECT ReturnID FROM closer) GROUP BY 1
    ), final AS (
      SELECT h.*, coalesce(s.ReturnID = h.ReturnID, false) AS ClosesOrder,
             CASE WHEN (h.RequestedAt, h.ReturnID) > s.at_
                       AND h.wrong IS DISTINCT FROM 'Order or product not found.'
                  THEN 'Returns are only allowed for delivered or shipped orders.'
                  ELSE h.wrong END AS ErrorMessage
      FROM held h LEFT JOIN shut s ON s.OrderID = h.OrderID)"""

# All returns of a line add up, step by step.
ADDED_UP = RETURNS.replace("{limit}", "false") + """
    , total AS (
      SELECT OrderID, ProductID, sum(Quantity) AS bought FROM line GROUP BY ALL
    ), had AS (
      SELECT OrderID, ProductID, sum(ReturnQuantity) AS n FROM ret
      WHERE ReturnStatus IN ('Approved', 'Processed') GROUP BY ALL
    ), turn AS (
      SELECT ReturnID, OrderID, ProductID, q, RequestedAt,
             row_number() OVER (PARTITION BY OrderID, ProductID ORDER BY RequestedAt, ReturnID)
               AS n
      FROM held WHERE wrong IS NULL
    ), step AS (
      SELECT t.OrderID, t.ProductID, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS ReturnID,
             CAST(t.bought - coalesce(h.n, 0) AS BIGINT) AS room, true AS ok
      FROM total t LEFT JOIN had h ON h.OrderID = t.OrderID AND h.ProductID = t.ProductID
      UNION ALL
      SELECT s.OrderID, s.ProductID, t.n, t.ReturnID,
             CASE WHEN t.q > s.room THEN s.room ELSE s.room - t.q END, t.q <= s.room
      FROM step s JOIN turn t
        ON t.OrderID = s.OrderID AND t.ProductID = s.ProductID AND t.n = s.n + 1
    ), kept AS (
      SELECT h.* FROM held h JOIN step s ON s.ReturnID = h.ReturnID WHERE s.ok
    ), done AS (
      SELECT k.OrderID FROM (SELECT OrderID, sum(q) AS q FROM kept GROUP BY 1) k
      WHERE k.q + coalesce((SELECT sum(n) FROM had WHERE had.OrderID = k.OrderID), 0)
            >= (SELECT sum(bought) FROM total WHERE total.OrderID = k.OrderID))"""


# One order per step against the stock left by the steps before. Row -1 holds
# the step, rows from 0 the stock, rows from -1000 down the refused orders.
REPLAY = """
    , wanted AS (
      SELECT o.OrderDate, o.OrderID, l.ProductID, sum(l.Quantity) AS q
      FROM sale o JOIN line l ON l.OrderID = o.OrderID GROUP BY ALL
    ), unit AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY OrderDate, OrderID) - 1 AS n, OrderID,
             list({p: ProductID, q: q}) AS items
      FROM wanted GROUP BY OrderDate, OrderID
    ), page AS MATERIALIZED (
      SELECT n // 128 AS no, list(items ORDER BY n) AS units FROM unit GROUP BY 1
    ), run(k, v) USING KEY (k) AS (
      SELECT ProductID, CAST(StockQuantity * 10 AS BIGINT) FROM prod
      UNION ALL SELECT -1, CAST(0 AS BIGINT)
      UNION
      SELECT unnest(list_concat(
               [{k: -1, v: n + 1}],
               CASE WHEN fits THEN rest ELSE [{k: -1000 - n, v: CAST(0 AS BIGINT)}] END),
             recursive := true)
      FROM (
        SELECT n, bool_and(s.v >= u.q) AS fits,
               list({k: u.p, v: CAST(s.v - u.q AS BIGINT)}) AS rest
        FROM (SELECT t.v AS n, unnest(g.units[t.v % 128 + 1], recursive := true)
              FROM run t JOIN page g ON g.no = t.v // 128 WHERE t.k = -1) u
        LEFT JOIN recurring.run s ON s.k = u.p
        GROUP BY n))"""


# Requests that pass every check but those of stock and addresses take their
# turn; only those asking for a product that may run short need a step. A
# request with a wrong address meets the stock and leaves it as it is.
TURNS = """
    , wanted AS (
      SELECT OrderID, ProductID, sum(Quantity) AS q, bool_and(IsValid) AS sound
      FROM good GROUP BY ALL
    ), flags AS (
      SELECT w.OrderID, bool_and(w.sound) AS sound, bool_or(p.ProductID IS NULL) AS unknown
      FROM wanted w LEFT JOIN prod p ON p.ProductID = w.ProductID AND p.IsActive GROUP BY 1
    ), seen AS MATERIALIZED (
      SELECT r.*, l.CreatedDate AS RequestDate,
             NOT EXISTS (SELECT 1 FROM cust c WHERE c.CustomerID = r.CustomerID AND c.IsActive)
               AS nobody,
             coalesce(NOT json_valid(r.items) OR NOT f.sound, false) AS malformed,
             f.OrderID IS NULL AS bare, coalesce(f.unknown, false) AS unknown,
             r.ship IS NOT NULL AND NOT EXISTS (
               SELECT 1 FROM addr a WHERE a.AddressID = r.ship AND a.CustomerID = r.CustomerID
                 AND a.IsActive) AS no_ship,
             r.bill IS NOT NULL AND NOT EXISTS (
               SELECT 1 FROM addr a WHERE a.AddressID = r.bill AND a.CustomerID = r.CustomerID
                 AND a.IsActive) AS no_bill
      FROM req r JOIN line l ON l.OrderDetailID = r.OrderID
      LEFT JOIN flags f ON f.OrderID = r.OrderID
    ), fit AS MATERIALIZED (
      SELECT w.OrderID, s.RequestDate, s.no_ship OR s.no_bill AS mis, w.ProductID, w.q
      FROM seen s JOIN wanted w ON w.OrderID = s.OrderID
      WHERE NOT (s.nobody OR s.malformed OR s.bare OR s.unknown)
    ), tight AS MATERIALIZED (
      SELECT p.ProductID, CAST(any_value(p.StockQuantity) * 30 AS BIGINT) AS stock
      FROM fit f JOIN prod p ON p.ProductID = f.ProductID
      GROUP BY 1 HAVING sum(f.q) > stock
    ), unit AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY RequestDate, OrderID) - 1 AS n, OrderID,
             list({p: ProductID, q: q, m: mis}) AS items
      FROM fit WHERE ProductID IN (SELECT ProductID FROM tight) GROUP BY RequestDate, OrderID
    ), page AS MATERIALIZED (
      SELECT n // 128 AS no, list(items ORDER BY n) AS units FROM unit GROUP BY 1
    ), run(k, v) USING KEY (k) AS (
      SELECT ProductID, stock FROM tight
      UNION ALL SELECT -1, CAST(0 AS BIGINT)
      UNION
      SELECT unnest(list_concat(
               [{k: -1, v: n + 1}],
               CASE WHEN NOT fits THEN [{k: -1000 - n, v: CAST(0 AS BIGINT)}]
                    WHEN mis THEN rest[1:0] ELSE rest END),
             recursive := true)
      FROM (
        SELECT n, bool_and(s.v >= u.q) AS fits, bool_or(u.m) AS mis,
               list({k: u.p, v: CAST(s.v - u.q AS BIGINT)}) AS rest
        FROM (SELECT t.v AS n, unnest(g.units[t.v % 128 + 1], recursive := true)
              FROM run t JOIN page g ON g.no = t.v // 128 WHERE t.k = -1) u
        LEFT JOIN recurring.run s ON s.k = u.p
        GROUP BY n)
    ), refused AS MATERIALIZED (
      SELECT u.OrderID FROM unit u JOIN run r ON r.k = -1000 - u.n
    ), taken AS MATERIALIZED (
      SELECT DISTINCT OrderID FROM fit
      WHERE NOT mis AND OrderID NOT IN (SELECT OrderID FROM refused)
    ), sold AS (
      SELECT f.*, CAST(p.StockQuantity * 30 - sum(f.q) OVER (
               PARTITION BY f.ProductID ORDER BY f.RequestDate, f.OrderID) AS BIGINT) AS rest
      FROM fit f JOIN taken USING (OrderID) JOIN prod p ON p.ProductID = f.ProductID)"""


# Audit rows from ``moved`` (products before and after) and ``trail`` (other rows).
TRAIL = f"""
    SELECT *, 'loader' AS ChangedBy, 'tillwise' AS Application, {NOW} AS ChangedDate FROM (
      SELECT 'Product' AS TableName, 'UPDATE' AS Operation,
             CAST(ProductID AS VARCHAR) AS PrimaryKeyValue,
             'Price=' || Price || ', Stock=' || was AS OldValues,
             'Price=' || Price || ', Stock=' || now AS NewValues
      FROM moved WHERE was <> now
      UNION ALL
      SELECT 'Product', 'STOCK_ALERT', CAST(ProductID AS VARCHAR), 'Stock: ' || was,
             'Stock: ' || now || ' (Below Reorder Level: ' || ReorderLevel || ')'
      FROM moved WHERE was > ReorderLevel AND now <= ReorderLevel
      UNION ALL SELECT * FROM trail)"""
NO_TRAIL = """
    , trail AS (SELECT NULL AS a, NULL AS b, NULL AS c, NULL AS d, NULL AS e WHERE false)"""


def _recursive(head: str) -> str:
    return head.replace("WITH ", "WITH RECURSIVE ", 1)


def statements() -> dict[str, str]:
    asked = base("prod", "cust", "addr", "line") + REQUESTS
    tall = _recursive(base("prod", "line")) + ADJUSTMENTS.replace(
        "{stock}", "CAST(StockQuantity * 10 AS BIGINT)")
    ample = _recursive(base("prod", "line")) + ADJUSTMENTS.replace(
        "{stock}", "CAST(StockQuantity + 10000000 AS BIGINT)")
    closing = base("prod", "sale", "ret") + CLOSING
    added = _recursive(base("sale", "ret")) + ADDED_UP
    replay = _recursive(base("prod", "sale", "line")) + REPLAY
    turns = _recursive(base("prod", "cust", "addr", "line")) + REQUESTS + TURNS
    made = {
        "process_orders": turns + """
    , s AS (
      SELECT OrderID AS k, CAST(sum(Quantity * UnitPrice) AS DECIMAL(12,4)) AS v
      FROM good GROUP BY 1)
    SELECT e.OrderID, CASE WHEN t.OrderID IS NULL THEN 'Rejected' ELSE 'Pending' END AS OrderStatus,
           CASE WHEN t.OrderID IS NOT NULL
                THEN CAST(v + CAST(v * TaxRate AS DECIMAL(12,4)) + 5.99 - off AS DOUBLE) END
             AS TotalAmount,
           CASE WHEN t.OrderID IS NOT NULL THEN NULL
                WHEN nobody THEN 'Customer not found or inactive.'
                WHEN malformed THEN 'Malformed order items.'
                WHEN bare THEN 'Order has no items.'
                WHEN unknown THEN 'One or more products are invalid or inactive.'
                WHEN e.OrderID IN (SELECT OrderID FROM refused)
                THEN 'Insufficient inventory for one or more products.'
                WHEN no_ship THEN 'Invalid shipping address.'
                ELSE 'Invalid billing address.' END AS ErrorMessage
    FROM seen e LEFT JOIN taken t ON t.OrderID = e.OrderID LEFT JOIN s ON s.k = e.OrderID""",
        "process_orders_audit": turns + """
    , net AS (SELECT ProductID AS k, min(rest) AS v FROM sold GROUP BY 1
    ), moved AS (
      SELECT ProductID, Price, ReorderLevel, StockQuantity * 30 AS was, v AS now
      FROM prod JOIN net ON k = ProductID
    ), s AS (
      SELECT OrderID AS k, CAST(sum(Quantity * UnitPrice) AS DECIMAL(12,4)) AS v
      FROM good GROUP BY 1
    ), trail AS (
      SELECT 'Order', 'INSERT', CAST(OrderID AS VARCHAR), NULL,
             'CustomerID=' || CustomerID || ', TotalAmount='
             || CAST(v + CAST(v * TaxRate AS DECIMAL(12,4)) + 5.99 - off AS DECIMAL(12,4))
             || ', OrderStatus=Pending'
      FROM taken JOIN req USING (OrderID) JOIN s ON k = OrderID)""" + TRAIL,
        "apply_inventory_adjustments_audit": tall + """
    , net AS (SELECT s.ProductID AS k, sum(a.q) AS v
              FROM step s JOIN adj a ON a.AdjustmentID = s.AdjustmentID WHERE s.ok GROUP BY 1
    ), moved AS (
      SELECT ProductID, Price, ReorderLevel, StockQuantity * 10 AS was,
             CAST(StockQuantity * 10 + v AS BIGINT) AS now
      FROM prod JOIN net ON k = ProductID)""" + NO_TRAIL + TRAIL,
        "process_returns_audit": closing + """
    , net AS (SELECT ProductID AS k, sum(q) AS v FROM final
              WHERE ErrorMessage IS NULL AND RestockProduct GROUP BY 1
    ), moved AS (
      SELECT ProductID, Price, ReorderLevel, StockQuantity AS was,
             CAST(StockQuantity + v AS BIGINT) AS now
      FROM prod JOIN net ON k = ProductID
    ), trail AS (
      SELECT 'Order', 'UPDATE', CAST(OrderID AS VARCHAR),
             'OrderStatus=' || OrderStatus || ', TotalAmount=' || TotalAmount,
             'OrderStatus=Returned, TotalAmount=' || TotalAmount
      FROM sale WHERE OrderStatus <> 'Returned'
        AND OrderID IN (SELECT OrderID FROM final WHERE ClosesOrder))""" + TRAIL,
        "process_orders_ledger": turns + f"""
    SELECT ProductID, 'Sale' AS TransactionType, -CAST(q AS BIGINT) AS Quantity,
           CAST(rest + q AS BIGINT) AS PreviousStock, rest AS NewStock,
           CAST(OrderID AS VARCHAR) AS ReferenceID, 'Order' AS ReferenceType,
           {NOW} AS TransactionDate, 'loader' AS UserId,
           'Order processing - OrderID: ' || OrderID AS Notes
    FROM sold""",
        "process_orders_details": turns + f"""
    SELECT sha256('["' || OrderID || '","' || ItemNo || '"]') AS OrderDetailID, OrderID, ProductID,
           Quantity, CAST(UnitPrice AS DOUBLE) AS UnitPrice, CAST(0 AS DOUBLE) AS DiscountAmount,
           CAST(Quantity * UnitPrice AS DOUBLE) AS LineTotal, {NOW} AS CreatedDate
    FROM good WHERE OrderID IN (SELECT OrderID FROM taken)""",
        "process_orders_products": turns + f"""
    , net AS (SELECT ProductID AS k, min(rest) AS v FROM sold GROUP BY 1)
    SELECT ProductID, CAST(coalesce(v, StockQuantity * 30) AS INT) AS StockQuantity,
           CASE WHEN v IS NULL THEN ModifiedDate ELSE {NOW} END AS ModifiedDate
    FROM prod LEFT JOIN net ON k = ProductID""",
        "allocate_orders": replay + """
    SELECT u.OrderID, CASE WHEN r.k IS NULL THEN 'taken' ELSE 'refused' END AS Outcome
    FROM unit u LEFT JOIN run r ON r.k = -1000 - u.n""",
        "allocate_orders_products": replay + """
    SELECT k AS ProductID, v AS StockQuantity FROM run WHERE k >= 0""",
        "parse_order_items": asked + """
    SELECT OrderID, ItemNo, ProductID, Quantity, CAST(UnitPrice AS DOUBLE) AS UnitPrice, IsValid
    FROM good""",
        "validate_orders": asked + """
    , wanted AS (
      SELECT OrderID, ProductID, sum(Quantity) AS q, bool_and(IsValid) AS sound
      FROM good GROUP BY ALL
    ), flags AS (
      SELECT w.OrderID, bool_and(w.sound) AS sound, bool_or(p.ProductID IS NULL) AS unknown,
             bool_or(w.q > p.StockQuantity * 10) AS short
      FROM wanted w LEFT JOIN prod p ON p.ProductID = w.ProductID AND p.IsActive
      GROUP BY 1)
    SELECT r.OrderID,
           CASE WHEN NOT EXISTS (SELECT 1 FROM cust c
                                 WHERE c.CustomerID = r.CustomerID AND c.IsActive)
                THEN 'Customer not found or inactive.'
                WHEN NOT json_valid(r.items) OR NOT f.sound THEN 'Malformed order items.'
                WHEN f.OrderID IS NULL THEN 'Order has no items.'
                WHEN f.unknown THEN 'One or more products are invalid or inactive.'
                WHEN f.short THEN 'Insufficient inventory for one or more products.'
                WHEN r.ship IS NOT NULL AND NOT EXISTS (
                  SELECT 1 FROM addr a WHERE a.AddressID = r.ship
                    AND a.CustomerID = r.CustomerID AND a.IsActive)
                THEN 'Invalid shipping address.'
                WHEN r.bill IS NOT NULL AND NOT EXISTS (
                  SELECT 1 FROM addr a WHERE a.AddressID = r.bill
                    AND a.CustomerID = r.CustomerID AND a.IsActive)
                THEN 'Invalid billing address.' END AS ErrorMessage
    FROM req r LEFT JOIN flags f ON f.OrderID = r.OrderID""",
        "price_orders": asked + """
    , s AS (
      SELECT OrderID AS k, CAST(sum(Quantity * UnitPrice) AS DECIMAL(12,4)) AS v
      FROM good GROUP BY 1 HAVING bool_and(IsValid)
    ), t AS (
      SELECT r.*, v, CAST(v * TaxRate AS DECIMAL(12,4)) AS tax FROM req r JOIN s ON k = OrderID)
    SELECT OrderID, CAST(v AS DOUBLE) AS SubTotal, CAST(tax AS DOUBLE) AS TaxAmount,
           CAST(5.99 AS DOUBLE) AS ShippingAmount, CAST(off AS DOUBLE) AS DiscountAmount,
           CAST(v + tax + 5.99 - off AS DOUBLE) AS TotalAmount
    FROM t""",
        "apply_inventory_adjustments": tall + LEDGER_OF_STEPS,
        "apply_inventory_adjustments_ample": ample + LEDGER_OF_STEPS,
        "apply_inventory_adjustments_products": tall + f"""
    , net AS (SELECT s.ProductID AS k, sum(a.q) AS v
              FROM step s JOIN adj a ON a.AdjustmentID = s.AdjustmentID WHERE s.ok GROUP BY 1)
    SELECT ProductID, CAST(StockQuantity * 10 + coalesce(v, 0) AS INT) AS StockQuantity,
           CASE WHEN v IS NULL THEN ModifiedDate ELSE {NOW} END AS ModifiedDate
    FROM prod LEFT JOIN net ON k = ProductID""",
        "apply_inventory_adjustments_rejects": tall + """
    SELECT a.AdjustmentID, a.ProductID,
           CASE WHEN s.AdjustmentID IS NULL THEN 'Product not found or inactive.'
                ELSE 'Insufficient inventory. Current stock: ' || s.met END AS ErrorMessage
    FROM adj a LEFT JOIN step s ON s.AdjustmentID = a.AdjustmentID
    WHERE s.ok IS NOT TRUE""",
        "validate_returns": closing + """
    SELECT ReturnID, CustomerID, CAST(refund AS DOUBLE) AS RefundAmount, ErrorMessage, ClosesOrder
    FROM final""",
        "process_returns": closing + f"""
    SELECT ReturnID, OrderID, OrderDate, ProductID, CustomerID, q AS ReturnQuantity,
           CAST(refund AS DOUBLE) AS RefundAmount, ReturnReason, 'Processed' AS ReturnStatus,
           RestockProduct, {NOW} AS ProcessedDate, {NOW} AS CreatedDate, 'loader' AS CreatedBy
    FROM final WHERE ErrorMessage IS NULL""",
        "process_returns_ledger": closing + """
    SELECT f.ProductID, 'Return' AS TransactionType, f.q AS Quantity,
           CAST(p.StockQuantity + sum(f.q) OVER w - f.q AS BIGINT) AS PreviousStock,
           CAST(p.StockQuantity + sum(f.q) OVER w AS BIGINT) AS NewStock,
           f.ReturnID AS ReferenceID, 'Product return - ReturnID: ' || f.ReturnID AS Notes
    FROM final f JOIN prod p ON p.ProductID = f.ProductID
    WHERE f.ErrorMessage IS NULL AND f.RestockProduct
    WINDOW w AS (PARTITION BY f.ProductID ORDER BY f.RequestedAt, f.ReturnID
                 ROWS UNBOUNDED PRECEDING)""",
        "process_returns_products": closing + f"""
    , net AS (SELECT ProductID AS k, sum(q) AS v FROM final
              WHERE ErrorMessage IS NULL AND RestockProduct GROUP BY 1)
    SELECT ProductID, CAST(StockQuantity + coalesce(v, 0) AS INT) AS StockQuantity,
           CASE WHEN v IS NULL THEN ModifiedDate ELSE {NOW} END AS ModifiedDate
    FROM prod LEFT JOIN net ON k = ProductID""",
        "process_returns_orders": closing + f"""
    SELECT OrderID, CASE WHEN OrderID IN (SELECT OrderID FROM final WHERE ClosesOrder)
                         THEN 'Returned' ELSE OrderStatus END AS OrderStatus,
           CASE WHEN OrderID IN (SELECT OrderID FROM final WHERE ClosesOrder)
                THEN {NOW} ELSE OrderDate END AS ModifiedDate
    FROM sale""",
        "process_returns_corrected": added + """
    SELECT ReturnID, q AS ReturnQuantity, CAST(refund AS DOUBLE) AS RefundAmount FROM kept""",
        "process_returns_corrected_orders": added + f"""
    SELECT OrderID, CASE WHEN OrderID IN (SELECT OrderID FROM done) THEN 'Returned'
                         ELSE OrderStatus END AS OrderStatus,
           CASE WHEN OrderID IN (SELECT OrderID FROM done) THEN {NOW} ELSE OrderDate END
             AS ModifiedDate
    FROM sale""",
    }
    # The stored table is to be as the whole one rewritten.
    made["process_returns_merged"] = made["process_returns_orders"]
    return made
