"""Parameterised sales and stock reports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.clock import days_before, ts
from tillwise.functions.values import mean, not_cancelled, or_zero, stock_label
from tillwise.store import Store

REPORT_DAYS = 30
NO_SALES_DAYS = 999.0


def _period(as_of: datetime, start: datetime | None, end: datetime | None):
    start = as_of - timedelta(days=REPORT_DAYS) if start is None else start
    end = as_of if end is None else end
    if start > end:
        raise ValueError("Start date cannot be greater than end date.")
    return start, end


def _orders(store: Store, start: datetime, end: datetime, *columns: str) -> DataFrame:
    """Orders placed from ``start`` to ``end``, both included, and not cancelled."""
    wanted = list(dict.fromkeys([*columns, "OrderDate", "OrderStatus"]))
    return (
        store.scan("sales_order", *wanted)
        .where(F.col("OrderDate").between(ts(start), ts(end)))
        .where(not_cancelled(F.col("OrderStatus")))
        .select(*columns)
    )


def sales_report_summary(
    store: Store, *, as_of: datetime, start: datetime | None = None,
    end: datetime | None = None, corrected: bool = False,
) -> DataFrame:
    """One row of totals.

    Amounts of an order count once per line of it, and its average weighs by
    lines; ``corrected`` counts every order once.
    """
    start, end = _period(as_of, start, end)
    amounts = ["TotalAmount", "SubTotal", "TaxAmount", "ShippingAmount", "DiscountAmount"]
    # Grouping on the join key right after the join costs no further shuffle.
    per_order = (
        _orders(store, start, end, "OrderID", "CustomerID", *amounts)
        .join(store.scan("order_detail", "OrderID", "Quantity"), "OrderID")
        .groupBy("OrderID", "CustomerID", *amounts)
        .agg(F.count("*").alias("Lines"), F.sum("Quantity").alias("Items"))
    )
    times = F.lit(1) if corrected else F.col("Lines")

    def total(column: str) -> Column:
        return F.sum(F.col(column) * times.cast("decimal(10,0)"))

    return per_order.agg(
        F.lit("Sales Summary").alias("ReportType"),
        ts(start).alias("StartDate"),
        ts(end).alias("EndDate"),
        F.count("*").alias("TotalOrders"),
        F.countDistinct("CustomerID").alias("UniqueCustomers"),
        total("TotalAmount").alias("TotalRevenue"),
        total("SubTotal").alias("TotalSubTotal"),
        total("TaxAmount").alias("TotalTax"),
        total("ShippingAmount").alias("TotalShipping"),
        total("DiscountAmount").alias("TotalDiscounts"),
        (total("TotalAmount").cast("double") / F.nullif(F.sum(times), F.lit(0)))
        .alias("AverageOrderValue"),
        F.sum("Items").alias("TotalItemsSold"),
    )


def _sold_lines(store: Store, start: datetime, end: datetime) -> DataFrame:
    """Sales of the period by order and product.

    The grouping contains the join key, so it needs no shuffle of its own.
    """
    return (
        _orders(store, start, end, "OrderID", "OrderDate")
        .join(
            store.scan(
                "order_detail", "OrderID", "ProductID", "Quantity", "UnitPrice", "LineTotal"),
            "OrderID",
        )
        .groupBy("OrderID", "ProductID")
        .agg(
            F.sum("Quantity").alias("Quantity"),
            F.sum("LineTotal").alias("Revenue"),
            F.sum("UnitPrice").alias("Prices"),
            F.count("*").alias("Lines"),
            F.min("OrderDate").alias("OrderDate"),
        )
    )


def _sales_columns(average: str) -> list[Column]:
    return [
        F.sum("Quantity").alias("QuantitySold"),
        F.sum("Revenue").alias("TotalRevenue"),
        (F.sum("Prices").cast("double") / F.sum("Lines")).alias(average),
        F.min("OrderDate").alias("FirstSaleDate"),
        F.max("OrderDate").alias("LastSaleDate"),
    ]


def revenue_by_category(
    store: Store, *, as_of: datetime, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Quantity and revenue of each category that sold in the period."""
    return (
        _sold_lines(store, *_period(as_of, start, end))
        .join(store.scan("product", "ProductID", "CategoryID"), "ProductID")
        .groupBy("CategoryID")
        .agg(F.sum("Quantity").alias("QuantitySold"), F.sum("Revenue").alias("TotalRevenue"))
    )


def sales_report_category(
    store: Store, *, as_of: datetime, start: datetime | None = None,
    end: datetime | None = None, category_id: int | None = None,
) -> DataFrame:
    """Sales per category, highest revenue first."""
    start, end = _period(as_of, start, end)
    products = store.scan("product", "ProductID", "CategoryID")
    categories = store.scan("category", "CategoryID", "CategoryName", "CategoryDescription")
    if category_id is not None:
        products = products.where(F.col("CategoryID") == category_id)
        categories = categories.where(F.col("CategoryID") == category_id)
    sales = (
        _sold_lines(store, start, end)
        .join(products, "ProductID")
        .groupBy("CategoryID")
        .agg(
            F.countDistinct("OrderID").alias("OrderCount"),
            F.countDistinct("ProductID").alias("ProductsInCategory"),
            *_sales_columns("AveragePrice"),
        )
    )
    return (
        sales.join(categories, "CategoryID")
        .select(
            "CategoryID", "CategoryName", "CategoryDescription", "OrderCount", "QuantitySold",
            "TotalRevenue", "AveragePrice", "ProductsInCategory", "FirstSaleDate", "LastSaleDate",
        )
        .orderBy(F.desc("TotalRevenue"), "CategoryID")
    )


def sales_report_product(
    store: Store, *, as_of: datetime, start: datetime | None = None,
    end: datetime | None = None, category_id: int | None = None, product_id=None,
) -> DataFrame:
    """Sales per product, highest revenue first.

    A product without stock is reported as low, since low is tested first.
    """
    start, end = _period(as_of, start, end)
    products = store.scan(
        "product", "ProductID", "ProductName", "ProductSKU", "CategoryID", "Price",
        "StockQuantity", "ReorderLevel",
    )
    if category_id is not None:
        products = products.where(F.col("CategoryID") == category_id)
    lines = _sold_lines(store, start, end)
    if product_id is not None:
        products = products.where(F.col("ProductID") == product_id)
        lines = lines.where(F.col("ProductID") == product_id)
    # One row per order and product, so counting rows counts orders.
    sales = lines.groupBy("ProductID").agg(
        F.count("*").alias("OrderCount"), *_sales_columns("AverageSoldPrice")
    )
    stock, level = F.col("StockQuantity"), F.col("ReorderLevel")
    return (
        sales.join(products, "ProductID")
        .join(store.scan("category", "CategoryID", "CategoryName"), "CategoryID")
        .select(
            "ProductID", "ProductName", "ProductSKU", "CategoryName",
            F.col("Price").alias("CurrentPrice"), "AverageSoldPrice", "QuantitySold",
            "TotalRevenue", "OrderCount", stock.alias("CurrentStock"),
            F.when(stock <= level, "Low Stock").when(stock == 0, "Out of Stock")
            .otherwise("In Stock").alias("StockStatus"),
            "FirstSaleDate", "LastSaleDate",
        )
        .orderBy(F.desc("TotalRevenue"), "ProductID")
    )


def sales_report_monthly(
    store: Store, *, as_of: datetime, start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Orders, revenue and customers per month, oldest first."""
    start, end = _period(as_of, start, end)
    month = F.date_trunc("month", F.col("OrderDate"))
    return (
        _orders(store, start, end, "OrderID", "CustomerID", "OrderDate", "TotalAmount")
        .groupBy(month.alias("Month"))
        .agg(
            F.count("*").alias("MonthlyOrders"),
            F.sum("TotalAmount").alias("MonthlyRevenue"),
            mean(F.col("TotalAmount")).alias("MonthlyAOV"),
            F.countDistinct("CustomerID").alias("MonthlyCustomers"),
        )
        .orderBy("Month")
        .select(
            F.lit("Performance Metrics").alias("MetricType"),
            F.date_format("Month", "MMMM yyyy").alias("Period"),
            "MonthlyOrders", "MonthlyRevenue", "MonthlyAOV", "MonthlyCustomers",
        )
    )


def sales_report(
    store: Store, report_type: str = "Summary", *, as_of: datetime,
    start: datetime | None = None, end: datetime | None = None,
    category_id: int | None = None, product_id=None,
) -> dict[str, DataFrame]:
    """The result sets of one report type; none for a type nobody knows."""
    start, end = _period(as_of, start, end)
    span = {"as_of": as_of, "start": start, "end": end}
    made: dict[str, DataFrame] = {}
    if report_type == "Summary":
        made["summary"] = sales_report_summary(store, **span)
    if report_type in ("Category", "Detailed"):
        made["category"] = sales_report_category(store, category_id=category_id, **span)
    if report_type in ("Product", "Detailed"):
        made["product"] = sales_report_product(
            store, category_id=category_id, product_id=product_id, **span)
    if report_type == "Detailed":
        made["monthly"] = sales_report_monthly(store, **span)
    return made


def low_stock_products(
    store: Store, *, as_of: datetime, category_id: int | None = None,
    include_out_of_stock: bool = True,
) -> DataFrame:
    """Active products at or below their reorder level, most urgent first."""
    stock, level = F.col("StockQuantity"), F.col("ReorderLevel")
    low = store.scan(
        "product", "ProductID", "ProductName", "ProductSKU", "CategoryID", "StockQuantity",
        "ReorderLevel", "Price", "IsActive", "ModifiedDate",
    ).where(F.col("IsActive") & (stock <= level))
    if not include_out_of_stock:
        low = low.where(stock > 0)
    if category_id is not None:
        low = low.where(F.col("CategoryID") == category_id)
    recent = (
        store.scan("sales_order", "OrderID", "OrderDate", "OrderStatus")
        .where(F.col("OrderDate") >= days_before(as_of, REPORT_DAYS))
        .where(not_cancelled(F.col("OrderStatus")))
        .select("OrderID")
    )
    sales = (
        store.scan("order_detail", "OrderID", "ProductID", "Quantity")
        .join(recent, "OrderID")
        .groupBy("ProductID").agg(F.sum("Quantity").alias("Sold"))
    )
    sold = or_zero(F.col("Sold"))
    return (
        low.join(store.scan("category", "CategoryID", "CategoryName"), "CategoryID")
        .join(sales, "ProductID", "left")
        .select(
            "ProductID", "ProductName", "ProductSKU", "CategoryName", "StockQuantity",
            "ReorderLevel", "Price",
            stock_label(("Out of Stock", "Low Stock", "In Stock")).alias("StockStatus"),
            (level - stock).alias("SuggestedOrderQuantity"),
            F.col("ModifiedDate").alias("LastStockUpdate"),
            sold.alias("QuantitySoldLast30Days"),
            F.when(sold > 0, stock.cast("double") / (sold.cast("double") / 30.0))
            .otherwise(F.lit(NO_SALES_DAYS)).alias("DaysOfInventoryRemaining"),
        )
        .orderBy(F.when(stock == 0, 0).otherwise(1), "DaysOfInventoryRemaining",
                 "StockQuantity", "ProductID")
    )
