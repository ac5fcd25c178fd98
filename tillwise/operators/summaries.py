"""Short listings over the tables, and filtered reads of the views."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.clock import ts
from tillwise.functions.values import stock_label
from tillwise.operators.recommend import product_recommendations
from tillwise.operators.views import customer_order_history, product_performance
from tillwise.store import Store

# The labels of the table counts.
COUNT_LABELS = {
    "category": "Categories",
    "product": "Products",
    "customer": "Customers",
    "sales_order": "Orders",
    "order_detail": "Order Details",
    "inventory_transaction": "Inventory Transactions",
    "product_return": "Product Returns",
    "shipping_address": "Shipping Addresses",
    "billing_address": "Billing Addresses",
    "audit_log": "Audit Log Entries",
}
# Days since the last login, by rank of customer age.
LOGIN_BANDS = (((1, 3), 1), ((4, 6), 7), ((7, 8), 30))
LAST_BAND = max(top for (_, top), _ in LOGIN_BANDS)


def table_counts(store: Store) -> DataFrame:
    """Rows of every table the store holds."""
    counts = [
        store.count(name).select(F.lit(label).alias("DataType"), "RecordCount")
        for name, label in COUNT_LABELS.items() if name in store
    ]
    return reduce(DataFrame.unionByName, counts).orderBy("DataType")


def orders_by_status(store: Store) -> DataFrame:
    return (
        store.scan("sales_order", "OrderStatus", "TotalAmount")
        .groupBy("OrderStatus")
        .agg(F.count("*").alias("OrderCount"), F.sum("TotalAmount").alias("TotalValue"))
        .orderBy(F.desc("OrderCount"), "OrderStatus")
    )


def products_by_category(store: Store) -> DataFrame:
    """Products, average price and stock per subcategory name, also empty ones."""
    groups = store.scan("category", "CategoryID", "CategoryName", "ParentCategoryID").where(
        F.col("ParentCategoryID").isNotNull())
    # Summed up by category key first, so the join meets one row per category.
    goods = store.scan("product", "CategoryID", "Price", "StockQuantity").groupBy(
        "CategoryID").agg(
        F.count("*").alias("Products"), F.sum("Price").alias("Prices"),
        F.count("Price").alias("Priced"), F.sum("StockQuantity").alias("Stock"))
    return (
        groups.join(goods, "CategoryID", "left")
        .groupBy("CategoryName")
        .agg(
            F.coalesce(F.sum("Products"), F.lit(0)).alias("ProductCount"),
            (F.sum("Prices").cast("double") / F.nullif(F.sum("Priced"), F.lit(0)))
            .alias("AvgPrice"),
            F.sum("Stock").alias("TotalStock"),
        )
        .orderBy(F.desc("ProductCount"), "CategoryName")
    )


def low_stock_list(store: Store) -> DataFrame:
    """Products at or below their reorder level, inactive ones too."""
    return (
        store.scan("product", "ProductName", "ProductSKU", "StockQuantity", "ReorderLevel")
        .where(F.col("StockQuantity") <= F.col("ReorderLevel"))
        .withColumn("Status", stock_label(("OUT OF STOCK", "LOW STOCK", "OK")))
        .orderBy("StockQuantity", "ProductSKU")
    )


def update_last_login(store: Store, *, as_of: datetime) -> DataFrame:
    """Customers with the login date of the eldest ones set by their rank.

    Ranks go no further than the last band, so only that many customers are
    sorted out and numbered.
    """
    eldest = (
        store.scan("customer", "CustomerID", "CreatedDate")
        .orderBy("CreatedDate", "CustomerID").limit(LAST_BAND)
        .withColumn("Rank", F.row_number().over(Window.orderBy("CreatedDate", "CustomerID")))
    )
    login = None
    for (low, high), days in LOGIN_BANDS:
        hit, at = F.col("Rank").between(low, high), ts(as_of - timedelta(days=days))
        login = F.when(hit, at) if login is None else login.when(hit, at)
    customers = store.scan("customer")
    return customers.join(
        F.broadcast(eldest.select("CustomerID", login.alias("NewLogin"))), "CustomerID", "left"
    ).withColumn("LastLoginDate", F.coalesce("NewLogin", "LastLoginDate")).select(
        *customers.columns)


def history_by_customer_name(store: Store, name: str) -> DataFrame:
    """Order history of the customers of that name.

    The name is looked up before the history is built, so only those
    customers' orders are joined.
    """
    named = store.scan("customer").where(F.col("CustomerName") == name)
    orders = store.scan("sales_order").join(named.select("CustomerID"), "CustomerID", "left_semi")
    return customer_order_history(store.replacing(customer=named, sales_order=orders))


def products_with_status(store: Store, status: str, *, as_of: datetime) -> DataFrame:
    return product_performance(store, as_of=as_of).where(F.col("StockStatus") == status)


def recommendations_by_customer_name(
    store: Store, name: str, *, as_of: datetime, max_recommendations: int = 5
) -> DataFrame:
    named = store.scan("customer", "CustomerID", "CustomerName").where(
        F.col("CustomerName") == name)
    return product_recommendations(
        store, as_of=as_of, max_recommendations=max_recommendations,
        customers=named.select("CustomerID"),
    )

