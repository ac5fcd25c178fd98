"""Products to recommend to each customer."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.values import not_cancelled, or_zero
from tillwise.operators.views import product_sales
from tillwise.plans.skew import HOT_ROWS, per_key
from tillwise.session import cut_lineage
from tillwise.store import Store


def product_recommendations(
    store: Store, *, as_of: datetime, max_recommendations: int = 5,
    customers: DataFrame | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The best products each customer has not bought, from categories they buy in.

    Categories rank by products bought in them times products they hold, then
    products by units sold and key. ``customers`` (one CustomerID column)
    narrows the customers.

    Within a category everyone's candidates follow one shared ranking. A
    purchase at rank r that is the customer's i-th leaves r - i better products
    unbought, so the first N candidates are read off the gaps between
    purchases: at most N rows per customer and category, never the category.
    """
    wanted = max_recommendations
    orders = (
        store.scan("sales_order", "OrderID", "CustomerID", "OrderStatus")
        .where(not_cancelled(F.col("OrderStatus"))).select("OrderID", "CustomerID")
    )
    if customers is not None:
        orders = orders.join(customers.select("CustomerID").distinct(), "CustomerID", "left_semi")
    products = store.scan(
        "product", "ProductID", "ProductName", "ProductSKU", "CategoryID", "Price",
        "StockQuantity", "IsActive",
    )
    categories = store.scan("category", "CategoryID", "CategoryName")
    sales = product_sales(store, as_of=as_of).select(
        "ProductID", "TotalQuantitySold", "AverageSellingPrice")

    # Eligible products, ranked inside their category.
    eligible = (
        products.where(F.col("IsActive") & (F.col("StockQuantity") > 0))
        .join(categories, "CategoryID")
        .join(sales, "ProductID", "left")
        .withColumn("TotalQuantitySold", or_zero(F.col("TotalQuantitySold")))
        .withColumn(
            "AverageSellingPrice",
            F.coalesce("AverageSellingPrice", F.col("Price").cast("double")))
    )
    # The ranking and the purchases are each read several times below: written once.
    ranked = cut_lineage(per_key(
        eligible, ["CategoryID"], [F.desc("TotalQuantitySold"), F.col("ProductID")],
        rank="Place", count="Candidates", probe=products.select("CategoryID"),
        hot_rows=hot_rows,
    ))
    sizes = products.groupBy("CategoryID").agg(F.count("*").alias("Products")).join(
        ranked.groupBy("CategoryID").agg(F.max("Candidates").alias("Candidates")), "CategoryID"
    )

    bought = cut_lineage(
        store.scan("order_detail", "OrderID", "ProductID").join(orders, "OrderID")
        .select("CustomerID", "ProductID").distinct()
        .join(products.select("ProductID", "CategoryID"), "ProductID")
        .join(ranked.select("ProductID", "Place"), "ProductID", "left")
    )
    # Per customer and category: score, and how many candidates are left.
    scored = (
        bought.groupBy("CustomerID", "CategoryID")
        .agg(F.count("*").alias("Bought"), F.count("Place").alias("BoughtPlaces"))
        .join(sizes, "CategoryID")
        .withColumn("PopularityScore", F.col("Bought") * F.col("Products"))
        .withColumn("Left", F.least(F.col("Candidates") - F.col("BoughtPlaces"), F.lit(wanted)))
        .where(F.col("Left") > 0)
    )
    # A category matters only while better-scored ones hold fewer than N.
    better = Window.partitionBy("CustomerID").orderBy(F.desc("PopularityScore"))
    useful = cut_lineage(
        scored.withColumn(
            "Ahead", F.sum("Left").over(better.rangeBetween(Window.unboundedPreceding, 0)))
        .withColumn("Same", F.sum("Left").over(
            Window.partitionBy("CustomerID", "PopularityScore")))
        .where(F.col("Ahead") - F.col("Same") < wanted)
        .select("CustomerID", "CategoryID", "PopularityScore", "Candidates")
    )

    # Purchases in rank order split the ranking into gaps.
    placed = per_key(
        bought.where(F.col("Place").isNotNull())
        .join(useful.select("CustomerID", "CategoryID"), ["CustomerID", "CategoryID"],
              "left_semi")
        .select("CustomerID", "CategoryID", "Place"),
        ["CustomerID", "CategoryID"], [F.col("Place")], rank="Nth", hot_rows=hot_rows,
        probe=bought.select("CustomerID", "CategoryID"),
    ).withColumn("Passed", F.col("Place") - F.col("Nth"))
    # Purchases with as many unbought products before them share one gap end;
    # the gap after them starts behind the last.
    starts = (
        placed.where(F.col("Passed") < wanted)
        .groupBy("CustomerID", "CategoryID", "Passed").agg(F.max("Place").alias("After"))
        .unionByName(useful.select(
            "CustomerID", "CategoryID", F.lit(0).cast("long").alias("Passed"),
            F.lit(0).cast("long").alias("After")))
        .groupBy("CustomerID", "CategoryID", "Passed").agg(F.max("After").alias("After"))
    )
    # Up to N starts per customer and category.
    ends = Window.partitionBy("CustomerID", "CategoryID").orderBy("Passed")
    gaps = starts.withColumn(
        "Until", F.coalesce(F.lead("Passed").over(ends), F.lit(wanted).cast("long")))
    candidates = (
        gaps.withColumn("Step", F.explode(F.sequence(F.lit(1), F.col("Until") - F.col("Passed"))))
        .select("CustomerID", "CategoryID", (F.col("After") + F.col("Step")).alias("Place"))
        .join(useful, ["CustomerID", "CategoryID"])
        .where(F.col("Place") <= F.col("Candidates"))
        .drop("Candidates")
    )
    best = Window.partitionBy("CustomerID").orderBy(
        F.desc("PopularityScore"), F.desc("TotalQuantitySold"), "ProductID")
    return (
        candidates.join(ranked.drop("Candidates", "IsActive", "StockQuantity"),
                        ["CategoryID", "Place"])
        .withColumn("RecommendationRank", F.row_number().over(best))
        .where(F.col("RecommendationRank") <= wanted)
        .select("CustomerID", "ProductID", "ProductName", "ProductSKU", "Price", "CategoryName",
                "TotalQuantitySold", "AverageSellingPrice", "PopularityScore",
                "RecommendationRank")
    )
