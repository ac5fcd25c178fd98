"""The SQL surface says what the operators say."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tillwise import sql
from tillwise.catalog import method_of, zone_of
from tillwise.functions.delivery import delivery_estimate
from tillwise.functions.pricing import customer_tiers, shipping_cost, with_product_discount
from tillwise.operators import summaries
from tillwise.sources.star import AS_OF, star_store

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def store(spark):
    made = star_store(spark, SF_DIR)
    sql.register(made, as_of=AS_OF, recommendations=True)
    return made


def test_row_functions(spark, store):
    rows = spark.range(600).select(
        (F.col("id") * F.lit(0.35)).cast("decimal(8,2)").alias("w"),
        zone_of(F.col("id")).alias("z"), method_of(F.col("id")).alias("m"),
        (F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")
         + F.make_dt_interval((F.col("id") % 30).cast("int"))).alias("d"),
    )
    rows.createOrReplaceTempView("cases")
    made = spark.sql("SELECT *, shipping_cost(w, z, m) AS c, delivery_estimate(d, m, z) AS e"
                     " FROM cases")
    off = made.where(
        (F.col("c") != shipping_cost(F.col("w"), F.col("z"), F.col("m")))
        | (F.col("e") != delivery_estimate(F.col("d"), F.col("m"), F.col("z"))))
    assert made.count() == 600 and off.count() == 0


def test_lookup_functions(spark, store):
    made = spark.sql("SELECT CustomerID, customer_tier(CustomerID) AS CustomerTier FROM customer")
    want = customer_tiers(store).select("CustomerID", "CustomerTier")
    assert made.exceptAll(want).count() == 0 and made.count() == want.count()
    sold = spark.sql("SELECT o.CustomerID, d.ProductID, d.Quantity, d.UnitPrice"
                     " FROM order_detail d JOIN sales_order o ON o.OrderID = d.OrderID")
    sold.createOrReplaceTempView("sold")
    made = spark.sql("SELECT *, product_discount(CustomerID, ProductID, Quantity, UnitPrice)"
                     " AS DiscountAmount FROM sold")
    assert made.exceptAll(with_product_discount(store, sold)).count() == 0


def test_sample_queries(spark, store):
    name = "Customer#000000007"
    made = spark.sql(f"SELECT * FROM customer_order_history WHERE CustomerName = '{name}'")
    want = summaries.history_by_customer_name(store, name)
    assert made.count() == want.count() > 0 and made.exceptAll(want).count() == 0
    made = spark.sql("SELECT * FROM product_performance WHERE StockStatus = 'Low Stock'")
    assert made.count() == summaries.products_with_status(store, "Low Stock", as_of=AS_OF).count()
    assert spark.sql("SELECT * FROM sales_performance_dashboard").count() == 1
    made = spark.sql(
        "SELECT * FROM recommendations_for((SELECT max(CustomerID) FROM customer"
        f" WHERE CustomerName = '{name}'), 3)")
    want = summaries.recommendations_by_customer_name(
        store, name, as_of=AS_OF, max_recommendations=3)
    assert made.exceptAll(want).count() == 0 and made.count() == want.count()
