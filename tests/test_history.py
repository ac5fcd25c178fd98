"""Ranks of the order history, and what it moves."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from tillwise.operators import views
from tillwise.sources.star import star_store


@pytest.fixture(scope="module")
def store(spark):
    """A tenth of the lines have a product that is not there."""
    shop = star_store(spark, "/root/testdata/sf0.001")
    lines = shop.scan("order_detail").withColumn(
        "ProductID", F.expr("CASE WHEN Quantity % 10 = 3 THEN -1 ELSE ProductID END"))
    return shop.replacing(order_detail=lines)


@pytest.mark.parametrize("hot_rows", [1_000_000, 40])
def test_ranks_run_over_the_lines_shown(store, pieces, hot_rows):
    rows = views.customer_order_history(store, hot_rows=hot_rows).select(
        "CustomerID", "OrderDate", "OrderID", "OrderDetailID", "TotalAmount", "OrderRank",
        "CustomerTotalOrders", "CustomerTotalSpent").collect()
    of: dict[int, list] = {}
    for row in rows:
        of.setdefault(row.CustomerID, []).append(row)
    assert len(of) > 100
    for shown in of.values():
        shown.sort(key=lambda r: (-r.OrderDate.timestamp(), r.OrderID, r.OrderDetailID))
        assert [r.OrderRank for r in shown] == list(range(1, len(shown) + 1))
        assert {r.CustomerTotalOrders for r in shown} == {len(shown)}
        assert {r.CustomerTotalSpent for r in shown} == {sum(r.TotalAmount for r in shown)}


def test_lines_are_not_moved_by_customer(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with contextlib.redirect_stdout(io.StringIO()) as told:
            views.customer_order_history(store).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", told.getvalue())]
    # Orders and customers.
    assert keys.count("CustomerID") == 2
