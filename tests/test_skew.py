"""Work per key gives the same rows whether or not a key is split over tasks."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwise.plans import skew


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(6000):
        key = "hot" if i % 3 else rng.choice(["a", "b", "c", None])
        data.append((key, rng.randrange(40), i, rng.randrange(-9, 10)))
    return spark.createDataFrame(data, "k string, at int, id int, v int").repartition(7)


def expected(rows) -> pd.DataFrame:
    pdf = rows.toPandas()
    pdf["k"] = pdf["k"].fillna("~")
    pdf = pdf.sort_values(["k", "at", "id"], ascending=[True, False, True])
    group = pdf.groupby("k")
    pdf["nth"] = group.cumcount() + 1
    pdf["before"] = group["v"].cumsum() - pdf["v"]
    pdf["n"] = group["id"].transform("count")
    pdf["total"] = group["v"].transform("sum")
    return pdf.sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize("hot_rows", [10_000, 1500, 100, None])
def test_per_key(spark, rows, pieces, hot_rows):
    made = skew.per_key(
        rows, ["k"], [F.desc("at"), F.col("id")], rank="nth", before={"before": "v"}, count="n",
        totals={"total": "v"}, hot_rows=hot_rows).toPandas()
    made["k"] = made["k"].fillna("~")
    made = made.sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(
        made.astype({c: "int64" for c in ("nth", "before", "n", "total")}),
        expected(rows), check_dtype=False)


def test_hot_keys(spark, rows):
    assert skew.hot_keys(rows, ["k"], hot_rows=10_000) is None
    assert [r.k for r in skew.hot_keys(rows, ["k"], hot_rows=1500).collect()] == ["hot"]
    assert {r.k for r in skew.hot_keys(rows, ["k"], hot_rows=100).collect()} == {
        "hot", "a", "b", "c", None}


def test_hot_rows_are_spread(spark, rows, pieces):
    """No task holds the hot key's rows alone."""
    hot = rows.where("k = 'hot'")
    split = skew._piecewise(hot, 4, ["k"], [F.col("id")], "nth", {}, None, {})
    assert split.count() == hot.count()
    sizes = [r["count"] for r in skew._in_order(hot, ["k"], [F.col("id")], 4).groupBy("_piece").count().collect()]
    assert len(sizes) > 2 and max(sizes) < hot.count() / 2


def test_numbered(spark, rows):
    made = skew.numbered(rows, [F.desc("at"), F.col("id")], "nth", piece_rows=900).toPandas().sort_values("nth")
    assert made["nth"].tolist() == list(range(1, len(made) + 1))
    assert made.sort_values(["at", "id"], ascending=[False, True])["nth"].is_monotonic_increasing
    assert skew.numbered(rows.limit(0), [F.col("id")], "nth").count() == 0


def test_history_and_ledger_with_split_customers(spark, pieces):
    """Every customer and product big enough to be split: the rows stay the same."""
    from tillwise.operators.views import customer_order_history
    from tillwise.sources.star import star_store

    store = star_store(spark, "/root/testdata/sf0.001")
    orders = store.scan("sales_order").withColumn(
        "CustomerID", F.when(F.col("OrderID") % 3 == 0, 7).otherwise(F.col("CustomerID")))
    store = store.replacing(sales_order=orders)
    whole = customer_order_history(store)
    split = customer_order_history(store, hot_rows=40)
    assert whole.exceptAll(split).count() == 0
    assert whole.count() == split.count() > 0
