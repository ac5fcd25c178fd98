from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tillwise import model
from tillwise.functions.clock import days_between, months_between, ts, years_before
from tillwise.functions.delivery import add_business_days, with_delivery_estimate
from tillwise.functions.pricing import discount_rate, with_shipping_cost


def test_shipping_cost(spark):
    rows = [("1", "LOCAL", "Economy", "3.19"), ("2.5", "NATIONAL", "Standard", "10.23"),
            ("10", "INTERNATIONAL", "Overnight", "174.76"), ("100", "NATIONAL", "Express", "99.99"),
            ("0", "X", "Y", "5.99"), (None, "NATIONAL", "Standard", "7.79"),
            ("100", None, "Express", "260.49"), ("1", None, None, "5.99")]
    df = spark.createDataFrame(
        [(Decimal(w) if w else None, z, m, c) for w, z, m, c in rows],
        "Weight decimal(8,2), Zone string, ShippingMethod string, want string")
    for row in with_shipping_cost(df).collect():
        assert row.ShippingCost == Decimal(row.want), row


def business_days(start: datetime, days: int) -> datetime:
    at = start
    while days:
        at += timedelta(days=1)
        days -= at.weekday() < 5
    return at


def test_business_days_against_calendar(spark):
    start = datetime(2023, 12, 25, 9, 30)
    cases = [(start + timedelta(days=d, hours=d % 24), n, business_days(
        start + timedelta(days=d, hours=d % 24), n)) for d in range(60) for n in range(1, 18)]
    df = spark.createDataFrame(cases, "at timestamp_ntz, n int, want timestamp_ntz")
    assert df.where(add_business_days(F.col("at"), F.col("n")) != F.col("want")).count() == 0


def test_delivery_estimate(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 5), "Overnight", "LOCAL", datetime(2024, 1, 8)),
         (datetime(2024, 1, 6), "Standard", "LOCAL", datetime(2024, 1, 12)),
         (datetime(2024, 1, 1), "Economy", "INTERNATIONAL", datetime(2024, 1, 17)),
         (datetime(2024, 1, 1), None, None, datetime(2024, 1, 9)),
         (None, "Express", "LOCAL", None)],
        "OrderDate timestamp_ntz, ShippingMethod string, Zone string, want timestamp_ntz")
    made = with_delivery_estimate(df)
    assert made.where(~F.col("EstimatedDelivery").eqNullSafe(F.col("want"))).count() == 0


def test_discount_rate(spark):
    rows = [("Platinum", 10, True, "0.23"), ("Gold", 5, False, "0.12"), ("Silver", 4, False, "0.05"),
            ("Bronze", 1, None, "0.00"), (None, 12, True, "0.08")]
    df = spark.createDataFrame(rows, "tier string, n int, promo boolean, want string")
    made = df.withColumn("rate", discount_rate(F.col("tier"), F.col("n"), F.col("promo")))
    for row in made.collect():
        assert row.rate == Decimal(row.want), row


def test_boundary_counts(spark):
    row = spark.range(1).select(
        days_between(ts(datetime(2024, 1, 1, 23, 59)), ts(datetime(2024, 1, 2))).alias("d"),
        months_between(ts(datetime(2024, 1, 31)), ts(datetime(2024, 2, 1))).alias("m"),
        years_before(datetime(2024, 2, 29, 8), 1).alias("y"),
    ).first()
    assert (row.d, row.m, row.y) == (1, 1, datetime(2023, 2, 28, 8))


def test_model_is_consistent(spark):
    for table in model.TABLES:
        names = set(model.schema(table).names)
        assert set(model.PRIMARY_KEYS[table]) <= names
        assert set(model.REQUIRED[table]) <= names
        assert set(model.DEFAULTS[table]) <= names
        empty = spark.createDataFrame([], model.schema(table))
        for rule in model.CHECKS.get(table, {}).values():
            empty.where(rule).count()
