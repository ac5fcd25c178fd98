"""Delivery estimate in business days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise import model
from tillwise.functions.clock import plus_days
from tillwise.functions.values import lookup


def add_business_days(start: Column, days: Column) -> Column:
    """``days`` Mondays to Fridays after ``start``, at the same time of day.

    A weekend start counts as the Friday before; from there each full week of
    five business days spans seven.
    """
    weekday = F.weekday(start)
    into_week = F.least(weekday, F.lit(4))
    back = weekday - into_week
    weekends = F.floor((into_week + days) / 5).cast("int")
    shift = F.when(days > 0, days - back + weekends * 2).otherwise(0)
    return plus_days(start, shift.cast("int"))


def delivery_estimate(order_date: Column, method: Column, zone: Column) -> Column:
    days = lookup(
        method, {k: F.lit(v) for k, v in model.METHOD_DAYS.items()},
        F.lit(model.OTHER_METHOD_DAYS),
    ) + lookup(
        zone, {k: F.lit(v) for k, v in model.ZONE_DAYS.items()}, F.lit(model.OTHER_ZONE_DAYS)
    )
    return add_business_days(order_date, days)


def with_delivery_estimate(
    df: DataFrame, order_date: str = "OrderDate", method: str = "ShippingMethod",
    zone: str = "Zone",
) -> DataFrame:
    return df.withColumn(
        "EstimatedDelivery", delivery_estimate(F.col(order_date), F.col(method), F.col(zone))
    )
