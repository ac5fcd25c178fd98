"""Shipping cost, customer tier and product discount."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise import model
from tillwise.functions.values import lookup, money, not_cancelled, or_zero
from tillwise.store import Store

RATE = "decimal(8,2)"


def _rates(key: Column, rates: dict[str, str], other: str) -> Column:
    return lookup(key, {k: F.lit(Decimal(v)) for k, v in rates.items()}, F.lit(Decimal(other)))


def shipping_cost(weight: Column, zone: Column, method: Column) -> Column:
    """Cost of a parcel of ``weight`` pounds, rounded to cents after each step."""
    factor = _rates(zone, model.ZONE_FACTORS, model.OTHER_ZONE_FACTOR).cast(RATE)
    base = (_rates(method, model.BASE_RATES, model.OTHER_BASE_RATE).cast(RATE) * factor).cast(RATE)
    pound = _rates(method, model.POUND_RATES, model.OTHER_POUND_RATE).cast(RATE)
    extra = weight.cast(RATE) - F.lit(Decimal("1.00"))
    cost = F.when(extra > 0, (base + extra * pound * factor).cast(RATE)).otherwise(base)
    floored = F.greatest(cost, F.lit(Decimal(model.SHIPPING_FLOOR)).cast(RATE))
    # An unknown zone is neither domestic nor not, and so is never capped.
    domestic = zone != model.UNCAPPED_ZONE
    cap = F.lit(Decimal(model.SHIPPING_CAP)).cast(RATE)
    return F.when(domestic, F.least(floored, cap)).otherwise(floored)


def with_shipping_cost(
    df: DataFrame, weight: str = "Weight", zone: str = "Zone", method: str = "ShippingMethod"
) -> DataFrame:
    return df.withColumn("ShippingCost", shipping_cost(F.col(weight), F.col(zone), F.col(method)))


def tier(spent: Column, orders: Column) -> Column:
    made = None
    for name, (alone, with_orders, count) in model.TIER_RULES.items():
        hit = (spent >= Decimal(alone)) | ((spent >= Decimal(with_orders)) & (orders >= count))
        made = F.when(hit, name) if made is None else made.when(hit, name)
    return made.otherwise(model.LOWEST_TIER)


def customer_tiers(store: Store) -> DataFrame:
    """Tier of every customer from the orders that were not cancelled."""
    spending = (
        store.scan("sales_order", "CustomerID", "OrderStatus", "TotalAmount")
        .where(not_cancelled(F.col("OrderStatus")))
        .groupBy("CustomerID")
        .agg(F.sum("TotalAmount").alias("TotalSpent"), F.count("*").alias("OrderCount"))
    )
    return (
        store.scan("customer", "CustomerID")
        .join(spending, "CustomerID", "left")
        .select(
            "CustomerID",
            or_zero(F.col("TotalSpent")).alias("TotalSpent"),
            or_zero(F.col("OrderCount")).alias("OrderCount"),
        )
        .withColumn("CustomerTier", tier(F.col("TotalSpent"), F.col("OrderCount")))
    )


def discount_rate(tier_name: Column, quantity: Column, promoted: Column) -> Column:
    fine = "decimal(5,4)"
    part = lookup(
        tier_name, {k: F.lit(Decimal(v)) for k, v in model.TIER_DISCOUNTS.items()},
        F.lit(Decimal("0.00")),
    ).cast(fine)
    bulk = None
    for least, rate in model.QUANTITY_DISCOUNTS:
        step = F.lit(Decimal(rate)).cast(fine)
        bulk = F.when(quantity >= least, step) if bulk is None else bulk.when(
            quantity >= least, step)
    none = F.lit(0).cast(fine)
    promo = F.when(promoted, F.lit(Decimal(model.PROMO_DISCOUNT)).cast(fine)).otherwise(none)
    return F.least(part + bulk.otherwise(none) + promo, F.lit(Decimal(model.DISCOUNT_CAP)))


def with_product_discount(
    store: Store, df: DataFrame, *, promo_categories: Sequence[int] = model.PROMO_CATEGORIES
) -> DataFrame:
    """Discount on rows of CustomerID, ProductID, Quantity and UnitPrice.

    An unknown customer counts as the lowest tier, an unknown product as not
    promoted.
    """
    tiers = customer_tiers(store).select("CustomerID", "CustomerTier")
    products = store.scan("product", "ProductID", "CategoryID")
    rate = discount_rate(
        F.col("CustomerTier"), F.col("Quantity"), F.col("CategoryID").isin(*promo_categories)
    )
    return (
        df.join(tiers, "CustomerID", "left")
        .join(products, "ProductID", "left")
        .withColumn(
            "DiscountAmount",
            money(F.col("UnitPrice") * F.col("Quantity") * rate),
        )
        .select(*df.columns, "DiscountAmount")
    )
