"""Small column builders shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwise.model import MONEY


def money(value: Column | str | int) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast(MONEY)


def lookup(key: Column, values: Mapping, other) -> Column:
    """The value listed for ``key``; ``other`` for anything else, also unknown."""
    made = None
    for name, value in values.items():
        made = F.when(key == name, value) if made is None else made.when(key == name, value)
    return made.otherwise(other)


def mean(value: Column) -> Column:
    """Average as double, unknown when there is nothing to average."""
    return F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0))


def ratio(top: Column, bottom: Column, otherwise=0.0) -> Column:
    """``top / bottom`` as double where ``bottom`` is above zero."""
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double")).otherwise(
        F.lit(otherwise).cast("double") if not isinstance(otherwise, Column) else otherwise
    )


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def text(value: Column) -> Column:
    return value.cast("string")


def not_cancelled(status: Column) -> Column:
    return status != "Cancelled"


def stock_label(labels: tuple[str, ...]) -> Column:
    """Label for no stock, stock at or below reorder level, [overstock,] other."""
    stock, level = F.col("StockQuantity"), F.col("ReorderLevel")
    made = F.when(stock == 0, labels[0]).when(stock <= level, labels[1])
    if len(labels) == 4:
        made = made.when(stock > level * 3, labels[2])
    return made.otherwise(labels[-1])
