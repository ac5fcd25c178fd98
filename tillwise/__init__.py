"""Retail sales, customer and inventory analytics as Spark DataFrame jobs."""

from tillwise.session import builder, tune
from tillwise.store import Store

__all__ = ["Store", "builder", "tune"]
