"""Time helpers on zone-less timestamps."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def ts(moment: datetime) -> Column:
    """A zone-less timestamp literal; Catalyst folds it to a constant."""
    return F.lit(moment.isoformat(sep=" ")).cast(NTZ)


def days_before(moment: datetime, days: int) -> Column:
    return ts(moment - timedelta(days=days))


def years_before(moment: datetime, years: int) -> Column:
    """The same calendar day ``years`` earlier; 29 February becomes the 28th."""
    try:
        return ts(moment.replace(year=moment.year - years))
    except ValueError:
        return ts(moment.replace(year=moment.year - years, day=28))


def midnight(moment: datetime) -> datetime:
    return moment.replace(hour=0, minute=0, second=0, microsecond=0)


def plus_days(at: Column, days: Column | int) -> Column:
    days = F.lit(days) if isinstance(days, int) else days
    return at + F.make_dt_interval(days)


def days_between(start: Column, end: Column) -> Column:
    """Midnights crossed from ``start`` to ``end``."""
    return F.datediff(end.cast("date"), start.cast("date"))


def months_between(start: Column, end: Column) -> Column:
    """Month boundaries crossed from ``start`` to ``end``."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
