"""Calendar periods: the grain of every statement roll-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = {
    "week": "INTERVAL 7 DAY",
    "month": "INTERVAL 1 MONTH",
    "quarter": "INTERVAL 3 MONTH",
    "year": "INTERVAL 1 YEAR",
}


def period(date: Column, grain: str = "month") -> Column:
    """First day of the period that holds ``date``."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {sorted(GRAINS)}")
    return F.trunc(date.cast("date"), grain)


def step(grain: str) -> Column:
    return F.expr(GRAINS[grain])


def periods_between(start: Column, end: Column, grain: str) -> Column:
    """Whole periods from ``start`` to ``end``, both period starts."""
    if grain == "week":
        return F.floor(F.datediff(end, start) / 7).cast("int")
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return F.floor(months / {"month": 1, "quarter": 3, "year": 12}[grain]).cast("int")


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")
