"""Months, quarters and fiscal periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month(ts: Column) -> Column:
    """First day of the month."""
    return F.trunc(ts.cast("date"), "MM")


def month_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_index(ts: Column) -> Column:
    """Months since year 0; neighbours differ by one."""
    return F.year(ts) * 12 + F.month(ts)


def quarter_text(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def period_start(end: Column, months: int) -> Column:
    """The day after the end of the period before; month ends clamp."""
    return F.date_add(F.add_months(end, -months), 1)


def any_format(text: Column, *formats: str) -> Column:
    """The first format that fits."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats)).cast("date")
