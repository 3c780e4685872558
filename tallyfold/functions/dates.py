"""Date expressions. The as-of day is always an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(col: Column, pattern: str = "yyyy-MM-dd", min_date: str | None = None) -> Column:
    """Text to date; unreadable text, and dates before ``min_date``, give null."""
    parsed = F.try_to_date(col, pattern)
    if min_date is None:
        return parsed
    return F.when(parsed >= F.lit(min_date).cast("date"), parsed)


def add_days(day: Column, days: Column) -> Column:
    """Date plus a possibly fractional number of days, rounded half to even first."""
    return F.date_add(day, F.rint(days).cast("int"))


def day_diff(later: Column, earlier: Column) -> Column:
    return F.date_diff(later, earlier)


def midpoint(first: Column, last: Column) -> Column:
    """The instant half way between two dates; null if either end is missing."""
    half_days = F.date_diff(last, first).cast("double") / 2
    start = first.cast("date").cast("timestamp_ntz")
    return F.timestamp_add("HOUR", (half_days * 24).cast("int"), start)


def age_years(birth: Column, as_of: Column) -> Column:
    """Completed years between two dates, by month and day."""
    month_day = lambda c: F.month(c) * 100 + F.dayofmonth(c)
    not_yet = (month_day(as_of) < month_day(birth)).cast("int")
    return F.year(as_of) - F.year(birth) - not_yet
