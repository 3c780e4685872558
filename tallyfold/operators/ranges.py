"""Joins on a key and a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType


def _day(df: DataFrame, column: str) -> Column:
    """A whole number that counts days, or the whole number that the column is."""
    return F.unix_date(column) if isinstance(df.schema[column].dataType, DateType) else F.col(column).cast("long")


def range_join(left: DataFrame, right: DataFrame, key: str, start: str, at: str, low: int, high: int) -> DataFrame:
    """Rows of both with equal ``key`` and ``right.at - left.start`` from ``low`` to ``high``; all columns, the key once.

    Time is cut into bins as wide as the range, so a left row meets at most two bins of the right and a key with very many
    rows is dealt to as many tasks as it has bins, not to one. Null keys and times match nothing. Other
    column names must differ. ``start`` and ``at`` are dates or whole numbers.
    """
    if high < low:
        raise ValueError("the range is empty")
    width = high - low + 1
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    first, last = bin_of(_day(left, start) + low), bin_of(_day(left, start) + high)
    spread = left.filter(F.col(key).isNotNull() & F.col(start).isNotNull()).withColumn("__bin", F.explode(F.sequence(first, last)))
    binned = right.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("__bin", bin_of(_day(right, at)))
    apart = _day(right, at) - _day(left, start)
    return spread.join(binned, [key, "__bin"]).filter(apart.between(low, high)).drop("__bin")
