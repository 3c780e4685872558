"""Cross tables, growth between periods and aligned ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import safe_ratio, total


def pivot_count(
    df: DataFrame, row: str, column: str, values: Sequence[object], counted: str,
    fill_zero: bool = False,
) -> DataFrame:
    """Counts of non-null ``counted`` by row and by the given column values.

    A pair that never occurs is null, or zero on demand. Rows without a row key are left out.
    """
    wide = (
        df.filter(F.col(row).isNotNull()).groupBy(row).pivot(column, list(values))
        .agg(F.count(counted))
    )
    names = [str(v) for v in values]
    if fill_zero:
        return wide.fillna(0, names)
    return wide.select(row, *[F.nullif(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names])


def pivot_sum(
    df: DataFrame, row: str, column: str, values: Sequence[object], value: str
) -> DataFrame:
    """Sums by row and by the given column values; null where nothing occurs."""
    return (
        df.filter(F.col(row).isNotNull()).groupBy(row).pivot(column, list(values))
        .agg(total(F.col(value)))
    )


def growing_keys(
    df: DataFrame, key: str, period: str, value: str, earlier: object, later: object
) -> DataFrame:
    """``(key, earlier, later)`` totals of the keys that grew; both periods must have data."""
    def during(p):
        return total(F.when(F.col(period) == p, F.col(value)))

    both = df.filter(F.col(key).isNotNull() & F.col(period).isin(earlier, later))
    sums = both.groupBy(key).agg(during(earlier).alias("earlier"), during(later).alias("later"))
    return sums.filter(F.col("later") > F.col("earlier"))


def aligned_ratio(
    numerator: DataFrame, denominator: DataFrame, on: Sequence[str], value: str,
    scale: float = 1.0, epsilon: float | None = None,
) -> DataFrame:
    """Quotient of two long tables matched on ``on``; a key on one side only gives null."""
    left = numerator.select(*on, (F.col(value) * scale).alias("__num"))
    right = denominator.select(*on, F.col(value).alias("__den"))
    quotient = safe_ratio(F.col("__num"), F.col("__den"), epsilon)
    return left.join(right, list(on), "full").select(*on, quotient.alias("ratio"))
