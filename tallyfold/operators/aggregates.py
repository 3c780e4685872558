"""Counts, shares, ranks and tables.

Totals are read as scalar subqueries and group values are joined back, instead of using windows
over whole groups: a window puts one group, or the whole table, into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import number, ratio
from ..functions import total as total_of
from ..session import settle
from .keys import join_group_values, join_on_keys
from .quantiles import exact_quantiles


def value_counts(df: DataFrame, column: str, digits: int | None = None) -> DataFrame:
    """``(column, n, share)`` of every non-null value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts, "n", digits=digits)


def with_share(
    df: DataFrame, column: str, name: str = "share", digits: int | None = None
) -> DataFrame:
    """Adds ``column`` divided by its total over all rows of ``df``."""
    total = df.agg(F.sum(column)).scalar()
    return df.withColumn(name, ratio(F.col(column), total, digits))


def sum_share(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum of ``value`` per key (null keys left out) and its share of the total."""
    sums = df.filter(F.col(key).isNotNull()).groupBy(key).agg(total_of(F.col(value)).alias("total"))
    grand = sums.agg(F.sum("total")).scalar()
    return sums.select(key, "total", F.try_divide(F.col("total"), grand).alias("share"))


def top_k(df: DataFrame, k: int, by: str, ties: Sequence[str]) -> DataFrame:
    """The ``k`` rows with the largest ``by``; ``ties`` makes the cut repeatable. Nulls last."""
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(k)


def top_k_with_ties(df: DataFrame, k: int, by: str) -> DataFrame:
    """Every row whose ``by`` is at least the k-th largest, so rank() <= k without a window."""
    largest = df.filter(F.col(by).isNotNull()).select(by).orderBy(F.col(by).desc()).limit(k)
    return df.filter(F.col(by) >= largest.agg(F.min(by)).scalar())


def with_group_size(df: DataFrame, key: str, name: str = "group_size") -> DataFrame:
    """Adds the number of rows that share the key; a missing key has no group."""
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return join_group_values(df, sizes, [key], name)


def running_max(
    df: DataFrame, value: str, order: str, by: Sequence[str] = (), name: str = "running_max"
) -> DataFrame:
    """Largest ``value`` up to and including the current ``order``; for aggregated rows only.

    Use it on a table whose rows per ``by`` are few (days, months): a window keeps them together.
    """
    window = Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.max(value).over(window))


def categorical_crosscount(
    df: DataFrame, left: str, left_labels: Sequence[str], right: str, right_labels: Sequence[str],
    counted: str,
) -> DataFrame:
    """Non-null ``counted`` per pair of labels; pairs that never occur show zero."""
    counts = df.groupBy(left, right).agg(F.count(counted).alias("n"))
    labels = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    grid = (
        df.sparkSession.range(1).select(labels(left_labels).alias(left))
        .select(left, labels(right_labels).alias(right))
    )
    return grid.join(counts, [left, right], "left").fillna(0, ["n"])


def per_column_totals(df: DataFrame, columns: Sequence[str], name: str = "type") -> DataFrame:
    """Per column: the sum, and how many values are above zero. One pass, one row per column."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns])
    return (
        long.unpivot([], list(columns), name, "value")
        .groupBy(name)
        .agg(
            F.coalesce(total_of(F.col("value")), F.lit(0.0)).alias("total"),
            F.count_if(F.col("value") > 0).alias("frequency"),
        )
    )


def wide_sum(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Sum of each column per key; a column with no value sums to zero. Null keys left out."""
    sums = [F.coalesce(total_of(F.col(c)), F.lit(0.0)).alias(c) for c in columns]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*sums)


def describe_column(
    df: DataFrame, column: str, probs: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Rows ``(position, stat, value)``: count, mean, sample std, min, quantiles, max."""
    v = number(F.col(column))
    moments = df.agg(
        F.count(v).cast("double").alias("count"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
    )
    n = len(probs)
    places = {"count": 1, "mean": 2, "std": 3, "min": 4, "max": 5 + n}
    stats = moments.select(F.inline(F.array(*[
        F.struct(F.lit(at).alias("position"), F.lit(s).alias("stat"), F.col(s).alias("value"))
        for s, at in places.items()
    ])))
    names = F.create_map(*[x for p in probs for x in (F.lit(float(p)), F.lit(f"{p * 100:g}%"))])
    order = F.array_position(F.array(*[F.lit(float(p)) for p in probs]), F.col("p")) + 4
    quantiles = exact_quantiles(df, column, probs).select(
        order.cast("int").alias("position"), names[F.col("p")].alias("stat"),
        F.col("q").alias("value"),
    )
    return stats.unionByName(quantiles)


def filter_keys_with_min_total(df: DataFrame, key: str, value: str, least: float) -> DataFrame:
    """Rows of the keys whose total of ``value`` reaches ``least``."""
    kept = df.groupBy(key).agg(F.sum(value).alias("__t")).filter(F.col("__t") >= least).select(key)
    kept = settle(kept.filter(F.col(key).isNotNull()), "keys")
    return join_on_keys(df, kept, [key], "left_semi")


def share_where(condition: Column, digits: int | None = None) -> Column:
    """Share of rows for which the condition holds; unknown counts as no."""
    return ratio(F.count_if(condition), F.count(F.lit(1)), digits)
