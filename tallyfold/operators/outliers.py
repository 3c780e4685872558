"""Percentile trims, interquartile fences, histograms and box-plot numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import number, ratio
from ..session import settle, settle_computed
from .keys import join_group_values, join_on_keys, with_row
from .quantiles import Histogram, column_quantiles, count_values, exact_quantiles, quantile_columns


@dataclass(frozen=True)
class Trim:
    """Keep values strictly between two percentiles; ``optional`` lets nulls pass."""

    column: str
    above: float | None = None
    below: float | None = None
    optional: bool = False


# The trim of the flats table.
FLAT_TRIMS = (
    Trim("total_area", below=0.99),
    Trim("rooms", below=0.99, optional=True),
    Trim("balcony", below=0.99, optional=True),
    Trim("ceiling_height", above=0.01, below=0.99, optional=True),
)


def percentile_limits(df: DataFrame, trims: Sequence[Trim]) -> DataFrame:
    """One row with a column ``<column>_<percentile>`` for each limit, found in one pass."""
    wanted = [(t.column, p) for t in trims for p in (t.above, t.below) if p is not None]
    columns = list(dict.fromkeys(c for c, _ in wanted))
    limits = column_quantiles(df, columns, sorted({p for _, p in wanted}), "discrete")
    return limits.agg(*[
        F.max(F.when((F.col("column_name") == c) & (F.col("p") == p), F.col("q"))).alias(_limit(c, p))
        for c, p in wanted
    ])


def _limit(column: str, p: float) -> str:
    return f"{column}_p{p * 100:g}".replace(".", "_")


def percentile_trim(df: DataFrame, trims: Sequence[Trim] = FLAT_TRIMS) -> DataFrame:
    """Rows inside all limits. A value equal to a limit is out.

    Rows that are computed, not just read, are written first: the limits and the result then read that table.
    """
    df = settle_computed(df, "trim-rows")

    def keeps(t: Trim) -> Column:
        value, tests = F.col(t.column), []
        if t.below is not None:
            tests.append(value < F.col(_limit(t.column, t.below)))
        if t.above is not None:
            tests.append(value > F.col(_limit(t.column, t.above)))
        inside = reduce(and_, tests)
        return inside | value.isNull() if t.optional else inside

    limited = with_row(df, percentile_limits(df, trims))
    return limited.filter(reduce(and_, [keeps(t) for t in trims])).select(*df.columns)


def iqr_fences(df: DataFrame, key: str, value: str, k: float = 1.5) -> DataFrame:
    """``(key, lower, upper)``: the quartiles of each group widened by ``k`` ranges."""
    return settle(_sized_fences(df, key, value, k).drop("__size"), "fences")


def _sized_fences(df: DataFrame, key: str, value: str, k: float) -> DataFrame:
    """The fences and the number of values of each group."""
    values = Histogram(count_values(df.filter(F.col(key).isNotNull()), value, [key]), [key])
    q = quantile_columns(values.quantiles([0.25, 0.75]), {0.25: "q1", 0.75: "q3"}, [key])
    reach = (F.col("q3") - F.col("q1")) * k
    fences = q.select(
        key, (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper")
    )
    return fences.join(values.sizes("__size"), key)


def flag_iqr_outliers(df: DataFrame, key: str, value: str, k: float = 1.5) -> DataFrame:
    """Adds ``is_outlier``; rows without a key or a value are no outliers."""
    v = F.col(value)
    outside = (v > F.col("upper")) | (v < F.col("lower"))
    return (
        join_group_values(df, _sized_fences(df, key, value, k), [key], "__size")
        .select(*df.columns, F.coalesce(outside, F.lit(False)).alias("is_outlier"))
    )


def iqr_outliers(df: DataFrame, key: str, value: str, name: str, k: float = 1.5) -> DataFrame:
    """Per group: rows, named outliers and their share.

    The missing group is listed with no members, because a missing key equals nothing.
    """
    flagged = flag_iqr_outliers(df, key, value, k)
    named = F.count(F.when(F.col("is_outlier"), F.col(name)))
    size = F.count_if(F.col(key).isNotNull())
    return flagged.groupBy(key).agg(
        size.alias("n_rows"), named.alias("n_outliers"), ratio(named, size).alias("share")
    )


def drop_outlier_entities(
    df: DataFrame, key: str, value: str, entity: str, k: float = 1.5
) -> DataFrame:
    """Drops every row of an entity that has an outlier in any group.

    ``entity`` decides who goes: with a name, namesakes go too; with an id, only the row's owner.
    """
    df = settle_computed(df, "entity-rows")
    flagged = flag_iqr_outliers(df, key, value, k).filter("is_outlier").select(entity).distinct()
    return join_on_keys(df, settle(flagged.dropna(), "flagged"), [entity], "left_anti")


def iqr_null_upper(df: DataFrame, key: str, value: str, k: float = 1.5) -> DataFrame:
    """Values above their group's upper fence become null; low values stay."""
    df = settle_computed(df, "null-upper-rows")
    fences = _sized_fences(df, key, value, k).drop("lower")
    kept = F.when(~(F.col(value) > F.coalesce("upper", F.lit(float("inf")))), F.col(value))
    return join_group_values(df, fences, [key], "__size").withColumn(value, kept).drop("upper", "__size")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``(bin, lower, upper, n)`` for equal-width bins; the last one is closed on both sides."""
    values = df.select(number(F.col(value)).alias("__v")).filter(F.col("__v").isNotNull())
    ends = values.agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    # A single value gets a range of one around it.
    half = F.when(F.col("lo") == F.col("hi"), F.lit(0.5)).otherwise(F.lit(0.0))
    span = ends.select(
        (F.col("lo") - half).alias("start"),
        ((F.col("hi") + half) - (F.col("lo") - half)).alias("width"),
    )
    at = F.floor((F.col("__v") - F.col("start")) / F.col("width") * bins)
    counts = with_row(values, span).groupBy(
        F.least(at, F.lit(bins - 1)).cast("long").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    edge = lambda i: F.col("start") + F.col("width") * i / bins
    frame = with_row(df.sparkSession.range(bins).withColumnRenamed("id", "bin"), span).select(
        "bin", edge(F.col("bin")).alias("lower"), edge(F.col("bin") + 1).alias("upper")
    )
    return frame.join(counts, "bin", "left").fillna(0, ["n"])


def boxplot_stats(df: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    """One row: quartiles, the whisker ends (values inside the fences) and outlier count."""
    names: Mapping[float, str] = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    quartiles = quantile_columns(exact_quantiles(df, value, list(names)), names)
    v = F.col("__value")
    reach = (F.col("q3") - F.col("q1")) * k
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    return with_row(df.select(number(F.col(value)).alias("__value")), quartiles).agg(
        *[F.max(n).alias(n) for n in names.values()],
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )
