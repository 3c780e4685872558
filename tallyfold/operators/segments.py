"""Segment sizes and span classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import day_diff, label_by_rules, three_bands
from .aggregates import with_group_size

# Labels of the classes.
SIZE_CLASSES = ("Нишевые", "Средние", "Массовые")
COLLAPSED = {"Нишевые": "niche", "Средние": "mid"}
SPAN_CLASSES = (
    "Единичное финансирование", "Срок финансирования до года",
    "Срок финансирования более года", "Вне описанных категорий",
)
DAYS_IN_YEAR = 365


def size_classes(
    df: DataFrame, key: str, low: int = 35, high: int = 120, labels: Sequence[str] = SIZE_CLASSES
) -> DataFrame:
    """``(key, n, size_class)``: below ``low``, from ``low`` to ``high``, above ``high`` rows."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("size_class", three_bands(F.col("n"), low, high, labels))


def collapse_segments(
    df: DataFrame, key: str, low: int = 35, high: int = 120, labels: Sequence[str] = SIZE_CLASSES
) -> DataFrame:
    """Adds ``segment_category`` and replaces the names of small and middle segments."""
    sized = with_group_size(df, key, "__size")
    category = three_bands(F.col("__size"), low, high, labels)
    collapsed = (
        F.when(F.col("segment_category") == labels[0], F.lit(COLLAPSED["Нишевые"]))
        .when(F.col("segment_category") == labels[1], F.lit(COLLAPSED["Средние"]))
        .otherwise(F.col(key))
    )
    return sized.withColumn("segment_category", category).withColumn(key, collapsed).drop("__size")


def span_class(rounds: Column, first: Column, last: Column) -> Column:
    """Class of a funding history. An unknown start with a known end counts as a long span."""
    single, short, long, other = SPAN_CLASSES
    within_year = F.coalesce(day_diff(last, first) <= DAYS_IN_YEAR, F.lit(False))
    return label_by_rules(
        [(rounds == 1, single), (last.isNotNull() & within_year, short), (last.isNotNull(), long)],
        other,
    )
