"""First looks at a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preview(df: DataFrame, n: int, order_by: Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows of a stated order (a head without an order is not repeatable)."""
    return df.orderBy(*order_by).limit(n)


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, type, non-null count and row count, from one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"nn_{i}") for i, c in enumerate(df.columns)],
    )
    rows = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(dtype).alias("data_type"),
            F.col(f"nn_{i}").alias("non_null"),
            F.col("n_rows"),
        )
        for i, (name, dtype) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*rows)))
