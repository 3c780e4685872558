"""Joins on grouping keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import settle


def join_on_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
    never_null: Sequence[str] = (), small_right: bool = False,
) -> DataFrame:
    """Join on equal keys where null equals null, as GROUP BY has it; keys come from the left.

    ``never_null`` keys are joined by plain equality.

    Group values joined back to their rows must come through here too: a grouped table is already
    laid out by its key, and on plain equality the planner would join it as it lies, in which form
    adaptive execution cannot split a hot key. The null-safe keys make it shuffle both sides.

    ``small_right`` broadcasts the right side; callers set it only where the number of rows
    is bounded by their own arguments. Otherwise the planner decides from measured sizes and
    splits skewed partitions.
    """
    on = [*keys, *never_null]
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in on})
    if small_right:
        renamed = F.broadcast(renamed)
    matches = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    matches += [left[k] == renamed[f"__r_{k}"] for k in never_null]
    condition = reduce(and_, matches)
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"__r_{k}" for k in on])


#: A key with more than this share of the rows, one in so many, is hot; there are at most so many hot keys.
HOT_SHARE = 1000


def join_group_values(df: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, how: str = "left") -> DataFrame:
    """Rows with the values of their group; ``groups`` has one row per key, with the group's rows in ``size``, and is written here.

    Whatever adaptive execution does, no task gets the rows of a hot key: keys with more than a thousandth of the
    rows, of which there are at most a thousand, meet their rows in a broadcast. The others are shuffled by key, where
    rows of hot keys go along spread over all tasks. Keys join as GROUP BY has it. ``how``: "left" or "inner".
    A table of at most a thousand groups is broadcast whole.
    """
    values = [c for c in groups.columns if c not in keys]
    totals = Observation()
    groups = groups.observe(totals, F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"))
    # The number that all groups share is written too: a constant would not become a key of the join.
    groups = settle(groups.withColumn("__salt", F.lit(0).cast("long")), "group-values")
    if totals.get["n"] <= HOT_SHARE:
        return join_on_keys(df, groups.drop("__salt"), keys, how, small_right=True)
    hot = groups.filter(F.col(size) * HOT_SHARE > totals.get["total"])
    marked = hot.select(*keys, F.struct(*values).alias("__hot"))
    rows = join_on_keys(df, marked, keys, "left", small_right=True)
    is_hot = F.col("__hot").isNotNull()
    # A row of a hot key carries a number that no group has, so it meets nothing and may go anywhere.
    salt = F.when(is_hot, 1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))).otherwise(0)
    cold = groups.filter(F.col(size) * HOT_SHARE <= totals.get["total"])
    cold = cold.select(*keys, F.struct(*values).alias("__cold"), "__salt")
    both = join_on_keys(rows.withColumn("__salt", salt.cast("long")), cold, keys, "left", never_null=["__salt"])
    found = F.coalesce("__hot", "__cold")
    if how == "inner":
        both = both.filter(found.isNotNull())
    return both.select(*df.columns, *[found[c].alias(c) for c in values])


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row table (an aggregate without keys) to every row.

    For limits that many expressions use: a scalar subquery is planned once per use.
    """
    return df.join(F.broadcast(row), F.lit(True))
