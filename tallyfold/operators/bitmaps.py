"""Exact distinct counts as bitmaps that can be merged.

Ids are numbered from 1 without gaps, and a table of bitmaps holds, for each key (a day, say) and each range of
32,768 numbers, which of them occur. Only bitmaps are shuffled. Rows of new days are added to the table without
reading the old ones again; any distinct count over days, months or cohorts comes from the table alone. Text ids, and numbers
with large gaps, are numbered first (``number_ids``); a later call continues an earlier numbering.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .keys import join_on_keys


def number_ids(df: DataFrame, id: str, known: DataFrame | None = None) -> DataFrame:
    """``(id, number)``: the distinct ids, in order, numbered from 1, or on from the largest of ``known``.

    Numbers are counted within sorted tasks and shifted by the sizes of the tasks before, one row
    for each task. The result holds ``known`` too. Null has no number.
    """
    ids = df.filter(F.col(id).isNotNull()).select(id).distinct()
    last = 0
    if known is not None:
        ids = join_on_keys(ids, known.select(id), [id], "left_anti")
        last = known.agg(F.max("number")).first()[0] or 0
    laid = ids.repartitionByRange(id).sortWithinPartitions(id).select(
        id, F.spark_partition_id().alias("__task"), F.monotonically_increasing_id().alias("__at"))
    laid = settle(laid, "numbered-ids")
    tasks = laid.groupBy("__task").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first")).orderBy("__task").collect()
    shifts = []
    for task in tasks:
        shifts.append((task["__task"], last + 1 - task["first"]))
        last += task["n"]
    shift = df.sparkSession.createDataFrame(shifts, "__task int, __shift long")
    numbered = join_on_keys(laid, shift, ["__task"], small_right=True).select(id, (F.col("__at") + F.col("__shift")).alias("number"))
    return numbered if known is None else known.select(id, "number").unionByName(numbered)


def id_bitmaps(df: DataFrame, keys: Sequence[str], number: str, keep_keys: bool = False) -> DataFrame:
    """``(*keys, bucket, bitmap)``: the numbers that occur with each key; rows without a number are left out, or with ``keep_keys``
    set no bit, so that a key without numbers counts zero."""
    rows = df if keep_keys else df.filter(F.col(number).isNotNull())
    return rows.groupBy(*keys, F.coalesce(F.bitmap_bucket_number(number), F.lit(1)).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap"))


def merge_bitmaps(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The bitmaps of several tables as if all rows had been in one."""
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    return coarser_bitmaps(every, keys)


def coarser_bitmaps(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bitmaps of fewer or derived keys, such as months from days."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def count_bitmaps(bitmaps: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``(*keys, name)``: distinct ids for each key."""
    merged = coarser_bitmaps(bitmaps, keys)
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).alias(name))


def common_bitmaps(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Ids that both have: rows of ``left`` that meet one of ``right`` on ``on`` and ``bucket``, with the
    bitmap of what is in both."""
    rest = [c for c in left.columns if c not in (*on, "bitmap", "bucket")]
    other = right.select(*on, "bucket", F.col("bitmap").alias("__other"))
    pairs = left.join(other, [*on, "bucket"])
    both = pairs.select(*on, *rest, "bucket", F.explode(F.array("bitmap", "__other")).alias("bitmap"))
    return both.groupBy(*on, *rest, "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"))
