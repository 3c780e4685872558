"""Several checks of a table from one scan.

Each row is turned into a few small rows, one for each thing to be counted (the table, a value, a key,
a year); one aggregate counts them all, with partial counts before the shuffle. Its result has a row for each value, group
and year, and one for each key; every report is read from it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from ..session import settle
from .quality import digest_of, is_missing

_ALL, _GROUP, _VALUE, _KEY, _YEAR = "all", "group", "value", "key", "year"


class TableProfile:
    """The reports of ``quality`` and ``schema_profile`` for one table; building it scans the table once.

    ``groups``: columns by whose values gaps are counted. ``values``: columns whose values are listed.
    ``keys``: column lists that may identify a row. ``days``: names and (date column, earliest, latest).
    """

    def __init__(
        self, df: DataFrame, groups: Sequence[str] = (), values: Sequence[str] = (), keys: Sequence[Sequence[str]] = (),
        days: Mapping[str, tuple[Column, str, str]] | None = None,
    ):
        self._types, self._keys = dict(df.dtypes), [tuple(k) for k in keys]
        columns = df.columns
        zero, no = F.lit(0), F.lit(None)

        def item(kind: str, name: str, value: Column, gaps: bool = False, day: Column = no, outside: Column = zero) -> Column:
            missing = [(is_missing(df, c).cast("int") if gaps else zero).alias(f"m{i}") for i, c in enumerate(columns)]
            return F.struct(
                F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.cast("string").alias("value"),
                day.cast("date").alias("day"), outside.cast("int").alias("outside"), *missing)

        items = [item(_ALL, "", no, gaps=True)]
        items += [item(_GROUP, g, F.col(f"`{g}`"), gaps=True) for g in groups]
        items += [item(_VALUE, v, F.col(f"`{v}`")) for v in values]
        items += [item(_KEY, str(i), F.concat_ws(" ", *digest_of(df, k))) for i, k in enumerate(self._keys)]
        for name, (day, earliest, latest) in (days or {}).items():
            inside = day.between(F.lit(earliest).cast("date"), F.lit(latest).cast("date"))
            items.append(item(_YEAR, name, F.year(day), day=day, outside=(~inside).cast("int")))
        sums = [f"m{i}" for i in range(len(columns))]
        counts = df.select(F.inline(F.array(*items))).groupBy("kind", "name", "value").agg(
            F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
            F.sum("outside").alias("outside"), *[F.sum(s).alias(s) for s in sums])
        # Of the keys only their number and the largest group are wanted.
        shown = F.when(F.col("kind") != _KEY, F.col("value"))
        self.counts = settle(counts.groupBy("kind", "name", shown.alias("value")).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_values"), F.max("n").alias("largest"), F.min("first_day").alias("first_day"),
            F.max("last_day").alias("last_day"), F.sum("outside").alias("outside"), *[F.sum(s).alias(s) for s in sums]), "profile")

    def _of(self, kind: str, name: str = "") -> DataFrame:
        return self.counts.filter((F.col("kind") == kind) & (F.col("name") == name))

    def _column_rows(self, fields) -> DataFrame:
        rows = [F.struct(*fields(i, c)) for i, c in enumerate(self._types)]
        whole = self._of(_ALL)
        # A table without rows has no row of counts.
        one = whole.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(f"m{i}"), F.lit(0)).alias(f"m{i}") for i in range(len(self._types))])
        return one.select(F.inline(F.array(*rows)))

    def schema_profile(self) -> DataFrame:
        """Position, type, non-null count and row count of every column. "Not a number" counts as a gap here."""
        return self._column_rows(lambda i, c: [
            F.lit(i + 1).alias("position"), F.lit(c).alias("column_name"), F.lit(self._types[c]).alias("data_type"),
            (F.col("n") - F.col(f"m{i}")).alias("non_null"), F.col("n").alias("n_rows")])

    def missing_stats(self) -> DataFrame:
        """``(column_name, missing, share)`` of the columns that have gaps."""
        return self._column_rows(lambda i, c: [
            F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing"), ratio(F.col(f"m{i}"), F.col("n")).alias("share"),
        ]).filter(F.col("missing") > 0)

    def missing_share_by(self, key: str) -> DataFrame:
        """Share of gaps in every column per value of ``key``; rows without a key are left out."""
        rows = self._of(_GROUP, key).filter(F.col("value").isNotNull())
        shares = [ratio(F.col(f"m{i}"), F.col("n")).alias(c) for i, c in enumerate(self._types) if c != key]
        return rows.select(F.col("value").cast(self._types[key]).alias(key), *shares)

    def domain_check(self, column: str, allowed: Sequence[object]) -> DataFrame:
        """``(value, n, allowed)`` for every value that occurs; null is not allowed."""
        value = F.col("value").cast(self._types[column])
        return self._of(_VALUE, column).select(value.alias("value"), "n").withColumn(
            "allowed", F.coalesce(F.col("value").isin(list(allowed)), F.lit(False)))

    def key_uniqueness(self, keys: Sequence[str]) -> DataFrame:
        """Rows, distinct key combinations and whether the keys identify a row."""
        return self._of(_KEY, str(self._keys.index(tuple(keys)))).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("n_values"), F.lit(0)).alias("n_keys"),
            (F.coalesce(F.max("largest"), F.lit(1)) == 1).alias("is_unique"))

    def implausible_dates(self, name: str) -> DataFrame:
        """Per year: first and last date, rows, and rows outside the plausible span."""
        return self._of(_YEAR, name).filter(F.col("value").isNotNull()).select(
            F.col("value").cast("int").alias("year"), "first_day", "last_day", "n", F.col("outside").alias("n_implausible"))
