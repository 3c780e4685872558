"""Gaps, duplicates and plausibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mean, normalize_text, number, ratio
from .keys import join_group_values


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def is_missing(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    if dict(df.dtypes)[column] in ("double", "float"):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_stats(df: DataFrame) -> DataFrame:
    """``(column_name, missing, share)`` of the columns that have gaps, from one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(is_missing(df, c)).alias(f"m_{i}") for i, c in enumerate(df.columns)],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"m_{i}").alias("missing"),
            ratio(F.col(f"m_{i}"), F.col("n")).alias("share"),
        )
        for i, c in enumerate(df.columns)
    ]
    return counts.select(F.inline(F.array(*rows))).filter(F.col("missing") > 0)


def missing_share_by(df: DataFrame, key: str) -> DataFrame:
    """Share of gaps in every column per value of ``key``; rows without a key are left out."""
    n = F.count(F.lit(1))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *[ratio(F.count_if(is_missing(df, c)), n).alias(c) for c in df.columns if c != key]
    )


def fill_group_mean(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Fills gaps, "not a number" too, with the mean of the rows with equal keys. A missing key
    equals nothing, so those gaps stay.

    Only the per-group means travel to the rows; no group is gathered in one place.
    """
    means = df.dropna(subset=list(keys)).groupBy(*keys).agg(
        mean(F.col(column)).alias("__mean"), F.count(F.lit(1)).alias("__size")
    )
    filled = F.coalesce(number(F.col(column)), F.col("__mean"))
    return join_group_values(df, means, keys, "__size").withColumn(column, filled).drop("__mean", "__size")


def unfill_sentinel(df: DataFrame, value: float, columns: Sequence[str]) -> DataFrame:
    """Turns a filler value back into a gap."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(value)) for c in columns})


def digest_of(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes that stand for the values of some columns; null differs from every value.

    Rows with different values share both with a probability of about 2^-128 for a pair.
    """
    kinds = dict(df.dtypes)
    plain = [F.col(f"`{c}`") + 0.0 if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in columns]
    # A hash passes over nulls, so which values are null is hashed too.
    gaps = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in columns])
    return [F.xxhash64(gaps, *plain), F.xxhash64(F.lit(0x5EED), gaps, *plain)]


_DIGEST = ("__d1", "__d2")


def with_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns(dict(zip(_DIGEST, digest_of(df, columns))))


def count_duplicates(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows and surplus copies. Rows are counted by digest: numbers, not rows, are
    sorted out and shuffled."""
    groups = df.select(*[d.alias(n) for n, d in zip(_DIGEST, digest_of(df, df.columns))]).groupBy(*_DIGEST).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_extra"),
    )


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` of each key combination; null equals null.

    Rows without an order come last; rows with equal order are told apart by their other columns.
    An aggregate, not a row number: copies collapse before the shuffle, however many there are.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    place = F.struct(F.col(order).isNull().alias("__last"), *[F.col(f"`{c}`") for c in (order, *rest)])
    first = df.groupBy(*keys).agg(F.min(place).alias("__row"))
    return first.select(
        *[F.col(c) if c in keys else F.col(f"__row.`{c}`").alias(c) for c in df.columns]
    )


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key combination occurs more than once; found by digest, hot keys in a broadcast."""
    rows = with_digest(df, keys)
    repeated = rows.groupBy(*_DIGEST).agg(F.count(F.lit(1)).alias("__size")).filter("__size > 1")
    return join_group_values(rows, repeated, _DIGEST, "__size", how="inner").select(*df.columns)


def hidden_duplicates(df: DataFrame, column: str) -> DataFrame:
    """Distinct values before and after normalising the text.

    The raw values are made distinct first, so the text is normalised once per value.
    """
    raw = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    per_norm = raw.groupBy(normalize_text(F.col(column)).alias("__norm")).agg(
        F.count(F.lit(1)).alias("__raw")
    )
    return per_norm.agg(
        F.coalesce(F.sum("__raw"), F.lit(0)).alias("n_raw"),
        F.count(F.lit(1)).alias("n_normalized"),
    )


def row_loss_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after a step, the loss, and the loss in percent with two digits."""
    counts = before.agg(F.count(F.lit(1)).alias("n_before")).withColumn(
        "n_after", after.agg(F.count(F.lit(1))).scalar()
    )
    lost = F.col("n_before") - F.col("n_after")
    return counts.withColumn("n_lost", lost).withColumn(
        "pct_lost", ratio(lost * 100, F.col("n_before"), 2)
    )


def narrowest_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, type)``: the narrowest whole-number type that holds every value of a column,
    or double where a value has a fraction. One pass; nothing is changed by it."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`")
        aggs += [F.min(v).alias(f"lo_{i}"), F.max(v).alias(f"hi_{i}"), F.count_if(v != F.floor(v)).alias(f"cut_{i}")]

    def fitting(i: int) -> Column:
        found = F.lit("bigint")
        for name, bits in (("int", 32), ("smallint", 16), ("tinyint", 8)):
            top = 1 << (bits - 1)
            found = F.when((F.col(f"lo_{i}") >= -top) & (F.col(f"hi_{i}") <= top - 1), F.lit(name)).otherwise(found)
        return F.when(F.col(f"cut_{i}") > 0, F.lit("double")).otherwise(found)

    rows = [F.struct(F.lit(c).alias("column_name"), fitting(i).alias("type")) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def downcast(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns cast to the narrowest type that loses nothing. Reads the columns once when called."""
    types = {r.column_name: r.type for r in narrowest_types(df, columns).collect()}
    return df.withColumns({c: F.col(f"`{c}`").cast(types[c]) for c in columns})


def missingness_rule(df: DataFrame, column: str, expected_missing: Column) -> DataFrame:
    """Do the gaps of a column follow a rule? Gaps, rule hits, and rows where the two differ."""
    gap = F.col(column).isNull()
    return df.agg(
        F.count_if(gap).alias("n_missing"),
        F.count_if(expected_missing).alias("n_expected"),
        F.count_if(gap != expected_missing).alias("n_mismatch"),
    )


def domain_check(df: DataFrame, column: str, allowed: Sequence[object]) -> DataFrame:
    """``(value, n, allowed)`` for every value that occurs; null is not allowed."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "allowed", F.coalesce(F.col("value").isin(list(allowed)), F.lit(False))
    )


def period_completeness(df: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """``(day, n)`` for every day from ``start`` to ``end``; days without rows show zero.

    The bounds are compared with the column as it is, so that file statistics can skip data.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = (F.col(time) >= first) & (F.col(time) < F.date_add(last, 1))
    counts = df.filter(inside).groupBy(F.col(time).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    days = df.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    return days.join(counts, "day", "left").fillna(0, ["n"])


def key_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct key combinations and whether the keys identify a row."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        (F.coalesce(F.max("__n"), F.lit(1)) == 1).alias("is_unique"),
    )


def implausible_dates(df: DataFrame, day: Column, earliest: str, latest: str) -> DataFrame:
    """Per year: first and last date, rows, and rows outside the plausible span."""
    inside = day.between(F.lit(earliest).cast("date"), F.lit(latest).cast("date"))
    return df.filter(day.isNotNull()).groupBy(F.year(day).alias("year")).agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        F.count(F.lit(1)).alias("n"), F.count_if(~inside).alias("n_implausible"),
    )
