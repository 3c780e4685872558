"""Start-ups: funding spans, segments, types of funding, growth and returns.

``rounds`` has one row per company: name, market, funding_total_usd, funding_rounds,
first_funding_at, mid_funding_at, last_funding_at, and one amount column per type.
``returns`` has one row per year and one column per type, in millions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mean, midpoint, normalize_text, parse_date, parse_number, strip_separators, total
from ..operators.aggregates import filter_keys_with_min_total, per_column_totals, with_share
from ..operators.keys import join_on_keys
from ..operators.outliers import drop_outlier_entities, iqr_null_upper
from ..operators.reshape import aligned_ratio, growing_keys
from ..operators.segments import collapse_segments, span_class
from ..session import settle

# The types of funding, text columns, date columns and labels.
FUNDING_TYPES = (
    "seed", "venture", "equity_crowdfunding", "undisclosed", "convertible_note",
    "debt_financing", "angel", "grant", "private_equity", "post_ipo_equity", "post_ipo_debt",
    "secondary_market", "product_crowdfunding",
)
TEXT_COLUMNS = (
    "name", "homepage_url", "category_list", "market", "status", "country_code", "state_code",
    "region", "city",
)
DATE_COLUMNS = ("founded_at", "first_funding_at", "mid_funding_at", "last_funding_at")
NO_NAME = "Название неизвестно"
MILLION = 1e6
NEW_NAMES = {
    " market ": "market", " funding_total_usd ": "funding_total_usd",
    **{f"round_{c}": f"round_{c.lower()}" for c in "ABCDEFGH"},
}


def clean_rounds(raw: DataFrame, min_date: str | None = None) -> DataFrame:
    """Amounts and dates parsed, texts normalised, copies and rows without a total dropped, the
    middle date and the name filled."""
    df = raw.withColumnsRenamed(NEW_NAMES)
    have = set(df.columns)
    amount = parse_number(strip_separators(F.trim("funding_total_usd")))
    df = df.withColumn("funding_total_usd", amount)
    df = df.withColumns({
        c: parse_date(F.trim(c), min_date=min_date) for c in DATE_COLUMNS if c in have
    })
    df = df.withColumns({c: normalize_text(F.col(c)) for c in TEXT_COLUMNS if c in have})
    df = df.dropDuplicates().dropna(subset=["funding_total_usd"])
    middle = midpoint(F.col("first_funding_at"), F.col("last_funding_at"))
    return df.withColumns({
        "mid_funding_at": F.coalesce(F.col("mid_funding_at").cast("timestamp_ntz"), middle),
        "name": F.coalesce("name", F.lit(NO_NAME)),
    })


def with_span_class(df: DataFrame) -> DataFrame:
    spans = span_class(
        F.col("funding_rounds"), F.col("first_funding_at"), F.col("last_funding_at")
    )
    return df.withColumn("funding_periods_categories", spans)


def without_outliers(df: DataFrame, by: str = "name") -> DataFrame:
    """Collapses small segments, then drops the companies with unusual totals for a segment.

    The rows are written twice, as they come and with their segments: sizes, fences, names and all later
    steps read those tables, and what the rows are made from is read once. Select the columns needed first.
    ``scratch_scope`` deletes the tables.
    """
    rows = settle(df, "rounds")
    return drop_outlier_entities(collapse_segments(rows, "market"), "market", "funding_total_usd", by)


def busy_years(df: DataFrame, least: float = 50) -> DataFrame:
    """Rows of the years with at least ``least`` rounds."""
    dated = df.withColumn("year", F.year("mid_funding_at"))
    return filter_keys_with_min_total(dated, "year", "funding_rounds", least)


def funding_by_type(df: DataFrame, types: Sequence[str] = FUNDING_TYPES) -> DataFrame:
    """Volume, number of companies and share of the volume per type of funding."""
    return with_share(per_column_totals(df, types), "total")


def yearly_dynamics(df: DataFrame) -> DataFrame:
    """Mean size of a round and the number of rounds per year."""
    size = F.try_divide(F.col("funding_total_usd"), F.col("funding_rounds"))
    return df.filter(F.col("year").isNotNull()).groupBy("year").agg(
        mean(size).alias("avg_round"),
        F.sum("funding_rounds").alias("n_rounds"),
    )


def growing_segments(
    df: DataFrame, earlier: int = 2013, later: int = 2014, merged: Sequence[str] = ("mid", "niche")
) -> DataFrame:
    """``(market, year, total)`` of every year, for segments that grew between two years."""
    single = df.filter(F.col("market").isNotNull() & ~F.col("market").isin(list(merged)))
    yearly = single.filter(F.col("year").isNotNull()).groupBy("market", "year").agg(
        total(F.col("funding_total_usd")).alias("total")
    )
    grew = growing_keys(yearly, "market", "year", "total", earlier, later).select("market")
    return join_on_keys(yearly, grew, ["market"], "left_semi")


def long_by_year(df: DataFrame, year: str, types: Sequence[str]) -> DataFrame:
    """``(year, type, amount)``: sums per year and type; a type without amounts gives zero."""
    sums = df.filter(F.col(year).isNotNull()).groupBy(F.col(year).alias("year")).agg(
        *[F.coalesce(total(F.col(c)), F.lit(0.0)).alias(c) for c in types]
    )
    return sums.unpivot(["year"], list(types), "type", "amount")


def return_rate(
    returns: DataFrame, invested: DataFrame, unit: float = MILLION, epsilon: float | None = None,
    k: float = 1.5,
) -> DataFrame:
    """Returned over invested per year and type, with values above the type's fence set to null.

    Both inputs are long tables ``(year, type, amount)``. A zero investment gives null; pass
    ``epsilon`` to shift it instead.
    """
    rates = aligned_ratio(returns, invested, ["year", "type"], "amount", unit, epsilon)
    return iqr_null_upper(rates, "type", "ratio", k)
