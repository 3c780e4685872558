"""Places to eat: joining, cleaning, round-the-clock flag, chains and distance.

``info``: id, name, category, address, district, hours, rating, chain, seats.
``prices``: id, price, avg_bill, middle_avg_bill, middle_coffee_cup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contains_all, mean, narrow_to_byte, narrow_to_short, normalize_text
from ..functions import ordinal_lookup
from ..operators.aggregates import top_k_with_ties
from ..operators.quality import dedup_keep_first

# New names, opening hours, words and the order of districts by distance.
NEW_NAMES = {
    "price": "price_cat", "avg_bill": "bill_range", "middle_avg_bill": "middle_of_bill_range",
    "middle_coffee_cup": "middle_of_coffee_cup_price",
}
ROUND_THE_CLOCK = "ежедневно, круглосуточно"
ROUND_THE_CLOCK_WORDS = ("ежедневно", "круглосуточно")
NO_SEATS = -1
DISTRICT_DISTANCE = {
    "Центральный административный округ": 0,
    "Западный административный округ": 1,
    "Юго-Западный административный округ": 2,
    "Северо-Западный административный округ": 3,
    "Северный административный округ": 4,
    "Северо-Восточный административный округ": 5,
    "Восточный административный округ": 6,
    "Юго-Восточный административный округ": 7,
}
FARTHEST = 8


def join_prices(info: DataFrame, prices: DataFrame) -> DataFrame:
    """All venues, with prices where known, under the working names."""
    return info.join(prices, "id", "left").withColumnsRenamed(NEW_NAMES)


def clean_venues(df: DataFrame) -> DataFrame:
    """Normalised texts, filled seats, one row per name and address (the lowest id stays)."""
    texts = {c: normalize_text(F.col(c)) for c in ("name", "address", "hours", "bill_range")}
    cleaned = df.withColumns(texts).withColumns({
        "chain": narrow_to_byte(F.col("chain")),
        "seats": narrow_to_short(F.coalesce("seats", F.lit(NO_SEATS))),
    })
    return dedup_keep_first(cleaned, ["name", "address"], "id").withColumn("is_24_7", is_24_7())


def is_24_7(hours: str = "hours") -> Column:
    return F.coalesce(F.col(hours) == ROUND_THE_CLOCK, F.lit(False))


def mentions_24_7(hours: str = "hours") -> Column:
    return contains_all(F.col(hours), ROUND_THE_CLOCK_WORDS)


def distance(district: str = "district") -> Column:
    return ordinal_lookup(F.col(district), DISTRICT_DISTANCE, FARTHEST)


def chains(venues: DataFrame) -> DataFrame:
    """Outlets and mean rating of every chain and category."""
    members = venues.filter(
        (F.col("chain") == 1) & F.col("name").isNotNull() & F.col("category").isNotNull()
    )
    return members.groupBy("name", "category").agg(
        F.count("name").alias("cnt"), mean(F.col("rating")).alias("avg")
    )


def top_chains(venues: DataFrame, k: int = 15) -> DataFrame:
    """The largest chains; those level with the last one are in."""
    return top_k_with_ties(chains(venues), k, "cnt")


def mean_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of a measure per class; rows without a class are left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        mean(F.col(value)).alias("mean")
    )
