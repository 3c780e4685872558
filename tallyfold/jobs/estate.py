"""Property listings: time on the market, seasons and places.

``flats``: id, city_id, type_id, total_area, rooms, balcony, ceiling_height.
``ads``: id, first_day_exposition, days_exposition, last_price. ``cities``: city_id, city.
``types``: type_id, type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import add_days, mean, ratio, safe_ratio, three_bands
from ..operators.aggregates import top_k
from ..operators.outliers import FLAT_TRIMS, percentile_trim

# Names and labels of the reports.
CAPITAL, TOWN = "Санкт-Петербург", "город"
REGION_TOWNS = "города Лен области"
DURATION_BANDS = (
    "1_Краткосрочные объявления", "2_Среднесрочные объявления", "3_Долгосрочные объявления",
)
OPENED, CLOSED = "Месяц размещения объявления", "Месяц снятия объявления"


def _unit_price() -> Column:
    return safe_ratio(F.col("last_price").cast("double"), F.col("total_area").cast("double"))


def _means(*columns: str) -> list[Column]:
    unit = mean(_unit_price()).alias("avg_cost_per_meter")
    return [unit, *[mean(F.col(c)).alias(f"avg_{c}") for c in columns]]


def duration_profile(
    flats: DataFrame, ads: DataFrame, cities: DataFrame, types: DataFrame,
    capital: str = CAPITAL, town: str = TOWN, region_towns: str = REGION_TOWNS,
) -> DataFrame:
    """Closed listings without outliers, by region and time on the market.

    Both regions come from one pass with a label, and the share from the group counts.
    """
    region = F.when(F.col("city") == capital, F.lit(capital)).when(
        (F.col("city") != capital) & (F.col("type") == town), F.lit(region_towns)
    )
    band = three_bands(F.col("days_exposition"), 30, 95, DURATION_BANDS)
    rows = (
        percentile_trim(flats, FLAT_TRIMS)
        .join(ads.filter(F.col("days_exposition").isNotNull()), "id")
        .join(cities, "city_id").join(types, "type_id", "left")
        .withColumn("region", region).filter(F.col("region").isNotNull())
    )
    groups = rows.groupBy("region", band.alias("exposition_category")).agg(
        F.count("id").alias("flats_count"), *_means("total_area", "rooms", "balcony")
    )
    total = F.sum("flats_count").over(Window.partitionBy("region"))
    return groups.withColumn("share_into_region", ratio(F.col("flats_count"), total, 2))


def seasonality(
    flats: DataFrame, ads: DataFrame, types: DataFrame, town: str = TOWN,
    first_year: int = 2015, last_year: int = 2018,
) -> DataFrame:
    """Openings and closings by month: count, rank, share, mean unit price and area.

    A listing gives one row per event. Both kinds are limited by the year of opening, stated as
    a date range so that file statistics can skip data.
    """
    span = F.col("first_day_exposition").between(
        F.make_date(F.lit(first_year), F.lit(1), F.lit(1)),
        F.make_date(F.lit(last_year), F.lit(12), F.lit(31)),
    )
    rows = (
        ads.filter(span).join(flats.select("id", "type_id", "total_area"), "id")
        .join(types.filter(F.col("type") == town), "type_id")
    )
    return _months(rows)


def seasonality_overview(flats: DataFrame, ads: DataFrame) -> DataFrame:
    """The same for all listings and years, without rank and share."""
    rows = ads.join(flats.select("id", "total_area"), "id")
    return _months(rows).drop("rank", "share_into_month")


def _months(rows: DataFrame) -> DataFrame:
    closing = add_days(F.col("first_day_exposition"), F.col("days_exposition").cast("double"))
    opened = F.struct(
        F.lit(OPENED).alias("month_category"), F.month("first_day_exposition").alias("month"),
        F.lit(True).alias("happened"),
    )
    closed = F.struct(
        F.lit(CLOSED).alias("month_category"), F.month(closing).alias("month"),
        F.col("days_exposition").isNotNull().alias("happened"),
    )
    months = (
        rows.select("id", "last_price", "total_area", F.inline(F.array(opened, closed)))
        .filter("happened")
        .groupBy("month_category", "month")
        .agg(F.count("id").alias("adv_count"), *_means("total_area"))
    )
    kind = Window.partitionBy("month_category")
    total = F.sum("adv_count").over(kind)
    return months.withColumn(
        "rank", F.rank().over(kind.orderBy(F.col("adv_count").desc())).cast("long")
    ).withColumn("share_into_month", ratio(F.col("adv_count"), total, 2))


def top_places(
    flats: DataFrame, ads: DataFrame, cities: DataFrame, capital: str = CAPITAL, k: int = 15
) -> DataFrame:
    """The places outside the capital with most listings: closed share, duration, prices."""
    rows = (
        percentile_trim(flats, FLAT_TRIMS).join(ads, "id")
        .join(cities.filter(F.col("city") != capital), "city_id")
    )
    removed = F.count(F.when(F.col("days_exposition").isNotNull(), F.col("id")))
    places = rows.groupBy("city").agg(
        F.count("id").alias("adv_count"),
        ratio(removed, F.count("id"), 2).alias("share_of_removed"),
        mean(F.col("days_exposition")).alias("avg_days_exposition"),
        *_means("total_area", "rooms", "balcony"),
    )
    return top_k(places, k, "adv_count", ["city"])
