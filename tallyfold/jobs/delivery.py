"""Delivery service: activity, conversion, average check, lifetime value, retention.

``events``: user_id, city_id, log_date, first_date, order_id, revenue, commission, rest_id,
object_id. ``cities``: city_id, city_name. ``partners``: rest_id, city_id, chain, type.
``dishes``: object_id, rest_id, name, spicy, fish, meat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import day_diff, exact_amount, number, ratio
from ..operators.aggregates import running_max, top_k
from ..operators.bitmaps import common_bitmaps, count_bitmaps, id_bitmaps
from ..operators.ranges import range_join
from ..session import settle


def _in_city(events: DataFrame, cities: DataFrame, city: str | None) -> DataFrame:
    if city is None:
        return events
    wanted = cities.filter(F.col("city_name") == city).select("city_id")
    return events.join(wanted, "city_id")


def _between(column: str, start: str, end: str) -> Column:
    return F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def dau(
    events: DataFrame, cities: DataFrame, start: str, end: str, city: str | None = None
) -> DataFrame:
    """``(log_date, dau)``: distinct registered users with an order, per day."""
    active = events.filter(
        _between("log_date", start, end) & F.col("order_id").isNotNull()
    ).select("log_date", "user_id", "city_id")
    return _in_city(active, cities, city).groupBy("log_date").agg(
        F.count_distinct("user_id").alias("dau")
    )


def conversion_rate(
    events: DataFrame, cities: DataFrame, start: str, end: str, city: str | None = None
) -> DataFrame:
    """``(log_date, cr)``: share of the day's registered visitors who ordered, two digits.

    One row per day and user first, so that two distinct counts need no expanded rows.
    """
    visits = events.filter(_between("log_date", start, end))
    per_user = _in_city(visits, cities, city).groupBy("log_date", "user_id").agg(
        F.count("order_id").alias("orders")
    )
    visitors = F.count("user_id")
    buyers = F.count(F.when(F.col("orders") > 0, F.col("user_id")))
    return per_user.groupBy("log_date").agg(ratio(buyers, visitors, 2).alias("cr"))


def with_commission(events: DataFrame, start: str, end: str) -> DataFrame:
    """Paid events of a period with the service's income from each, of any number of digits."""
    income = number(F.col("revenue")) * number(F.col("commission"))
    return events.filter(
        F.col("revenue").isNotNull() & _between("log_date", start, end)
    ).withColumn("commission_revenue", income)


def _income() -> Column:
    """Income of one key, from its rows, in decimal."""
    return exact_amount(F.sum("commission_revenue")).alias("commission_revenue")


def _ltv() -> Column:
    """Income of several keys, in two digits."""
    return F.round(F.sum("commission_revenue"), 2).cast("double").alias("ltv")


def average_check(
    events: DataFrame, cities: DataFrame, start: str, end: str, city: str | None = None
) -> DataFrame:
    """``(month, average_check)``: commission per distinct order.

    Orders are summed first: a long order collapses before the shuffle, and the distinct count
    becomes a plain one.
    """
    paid = _in_city(with_commission(events, start, end), cities, city)
    orders = paid.groupBy(F.trunc("log_date", "month").alias("month"), "order_id").agg(
        _income().alias("income")
    )
    income = F.sum("income").cast("decimal(28,6)")
    check = F.round(F.try_divide(income, F.count("order_id").cast("decimal(20,0)")), 2)
    return orders.groupBy("month").agg(check.cast("double").alias("average_check"))


def partner_ltv(paid: DataFrame, partners: DataFrame) -> DataFrame:
    """Commission per partner with its attributes.

    Income is summed per partner key before the join, so attributes meet one row per partner.
    """
    return _partner_ltv(paid.groupBy("rest_id", "city_id").agg(_income()), partners)


def _partner_ltv(income: DataFrame, partners: DataFrame) -> DataFrame:
    return (
        income.join(partners.select("rest_id", "city_id", "chain", "type"), ["rest_id", "city_id"])
        .groupBy("rest_id", "chain", "type").agg(_ltv())
    )


def ltv_top_partners(
    events: DataFrame, cities: DataFrame, partners: DataFrame, start: str, end: str,
    city: str | None = None, k: int = 3,
) -> DataFrame:
    paid = _in_city(with_commission(events, start, end), cities, city)
    return top_k(partner_ltv(paid, partners), k, "ltv", ["rest_id"])


def ltv_top_items(
    events: DataFrame, cities: DataFrame, partners: DataFrame, dishes: DataFrame,
    start: str, end: str, city: str | None = None, k_partners: int = 2, k_items: int = 5,
) -> DataFrame:
    """The best items of the best partners, with partner and item attributes.

    The income per item is read three times, so it is written once; it is all the later steps need
    of the log.
    """
    income = settle(
        _in_city(with_commission(events, start, end), cities, city)
        .groupBy("rest_id", "city_id", "object_id")
        .agg(_income()),
        "income",
    )
    per_partner = income.groupBy("rest_id", "city_id").agg(F.sum("commission_revenue").alias("commission_revenue"))
    best = top_k(_partner_ltv(per_partner, partners), k_partners, "ltv", ["rest_id"])
    items = top_k(
        income.join(F.broadcast(best.select("rest_id")), "rest_id", "left_semi")
        .groupBy("object_id").agg(_ltv()),
        k_items, "ltv", ["object_id"],
    )
    return (
        income.join(F.broadcast(items.select("object_id")), "object_id", "left_semi")
        .join(dishes, ["object_id", "rest_id"])
        .join(partners.select("rest_id", "city_id", "chain"), ["rest_id", "city_id"])
        .groupBy("chain", "name", "spicy", "fish", "meat").agg(_ltv())
    )


def daily_retention(
    events: DataFrame, cities: DataFrame, new_from: str, new_to: str, active_from: str,
    active_to: str, city: str | None = None, days: int = 8,
) -> DataFrame:
    """``(user_id, first_date, day_since_install)`` of returning users, first ``days`` days.

    Both sides are made distinct before they meet, and the day limit is part of the join, so a
    user brings at most one row per pair of days whatever the number of events.
    """
    log = _in_city(events.filter(F.col("user_id").isNotNull()), cities, city)
    new = log.filter(_between("first_date", new_from, new_to)).select("first_date", "user_id")
    active = log.filter(_between("log_date", active_from, active_to)).select("log_date", "user_id")
    offset = day_diff(F.col("log_date"), F.col("first_date"))
    return (
        new.distinct().join(active.distinct(), "user_id")
        .filter(offset.between(0, days - 1))
        .select("user_id", "first_date", offset.alias("day_since_install"))
    )


def daily_retention_binned(
    events: DataFrame, cities: DataFrame, new_from: str, new_to: str, active_from: str,
    active_to: str, city: str | None = None, days: int = 8,
) -> DataFrame:
    """The rows of ``daily_retention``, joined by user and bin of days.

    A user with very many days is dealt to as many tasks as there are bins.
    """
    log = _in_city(events.filter(F.col("user_id").isNotNull()), cities, city)
    new = log.filter(_between("first_date", new_from, new_to)).select("first_date", "user_id").distinct()
    active = log.filter(_between("log_date", active_from, active_to)).select("log_date", "user_id").distinct()
    met = range_join(new, active, "user_id", "first_date", "log_date", 0, days - 1)
    return met.select("user_id", "first_date", day_diff(F.col("log_date"), F.col("first_date")).alias("day_since_install"))


def user_bitmaps(events: DataFrame, day: str, user: str = "user_id") -> DataFrame:
    """``(day, bucket, bitmap)``: which users, numbered without large gaps, have a row on each day.

    A table to keep: bitmaps of new days are added to it, and every count below reads it alone. A day on which no
    row has a user has none of them.
    """
    return id_bitmaps(events.filter(F.col(day).isNotNull()), [day], user, keep_keys=True)


def dau_of_bitmaps(active: DataFrame) -> DataFrame:
    """``(log_date, dau)`` of the bitmaps of users with an order."""
    return count_bitmaps(active, ["log_date"], "dau")


def retention_of_bitmaps(first: DataFrame, active: DataFrame, by_month: bool = False, days: int = 8) -> DataFrame:
    """``retention`` from bitmaps of new users by ``first_date`` and of active ones by ``log_date``."""
    offset = F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day_since_install")
    asked = first.select("*", offset).withColumn("log_date", F.date_add("first_date", F.col("day_since_install")))
    kept = common_bitmaps(asked, active, ["log_date"]).withColumn("month", F.trunc("first_date", "month"))
    keys = ["month"] if by_month else []
    curve = count_bitmaps(kept, [*keys, "day_since_install"], "retained_users").filter("retained_users > 0")
    return _with_rate(curve, keys)


def retention(daily: DataFrame, by_month: bool = False) -> DataFrame:
    """Distinct users per day since the first visit, and their share of the curve's highest
    value so far; ``by_month`` gives one curve per month of first visit."""
    keys = ["month"] if by_month else []
    rows = daily.withColumn("month", F.trunc("first_date", "month"))
    curve = rows.groupBy(*keys, "day_since_install").agg(
        F.count_distinct("user_id").alias("retained_users")
    )
    return _with_rate(curve, keys)


def _with_rate(curve: DataFrame, keys: list[str]) -> DataFrame:
    peaked = running_max(curve, "retained_users", "day_since_install", keys, "__peak")
    rate = ratio(F.col("retained_users"), F.col("__peak"), 2)
    return peaked.select(*keys, "day_since_install", "retained_users", rate.alias("retention_rate"))
