"""Donors: volume, loyalty, channels, bonus programme, planning and age.

``users``: id, region, gender, birth_date, confirmed_donations and yes/no channel columns.
``donations``: id, user_id, donation_date, confirmation, donation_added_date, plan_date.
``bonus``: user_id, donation_count, user_bonus_count.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import age_band, age_years, ratio
from ..operators.aggregates import top_k

# Channel columns and the names they are reported under; other labels.
CHANNELS = {
    "autho_vk": "ВКонтакте", "autho_ok": "Одноклассники", "autho_tg": "Телеграм",
    "autho_yandex": "Яндекс", "autho_google": "Google",
}
BONUS_USED, BONUS_NOT_USED = "Использовали бонусы", "Не использовали бонусы"
NO_REGION, NO_GENDER = "Регион не указан", "Пол не указан"


def mean2(total: Column, count: Column) -> Column:
    """Mean with two digits, rounded in decimal."""
    return ratio(total, count, 2)


def donors_by_region(users: DataFrame, k: int = 10) -> DataFrame:
    counts = users.groupBy("region").agg(F.count("id").alias("count_of_donors"))
    named = counts.withColumn("region", F.coalesce("region", F.lit(NO_REGION)))
    return top_k(named, k, "count_of_donors", ["region"])


def monthly_volume(donations: DataFrame, start: str, end: str) -> DataFrame:
    span = F.col("donation_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    month = F.trunc("donation_date", "month").alias("month")
    return donations.filter(span).groupBy(month).agg(F.count("id").alias("count_of_donations"))


def daily_volume(donations: DataFrame, month: str) -> DataFrame:
    """Donations per day of the month that starts on the given date; empty days are not listed."""
    first = F.lit(month).cast("date")
    inside = (F.col("donation_date") >= first) & (F.col("donation_date") < F.add_months(first, 1))
    return donations.filter(inside).groupBy("donation_date").agg(
        F.count("id").alias("count_of_donations")
    )


def most_active_users(donations: DataFrame, k: int = 10) -> DataFrame:
    """Users by number of confirmed and registered donations."""
    counted = donations.filter(
        F.col("confirmation") & F.col("donation_added_date").isNotNull()
    ).groupBy("user_id").agg(F.count("donation_date").alias("count_of_donations"))
    return top_k(counted, k, "count_of_donations", ["user_id"])


def treated_vs_rest(users: DataFrame, bonus: DataFrame) -> DataFrame:
    """Count and mean donations of bonus users, and of users without a bonus on record."""
    treated = bonus.agg(
        F.lit(BONUS_USED).alias("bonus_status"), F.count("user_id").alias("n_users"),
        mean2(F.sum("donation_count"), F.count("donation_count")).alias("avg_donations"),
    )
    rest = (
        users.join(bonus.select(F.col("user_id").alias("id"), "user_bonus_count"), "id", "left")
        .filter(F.col("user_bonus_count").isNull())
        .agg(
            F.lit(BONUS_NOT_USED).alias("bonus_status"), F.count("id").alias("n_users"),
            mean2(F.sum("confirmed_donations"), F.count("confirmed_donations"))
            .alias("avg_donations"),
        )
    )
    return treated.unionByName(rest)


def channel_summary(users: DataFrame, channels: Mapping[str, str] = CHANNELS) -> DataFrame:
    """Users and mean donations per linked channel; one user may count in several.

    One pass for all channels. Every channel is listed, also with no users.
    """
    row = users.agg(*[
        F.struct(
            F.lit(name).alias("social_media"),
            F.count(F.when(F.col(flag), F.col("id"))).alias("count_of_users"),
            mean2(
                F.sum(F.when(F.col(flag), F.col("confirmed_donations"))),
                F.count(F.when(F.col(flag), F.col("confirmed_donations"))),
            ).alias("avg_donations"),
        ).alias(flag)
        for flag, name in channels.items()
    ])
    return row.select(F.inline(F.array(*channels)))


def one_time_vs_repeat(donations: DataFrame) -> DataFrame:
    """Users with exactly one donation, and the mean of those with more, in one row."""
    per_user = donations.groupBy("user_id").agg(F.count("donation_date").alias("n"))
    more = F.col("n") > 1
    return per_user.agg(
        F.count(F.when(F.col("n") == 1, F.col("user_id"))).alias("one_time_users"),
        mean2(F.sum(F.when(more, F.col("n"))), F.count_if(more)).alias("avg_of_repeat_users"),
    )


def plan_accuracy(donations: DataFrame) -> DataFrame:
    """How many donations took place on the planned date, and their share of all."""
    same = F.count(F.when(F.col("donation_date") == F.col("plan_date"), F.col("id")))
    return donations.agg(
        same.alias("same_date"), ratio(same, F.count("id")).alias("share_same_date")
    )


def activity_by_age_band(users: DataFrame, as_of: str) -> DataFrame:
    """Mean donations by gender and age band, for users who donated."""
    age = age_years(F.col("birth_date"), F.lit(as_of).cast("date"))
    groups = users.filter(F.col("confirmed_donations") > 0).groupBy(
        "gender", age_band(age).alias("age_group")
    )
    return groups.agg(
        mean2(F.sum("confirmed_donations"), F.count("id")).alias("avg_donations")
    ).withColumn("gender", F.coalesce("gender", F.lit(NO_GENDER)))


def activity_frequency(donations: DataFrame, users: DataFrame, start: str, end: str) -> DataFrame:
    """Donations per month of a period, by gender.

    The number of months counts both ends. Donations are counted per user before users are joined.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) + 1
    per_user = donations.filter(F.col("donation_date").between(first, last)).groupBy(
        "user_id"
    ).agg(F.count("id").alias("n"))
    joined = per_user.join(users.select(F.col("id").alias("user_id"), "gender"), "user_id")
    return joined.groupBy("gender").agg(
        F.count("user_id").alias("n_users"), F.sum("n").alias("n_donations"),
        mean2(F.sum("n"), months).alias("per_month"),
    ).withColumn("gender", F.coalesce("gender", F.lit(NO_GENDER)))
