"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (
    add_days, age_band, age_years, bin_half_open, day_diff, exact_amount, midpoint, narrow_to_byte,
    narrow_to_short, normalize_text, ordinal_lookup, parse_date, parse_number, round_half_up,
    safe_ratio, strip_separators, three_bands,
)
from ..jobs.estate import DURATION_BANDS
from ..jobs.games import CRITIC_EDGES, SCORE_LABELS
from ..jobs.venues import DISTRICT_DISTANCE, FARTHEST
from ..operators import narrowest_types
from .registry import query


@query("normalize_text", """
    SELECT id, trim(lower(name)) AS name, trim(lower(hours)) AS hours FROM venue_info""")
def _(t):
    return t("venue_info").select(
        "id", normalize_text(F.col("name")).alias("name"),
        normalize_text(F.col("hours")).alias("hours"))


@query("strip_separators", """
    SELECT o_orderkey, replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', '')
           AS amount FROM orders""")
def _(t):
    grouped = F.format_number(F.floor("o_totalprice"), 0)
    return t("orders").select("o_orderkey", strip_separators(grouped).alias("amount"))


@query("parse_number", """
    SELECT name, platform, TRY_CAST(eu_sales AS DOUBLE) AS eu_sales,
           TRY_CAST(user_score AS DOUBLE) AS user_score FROM games""")
def _(t):
    return t("games").select(
        "name", "platform", parse_number(F.col("eu_sales")).alias("eu_sales"),
        parse_number(F.col("user_score")).alias("user_score"))


@query("parse_date", """
    SELECT o_orderkey, CAST(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END
                            AS VARCHAR) AS day FROM orders""")
def _(t):
    text = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("bad "), "o_orderkey")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t("orders").select("o_orderkey", parse_date(text, min_date="1700-01-01").alias("day"))


@query("narrow_cast", """
    SELECT p_partkey, CAST(p_size AS SMALLINT) AS size16, CAST(p_size AS TINYINT) AS size8
    FROM part""")
def _(t):
    return t("part").select(
        "p_partkey", narrow_to_short(F.col("p_size")).alias("size16"),
        narrow_to_byte(F.col("p_size")).alias("size8"))


def _narrowest(column):
    least, most = f"MIN({column})", f"MAX({column})"
    fits = " ".join(
        f"WHEN {least} >= {-(1 << bits - 1)} AND {most} <= {(1 << bits - 1) - 1} THEN '{name}'"
        for name, bits in (("tinyint", 8), ("smallint", 16), ("int", 32)))
    whole = f"COUNT(*) FILTER (WHERE {column} <> FLOOR({column})) > 0"
    return f"SELECT '{column}' AS column_name, CASE WHEN {whole} THEN 'double' {fits} ELSE 'bigint' END AS type FROM lineitem"


_MEASURES = ("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("narrowest_types", " UNION ALL ".join(_narrowest(c) for c in _MEASURES))
def _(t):
    return narrowest_types(t("lineitem"), _MEASURES)


@query("date_truncate", """
    SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month,
           CAST(CAST(date_trunc('year', o_orderdate) AS DATE) AS VARCHAR) AS year FROM orders""")
def _(t):
    return t("orders").select(
        "o_orderkey", F.trunc("o_orderdate", "month").alias("month"),
        F.trunc("o_orderdate", "year").alias("year"))


@query("date_part", """
    SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month,
           CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""")
def _(t):
    return t("orders").select(
        "o_orderkey", F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year"))


@query("date_add_days", """
    SELECT id, CAST(first_day_exposition + CAST(days_exposition AS INTEGER) AS VARCHAR)
           AS last_day_exposition FROM ads""")
def _(t):
    last = add_days(F.col("first_day_exposition"), F.col("days_exposition"))
    return t("ads").select("id", last.alias("last_day_exposition"))


@query("date_diff_days", """
    SELECT id, CAST(last_funding_at - first_funding_at AS INTEGER) AS days FROM rounds""")
def _(t):
    days = day_diff(F.col("last_funding_at"), F.col("first_funding_at"))
    return t("rounds").select("id", days.alias("days"))


@query("date_midpoint", """
    SELECT id, CAST(CAST(first_funding_at AS TIMESTAMP)
                    + to_hours(CAST(last_funding_at - first_funding_at AS BIGINT) * 12) AS VARCHAR)
               AS middle FROM rounds""")
def _(t):
    middle = midpoint(F.col("first_funding_at"), F.col("last_funding_at"))
    return t("rounds").select("id", middle.alias("middle"))


_AGE = """CAST(year(DATE '2025-02-28') - year(birth_date)
          - CASE WHEN month(birth_date) * 100 + day(birth_date) > 228 THEN 1 ELSE 0 END AS INTEGER)"""


@query("age_years", f"SELECT id, {_AGE} AS age FROM donors")
def _(t):
    age = age_years(F.col("birth_date"), F.lit("2025-02-28").cast("date"))
    return t("donors").select("id", age.alias("age"))


@query("fill_null", """
    SELECT id, COALESCE(region, 'Регион не указан') AS region, COALESCE(gender, 'Пол не указан')
           AS gender FROM donors""")
def _(t):
    return t("donors").select("id", "region", "gender").fillna(
        {"region": "Регион не указан", "gender": "Пол не указан"})


@query("round_decimal", """
    SELECT l_orderkey, l_linenumber,
           CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(8,4)), 2)
                AS DOUBLE) AS commission FROM lineitem""")
def _(t):
    exact = exact_amount(F.col("l_extendedprice") * F.col("l_discount"))
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", round_half_up(exact, 2).alias("commission"))


@query("unit_price", """
    SELECT a.id, CASE WHEN total_area <> 0 THEN last_price / total_area END AS unit_price
    FROM ads a JOIN flats f ON a.id = f.id""")
def _(t):
    price = safe_ratio(F.col("last_price").cast("double"), F.col("total_area"))
    return t("ads").join(t("flats"), "id").select("id", price.alias("unit_price"))


_BAND = """CASE WHEN days_exposition < 30 THEN '1_Краткосрочные объявления'
           WHEN days_exposition > 95 THEN '3_Долгосрочные объявления'
           WHEN days_exposition IS NOT NULL THEN '2_Среднесрочные объявления' END"""


@query("case_bands", f"SELECT id, days_exposition, {_BAND} AS band FROM ads")
def _(t):
    band = three_bands(F.col("days_exposition"), 30, 95, DURATION_BANDS)
    return t("ads").select("id", "days_exposition", band.alias("band"))


@query("age_bands", f"""
    WITH a AS (SELECT id, {_AGE} AS age FROM donors)
    SELECT id, CASE WHEN age < 18 THEN 'Error' WHEN age <= 25 THEN '18–25 лет'
                    WHEN age <= 35 THEN '26–35 лет' WHEN age <= 45 THEN '36–45 лет'
                    WHEN age <= 55 THEN '46–55 лет' WHEN age > 55 THEN 'Старше 55'
                    ELSE 'No info' END AS age_group FROM a""")
def _(t):
    age = age_years(F.col("birth_date"), F.lit("2025-02-28").cast("date"))
    return t("donors").select("id", age_band(age).alias("age_group"))


@query("bin_half_open", """
    SELECT name, critic_score,
           CASE WHEN critic_score >= 0 AND critic_score < 30 THEN 'низкая оценка'
                WHEN critic_score >= 30 AND critic_score < 80 THEN 'средняя оценка'
                WHEN critic_score >= 80 AND critic_score < 100 THEN 'высокая оценка' END AS as_coded,
           CASE WHEN critic_score >= 0 AND critic_score < 30 THEN 'низкая оценка'
                WHEN critic_score >= 30 AND critic_score < 80 THEN 'средняя оценка'
                WHEN critic_score >= 80 AND critic_score <= 100 THEN 'высокая оценка' END AS closed
    FROM games""")
def _(t):
    score = F.col("critic_score")
    return t("games").select(
        "name", "critic_score", bin_half_open(score, CRITIC_EDGES, SCORE_LABELS).alias("as_coded"),
        bin_half_open(score, CRITIC_EDGES, SCORE_LABELS, include_top=True).alias("closed"))


@query("ordinal_lookup", """
    SELECT id, district, CAST(CASE district WHEN 'Центральный административный округ' THEN 0
        WHEN 'Западный административный округ' THEN 1 WHEN 'Северный административный округ' THEN 4
        ELSE 8 END AS INTEGER) AS distance FROM venue_info""")
def _(t):
    rank = ordinal_lookup(F.col("district"), DISTRICT_DISTANCE, FARTHEST)
    return t("venue_info").select("id", "district", rank.alias("distance"))


@query("replace_value", """
    SELECT name, platform, CASE WHEN rating = 'K-A' THEN 'E' ELSE rating END AS rating,
           NULLIF(other_sales, 1) AS other_sales FROM games""")
def _(t):
    replaced = t("games").select("name", "platform", "rating", "other_sales").replace(
        {"K-A": "E"}, subset=["rating"])
    return replaced.withColumn("other_sales", F.nullif("other_sales", F.lit(1.0)))


@query("safe_ratio", """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS strict_ratio,
           l_tax / (l_discount + 1e-60) AS shifted_ratio FROM lineitem""")
def _(t):
    tax, discount = F.col("l_tax"), F.col("l_discount")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", safe_ratio(tax, discount).alias("strict_ratio"),
        safe_ratio(tax, discount, 1e-60).alias("shifted_ratio"))
