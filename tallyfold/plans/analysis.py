"""Outliers, segments, distributions, association and cross tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import normalize_text
from ..jobs import venues as venue_jobs
from ..operators import (
    association_row, binned, boxplot_stats, collapse_segments, contingency_table, cramers_v,
    drop_outlier_entities, growing_keys, histogram, iqr_null_upper, iqr_outliers, percentile_trim,
    phik_matrix, pivot_count, pivot_sum, size_classes, span_class, top_k_with_ties,
)
from .phik_sql import phik_sql
from .registry import query

TRIMMED = """
    limits AS (SELECT quantile_disc(total_area, 0.99) AS area, quantile_disc(rooms, 0.99) AS rooms,
                      quantile_disc(balcony, 0.99) AS balcony,
                      quantile_disc(ceiling_height, 0.99) AS high,
                      quantile_disc(ceiling_height, 0.01) AS low FROM flats),
    trimmed AS (SELECT f.* FROM flats f, limits l
                WHERE f.total_area < l.area AND (f.rooms < l.rooms OR f.rooms IS NULL)
                  AND (f.balcony < l.balcony OR f.balcony IS NULL)
                  AND ((f.ceiling_height < l.high AND f.ceiling_height > l.low)
                       OR f.ceiling_height IS NULL))"""


@query("percentile_trim", f"""
    WITH {TRIMMED}
    SELECT id, city_id, type_id, total_area, rooms, balcony, ceiling_height FROM trimmed""")
def _(t):
    return percentile_trim(t("flats")).select(
        "id", "city_id", "type_id", "total_area", "rooms", "balcony", "ceiling_height")


SIZED = """
    sizes AS (SELECT market AS m, COUNT(*) AS size FROM rounds WHERE market IS NOT NULL
              GROUP BY market),
    collapsed AS (SELECT r.* REPLACE (CASE WHEN s.size < 35 THEN 'niche' WHEN s.size <= 120
                                           THEN 'mid' ELSE r.market END AS market),
                         CASE WHEN s.size > 120 THEN 'Массовые' WHEN s.size >= 35 THEN 'Средние'
                              WHEN s.size IS NOT NULL THEN 'Нишевые' END AS segment_category
                  FROM rounds r LEFT JOIN sizes s ON r.market = s.m)"""


def _fenced(rows):
    return f"""
    quartiles AS (SELECT market AS m, quantile_cont(funding_total_usd, 0.25) AS q1,
                         quantile_cont(funding_total_usd, 0.75) AS q3
                  FROM {rows} WHERE market IS NOT NULL GROUP BY market),
    flagged AS (SELECT r.*, COALESCE(funding_total_usd > q3 + (q3 - q1) * 1.5
                                     OR funding_total_usd < q1 - (q3 - q1) * 1.5, FALSE) AS odd
                FROM {rows} r LEFT JOIN quartiles ON r.market = m)"""


@query("iqr_outliers", f"""
    WITH {_fenced('rounds')}
    SELECT market, COUNT(market) AS n_rows, COUNT(name) FILTER (WHERE odd) AS n_outliers,
           COUNT(name) FILTER (WHERE odd) / NULLIF(CAST(COUNT(market) AS DOUBLE), 0) AS share
    FROM flagged GROUP BY market""")
def _(t):
    return iqr_outliers(t("rounds"), "market", "funding_total_usd", "name")


@query("top_outlier_segments", f"""
    WITH {_fenced('rounds')},
    s AS (SELECT market, COUNT(name) FILTER (WHERE odd) / CAST(COUNT(market) AS DOUBLE) AS share
          FROM flagged WHERE market IS NOT NULL GROUP BY market)
    SELECT market, share FROM (SELECT *, RANK() OVER (ORDER BY share DESC) AS r FROM s) WHERE r <= 15""")
def _(t):
    shares = iqr_outliers(t("rounds"), "market", "funding_total_usd", "name")
    return top_k_with_ties(shares, 15, "share").select("market", "share")


@query("top_outlier_collapsed", f"""
    WITH {SIZED}, {_fenced('collapsed')},
    s AS (SELECT market, COUNT(name) FILTER (WHERE odd) / CAST(COUNT(market) AS DOUBLE) AS share
          FROM flagged WHERE market IS NOT NULL GROUP BY market)
    SELECT market, share FROM (SELECT *, RANK() OVER (ORDER BY share DESC) AS r FROM s) WHERE r <= 15""")
def _(t):
    merged = collapse_segments(t("rounds"), "market")
    shares = iqr_outliers(merged, "market", "funding_total_usd", "name")
    return top_k_with_ties(shares.filter(F.col("market").isNotNull()), 15, "share").select("market", "share")


@query("drop_outlier_entities", f"""
    WITH {_fenced('rounds')}
    SELECT id, name, market, funding_total_usd FROM rounds
    WHERE name NOT IN (SELECT name FROM flagged WHERE odd)""")
def _(t):
    kept = drop_outlier_entities(t("rounds"), "market", "funding_total_usd", "name")
    return kept.select("id", "name", "market", "funding_total_usd")


@query("iqr_null_upper", """
    WITH f AS (SELECT event_type AS e, quantile_cont(value, 0.25) AS q1,
                      quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
    SELECT event_id, event_type, CASE WHEN NOT value > q3 + (q3 - q1) * 1.5 THEN value END AS value
    FROM events JOIN f ON event_type = e""")
def _(t):
    return iqr_null_upper(t("events").select("event_id", "event_type", "value"), "event_type", "value")


@query("segment_size_class", f"""
    WITH {SIZED}
    SELECT m AS market, size AS n, CASE WHEN size > 120 THEN 'Массовые' WHEN size >= 35
           THEN 'Средние' ELSE 'Нишевые' END AS size_class FROM sizes""")
def _(t):
    return size_classes(t("rounds"), "market")


@query("collapse_segments", f"WITH {SIZED} SELECT id, market, segment_category FROM collapsed")
def _(t):
    return collapse_segments(t("rounds").select("id", "market"), "market")


@query("span_class", """
    SELECT id, CASE WHEN funding_rounds = 1 THEN 'Единичное финансирование'
                    WHEN last_funding_at IS NULL THEN 'Вне описанных категорий'
                    WHEN last_funding_at - first_funding_at <= 365
                    THEN 'Срок финансирования до года'
                    ELSE 'Срок финансирования более года' END AS span FROM rounds""")
def _(t):
    spans = span_class(F.col("funding_rounds"), F.col("first_funding_at"), F.col("last_funding_at"))
    return t("rounds").select("id", spans.alias("span"))


@query("histogram", """
    WITH e AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) - MIN(o_totalprice) AS w FROM orders),
    b AS (SELECT CAST(least(floor((o_totalprice - lo) / w * 100), 99) AS BIGINT) AS bin,
                 COUNT(*) AS n FROM orders, e GROUP BY 1)
    SELECT CAST(i AS BIGINT) AS bin, lo + w * i / 100 AS lower, lo + w * (i + 1) / 100 AS upper,
           COALESCE(n, 0) AS n
    FROM e, range(100) r(i) LEFT JOIN b ON b.bin = i""")
def _(t):
    return histogram(t("orders"), "o_totalprice", 100)


@query("boxplot_stats", """
    WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                      quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT ANY_VALUE(q1) AS q1, ANY_VALUE(median) AS median, ANY_VALUE(q3) AS q3,
           MIN(value) FILTER (WHERE value >= q1 - (q3 - q1) * 1.5 AND value <= q3 + (q3 - q1) * 1.5)
               AS whisker_low,
           MAX(value) FILTER (WHERE value >= q1 - (q3 - q1) * 1.5 AND value <= q3 + (q3 - q1) * 1.5)
               AS whisker_high,
           COUNT(*) FILTER (WHERE value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5)
               AS n_outliers
    FROM events, q""")
def _(t):
    return boxplot_stats(t("events"), "value")


_NOMINAL, _INTERVAL = ("category", "district", "price_cat"), ("rating", "seats")
_BINNED = """
    binned AS (SELECT category, district, price_cat,
        CAST(CAST(least(floor((rating - (SELECT MIN(rating) FROM venues))
             / (SELECT MAX(rating) - MIN(rating) FROM venues) * 10), 9) AS BIGINT) AS VARCHAR) AS rating,
        CASE WHEN seats IS NOT NULL THEN CAST(CAST(least(floor((CAST(seats AS DOUBLE) - (SELECT MIN(seats) FROM venues))
             / (SELECT MAX(seats) - MIN(seats) FROM venues) * 10), 9) AS BIGINT) AS VARCHAR) END AS seats
        FROM venues)"""


def _cells(columns):
    return "cells AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS left_column, '{b}' AS right_column, {a} AS left_value, {b} AS right_value, "
        f"COUNT(*) AS n FROM binned WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}"
        for a, b in combinations(columns, 2)
    ) + ")"


_CELLS = _cells((*_NOMINAL, *_INTERVAL))
_BOTH_WAYS = """
    SELECT left_column, right_column, phik FROM solved
    UNION ALL SELECT right_column, left_column, phik FROM solved"""


@query("contingency_table", f"WITH {_BINNED}, {_CELLS} SELECT * FROM cells")
def _(t):
    rows = binned(t("venues"), _NOMINAL, _INTERVAL)
    return contingency_table(rows, [*_NOMINAL, *_INTERVAL])


@query("cramers_v", f"""
    WITH {_BINNED}, {_CELLS},
    l AS (SELECT left_column, right_column, left_value, SUM(n) AS r FROM cells GROUP BY 1, 2, 3),
    r AS (SELECT left_column, right_column, right_value, SUM(n) AS c FROM cells GROUP BY 1, 2, 3),
    x AS (SELECT cells.left_column, cells.right_column, CAST(SUM(n) AS BIGINT) AS n,
                 SUM(CAST(n AS DOUBLE) * n / (r * c)) - 1 AS phi2,
                 least(COUNT(DISTINCT left_value), COUNT(DISTINCT right_value)) - 1 AS k
          FROM cells JOIN l USING (left_column, right_column, left_value)
          JOIN r USING (left_column, right_column, right_value) GROUP BY 1, 2)
    SELECT left_column, right_column, n, round(sqrt(greatest(phi2, 0) / k), 6) AS cramers_v FROM x""")
def _(t):
    rows = binned(t("venues"), _NOMINAL, _INTERVAL)
    table = cramers_v(contingency_table(rows, [*_NOMINAL, *_INTERVAL]))
    return table.withColumn("cramers_v", F.round("cramers_v", 6))


@query("phik_matrix", phik_sql(f"{_BINNED}, {_CELLS}", _BOTH_WAYS), digits={"phik": 6})
def _(t):
    return phik_matrix(t("venues"), _NOMINAL, _INTERVAL)


_RATED = ("category", "district", "price_cat", "is_24_7"), ("rating", "chain", "seats")
_RATED_SQL = """
    clean AS (SELECT category, district, price_cat, rating, CAST(chain AS DOUBLE) AS chain, CAST(seats AS DOUBLE) AS seats,
                     CAST(COALESCE(trim(lower(hours)) = 'ежедневно, круглосуточно', FALSE) AS VARCHAR) AS is_24_7 FROM venues),
    ends AS (SELECT MIN(rating) AS r0, MAX(rating) AS r1, MIN(chain) AS c0, MAX(chain) AS c1, MIN(seats) AS s0, MAX(seats) AS s1 FROM clean),
    binned AS (SELECT category, district, price_cat, is_24_7, """ + ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN CAST(COALESCE(least(floor(({c} - {k}0) / NULLIF({k}1 - {k}0, 0) * 10), 9), 0) AS BIGINT) END AS {c}"
        for c, k in (("rating", "r"), ("chain", "c"), ("seats", "s"))) + " FROM clean, ends)"
_RATED_CELLS = _cells((*_RATED[0], *_RATED[1]))


def _rated(t):
    """The columns whose link with the rating is asked for, types as the cleaned table has them."""
    venues = t("venues").withColumn("hours", normalize_text(F.col("hours")))
    return venues.withColumn("is_24_7", venue_jobs.is_24_7()).select(*_RATED[0], *_RATED[1])


@query("phik_rated_venues", phik_sql(f"{_RATED_SQL}, {_RATED_CELLS}", _BOTH_WAYS), digits={"phik": 6})
def _(t):
    return phik_matrix(_rated(t))


@query("phik_row_of_rating", phik_sql(f"{_RATED_SQL}, {_RATED_CELLS}", f"""
    SELECT right_column AS column_name, phik FROM ({_BOTH_WAYS})
    WHERE left_column = 'rating' ORDER BY phik DESC, right_column"""), digits={"phik": 6})
def _(t):
    return association_row(phik_matrix(_rated(t)), "rating")


@query("phik_distance_bill", phik_sql("""
    v AS (SELECT CAST(CASE district WHEN 'Центральный административный округ' THEN 0
                 WHEN 'Западный административный округ' THEN 1
                 WHEN 'Северный административный округ' THEN 4 ELSE 8 END AS DOUBLE) AS distance,
          CAST(middle_of_bill_range AS DOUBLE) AS bill FROM venues),
    ends AS (SELECT MIN(distance) AS d0, MAX(distance) AS d1, MIN(bill) AS b0, MAX(bill) AS b1 FROM v),
    binned AS (SELECT CAST(least(floor((distance - d0) / (d1 - d0) * 10), 9) AS BIGINT) AS distance,
                      CASE WHEN bill IS NOT NULL THEN CAST(least(floor((bill - b0) / (b1 - b0) * 10), 9) AS BIGINT) END AS middle_of_bill_range
               FROM v, ends), """ + _cells(("distance", "middle_of_bill_range")), """
    SELECT right_column AS column_name, phik FROM (SELECT 'middle_of_bill_range' AS l, left_column AS right_column, phik FROM solved)"""),
    digits={"phik": 6})
def _(t):
    rows = t("venues").select(venue_jobs.distance().alias("distance"), "middle_of_bill_range")
    return association_row(phik_matrix(rows), "middle_of_bill_range")


@query("mean_by_ordinal", f"""
    WITH v AS (SELECT CAST(CASE district WHEN 'Центральный административный округ' THEN 0
                           WHEN 'Западный административный округ' THEN 1
                           WHEN 'Северный административный округ' THEN 4 ELSE 8 END AS INTEGER)
                      AS distance, middle_of_bill_range AS bill FROM venues)
    SELECT distance, AVG(bill) AS mean FROM v GROUP BY distance""", digits={"mean": 6})
def _(t):
    placed = t("venues").withColumn("distance", venue_jobs.distance())
    return venue_jobs.mean_by(placed, "distance", "middle_of_bill_range")


def _pivot(expression):
    return ", ".join(expression.format(v=v) for v in ("BUILDING", "MACHINERY", "NOTHING"))


@query("pivot_count", "SELECT district, " + _pivot(
    "NULLIF(COUNT(name) FILTER (WHERE category = '{v}'), 0) AS {v}"
) + " FROM venues WHERE district IS NOT NULL GROUP BY district")
def _(t):
    return pivot_count(t("venues"), "district", "category", ["BUILDING", "MACHINERY", "NOTHING"], "name")


@query("pivot_count_zero", "SELECT district, " + _pivot(
    "COUNT(name) FILTER (WHERE category = '{v}') AS {v}"
) + " FROM venues WHERE district IS NOT NULL GROUP BY district")
def _(t):
    return pivot_count(
        t("venues"), "district", "category", ["BUILDING", "MACHINERY", "NOTHING"], "name", True)


_YEARS = tuple(range(2000, 2017))


@query("pivot_sum", "SELECT market, " + ", ".join(
    f'SUM(funding_total_usd) FILTER (WHERE year(first_funding_at) = {y}) AS "{y}"' for y in _YEARS
) + " FROM rounds WHERE market IS NOT NULL GROUP BY market", digits={str(y): 2 for y in _YEARS})
def _(t):
    rounds = t("rounds").withColumn("year", F.year("first_funding_at"))
    return pivot_sum(rounds, "market", "year", _YEARS, "funding_total_usd")


@query("growth_filter", """
    SELECT o_custkey,
           SUM(o_totalprice) FILTER (WHERE year(o_orderdate) = 1998) AS earlier,
           SUM(o_totalprice) FILTER (WHERE year(o_orderdate) = 1999) AS later
    FROM orders GROUP BY o_custkey HAVING later > earlier""", digits={"earlier": 2, "later": 2})
def _(t):
    orders = t("orders").select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    return growing_keys(orders, "o_custkey", "year", "o_totalprice", 1998, 1999)


@query("unpivot_long", """
    UNPIVOT (SELECT s_suppkey, s_acctbal AS balance, CAST(s_nationkey AS DOUBLE) AS nation
             FROM supplier) ON balance, nation INTO NAME measure VALUE amount""")
def _(t):
    supplier = t("supplier").select(
        "s_suppkey", F.col("s_acctbal").alias("balance"),
        F.col("s_nationkey").cast("double").alias("nation"))
    return supplier.unpivot("s_suppkey", ["balance", "nation"], "measure", "amount")
