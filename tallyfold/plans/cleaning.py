"""Gaps, duplicates and plausibility checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import midpoint, starts_with
from ..jobs import games
from ..operators import (
    TableProfile, count_duplicates, dedup_keep_first, domain_check, duplicate_groups, hidden_duplicates,
    implausible_dates, key_uniqueness, missing_share_by, missing_stats, missingness_rule,
    period_completeness, row_loss_report, unfill_sentinel,
)
from .registry import query, ratio2

_VENUE_GAPS = ("district", "hours", "seats", "price_cat", "bill_range", "middle_of_bill_range",
               "middle_of_coffee_cup_price")


@query("missing_stats", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing, "
    f"(COUNT(*) - COUNT({c})) / CAST(COUNT(*) AS DOUBLE) AS share FROM venues"
    for c in ("id", "name", "rating", *_VENUE_GAPS)
) + ") WHERE missing > 0")
def _(t):
    return missing_stats(t("venues"))


@query("missing_share_by_group", "SELECT category, " + ", ".join(
    f"(COUNT(*) - COUNT({c})) / CAST(COUNT(*) AS DOUBLE) AS {c}" for c in _VENUE_GAPS
) + " FROM venues WHERE category IS NOT NULL GROUP BY category")
def _(t):
    return missing_share_by(t("venues").select("category", *_VENUE_GAPS), "category")


@query("fill_sentinel", """
    SELECT id, COALESCE(CAST(seats AS DOUBLE), -1) AS seats, COALESCE(hours, 'неизвестно') AS hours
    FROM venues""")
def _(t):
    venues = t("venues").select("id", F.col("seats").cast("double").alias("seats"), "hours")
    return venues.fillna({"seats": -1, "hours": "неизвестно"})


@query("unfill_sentinel", "SELECT id, CAST(seats AS DOUBLE) AS seats FROM venues")
def _(t):
    filled = t("venues").select("id", F.col("seats").cast("double").alias("seats")).fillna({"seats": -1})
    return unfill_sentinel(filled, -1.0, ["seats"])


@query("fill_midpoint", """
    SELECT id, CAST(COALESCE(CAST(mid_funding_at AS TIMESTAMP), CAST(first_funding_at AS TIMESTAMP)
           + to_hours(CAST(last_funding_at - first_funding_at AS BIGINT) * 12)) AS VARCHAR)
           AS mid_funding_at FROM rounds""")
def _(t):
    middle = midpoint(F.col("first_funding_at"), F.col("last_funding_at"))
    known = F.col("mid_funding_at").cast("timestamp_ntz")
    return t("rounds").select("id", F.coalesce(known, middle).alias("mid_funding_at"))


@query("drop_null_rows", "SELECT id, rating, seats FROM (SELECT id, rating, CAST(seats AS DOUBLE) "
       "AS seats FROM venues) WHERE seats IS NOT NULL")
def _(t):
    return t("venues").select("id", "rating", F.col("seats").cast("double").alias("seats")).dropna(
        subset=["seats"])


@query("dedup_full_row", """
    SELECT COUNT(*) AS n_distinct, CAST(SUM(n) AS BIGINT) AS n_rows,
           CAST(SUM(n - 1) AS BIGINT) AS n_extra
    FROM (SELECT text, lang, COUNT(*) AS n FROM documents GROUP BY text, lang)""")
def _(t):
    return count_duplicates(t("documents").select("text", "lang"))


@query("dedup_all_columns", """
    SELECT COUNT(*) AS n_distinct, CAST(SUM(n) AS BIGINT) AS n_rows,
           CAST(SUM(n - 1) AS BIGINT) AS n_extra
    FROM (SELECT COLUMNS(*), COUNT(*) AS n FROM (
        SELECT * FROM games UNION ALL SELECT * FROM games WHERE length(name) % 7 = 0) GROUP BY ALL)""")
def _(t):
    copied = t("games").unionAll(t("games").filter(F.length("name") % 7 == 0))
    return count_duplicates(copied)


@query("dedup_keep_first", """
    SELECT doc_id, source, n_chars, text FROM documents
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def _(t):
    return dedup_keep_first(
        t("documents").select("doc_id", "source", "n_chars", "text"), ["text"], "doc_id")


@query("duplicate_groups", """
    SELECT doc_id, source FROM documents QUALIFY COUNT(*) OVER (PARTITION BY text) > 1""")
def _(t):
    return duplicate_groups(t("documents").select("doc_id", "source", "text"), ["text"]).drop("text")


@query("hidden_duplicates", """
    SELECT COUNT(DISTINCT name) AS n_raw, COUNT(DISTINCT trim(lower(name))) AS n_normalized
    FROM venue_info""")
def _(t):
    return hidden_duplicates(t("venue_info"), "name")


@query("row_loss_report", f"""
    SELECT COUNT(*) AS n_before, COUNT(o) AS n_after, COUNT(*) - COUNT(o) AS n_lost,
           {ratio2('100 * (COUNT(*) - COUNT(o))', 'COUNT(*)')} AS pct_lost
    FROM (SELECT donation_added_date AS o FROM donations)""")
def _(t):
    donations = t("donations")
    return row_loss_report(donations, donations.dropna(subset=["donation_added_date"]))


@query("missingness_rule", """
    WITH v AS (SELECT middle_of_bill_range IS NULL AS gap,
                      NOT COALESCE(starts_with(bill_range, 'Средний счёт'), FALSE) AS rule FROM venues)
    SELECT COUNT(*) FILTER (WHERE gap) AS n_missing, COUNT(*) FILTER (WHERE rule) AS n_expected,
           COUNT(*) FILTER (WHERE gap <> rule) AS n_mismatch FROM v""")
def _(t):
    expected = ~starts_with(F.col("bill_range"), "Средний счёт")
    return missingness_rule(t("venues"), "middle_of_bill_range", expected)


@query("domain_check", """
    SELECT rating AS value, COUNT(*) AS n, COALESCE(rating IN ('E', 'T', 'M'), FALSE) AS allowed
    FROM games GROUP BY rating""")
def _(t):
    return domain_check(t("games"), "rating", ["E", "T", "M"])


@query("period_completeness", """
    SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS day, COUNT(o_orderkey) AS n
    FROM generate_series(DATE '2001-07-01', DATE '2001-08-31', INTERVAL 1 DAY) g(day)
    LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(day AS DATE) GROUP BY 1""")
def _(t):
    return period_completeness(t("orders"), "o_orderdate", "2001-07-01", "2001-08-31")


@query("key_uniqueness", """
    SELECT CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) AS n_keys, MAX(n) = 1 AS is_unique
    FROM (SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2)""")
def _(t):
    return key_uniqueness(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("implausible_dates", """
    SELECT CAST(year(d) AS INTEGER) AS year, CAST(MIN(d) AS VARCHAR) AS first_day,
           CAST(MAX(d) AS VARCHAR) AS last_day, COUNT(*) AS n,
           COUNT(*) FILTER (WHERE d NOT BETWEEN DATE '1996-01-01' AND DATE '2001-06-30')
               AS n_implausible
    FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY 1""")
def _(t):
    return implausible_dates(
        t("lineitem"), F.col("l_shipdate").cast("date"), "1996-01-01", "2001-06-30")


@query("table_profile", """
    WITH l AS (SELECT l_orderkey, l_linenumber, NULLIF(l_returnflag, 'A') AS l_returnflag, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem)
    SELECT 'missing' AS report, 'l_returnflag' AS item, COUNT(*) - COUNT(l_returnflag) AS n, FALSE AS good FROM l
    UNION ALL SELECT 'value', l_returnflag, COUNT(*), COALESCE(l_returnflag IN ('N', 'X'), FALSE) FROM l GROUP BY l_returnflag
    UNION ALL SELECT 'key', 'l_orderkey, l_linenumber', COUNT(DISTINCT (l_orderkey, l_linenumber)),
              COUNT(DISTINCT (l_orderkey, l_linenumber)) = COUNT(*) FROM l
    UNION ALL SELECT 'key', 'l_orderkey', COUNT(DISTINCT l_orderkey), COUNT(DISTINCT l_orderkey) = COUNT(*) FROM l
    UNION ALL SELECT 'year', CAST(year(l_shipdate) AS VARCHAR), COUNT(*) FILTER (WHERE l_shipdate NOT BETWEEN DATE '1996-01-01' AND DATE '2001-06-30'),
              bool_and(l_shipdate BETWEEN DATE '1996-01-01' AND DATE '2001-06-30') FROM l GROUP BY year(l_shipdate)""", owned=True)
def _(t):
    lines = t("lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("A")).alias("l_returnflag"), F.col("l_shipdate").cast("date").alias("l_shipdate"))
    keys = ["l_orderkey", "l_linenumber"]
    profile = TableProfile(lines, values=["l_returnflag"], keys=[keys, keys[:1]],
                           days={"shipped": (F.col("l_shipdate"), "1996-01-01", "2001-06-30")})
    row = lambda report, item, n, good: [F.lit(report).alias("report"), item.alias("item"), n.alias("n"), good.alias("good")]
    out = profile.missing_stats().select(row("missing", F.col("column_name"), F.col("missing"), F.lit(False)))
    out = out.unionByName(profile.domain_check("l_returnflag", ["N", "X"]).select(row("value", F.col("value"), F.col("n"), F.col("allowed"))))
    for k in (keys, keys[:1]):
        out = out.unionByName(profile.key_uniqueness(k).select(row("key", F.lit(", ".join(k)), F.col("n_keys"), F.col("is_unique"))))
    years = profile.implausible_dates("shipped")
    return out.unionByName(years.select(row("year", F.col("year").cast("string"), F.col("n_implausible"), F.col("n_implausible") == 0)))


_RAW_NAMES = {
    "name": "Name", "platform": "Platform", "year_of_release": "Year of Release", "genre": "Genre",
    "na_sales": "NA sales", "eu_sales": "EU sales", "jp_sales": "JP sales",
    "other_sales": "Other sales", "critic_score": "Critic Score", "user_score": "User Score",
    "rating": "Rating",
}
_CLEAN_GAMES = """
    WITH g AS (SELECT name, platform, year_of_release, lower(genre) AS genre, na_sales,
                      TRY_CAST(eu_sales AS DOUBLE) AS eu, TRY_CAST(jp_sales AS DOUBLE) AS jp,
                      other_sales, COALESCE(critic_score, -1) AS critic_score,
                      COALESCE(TRY_CAST(user_score AS DOUBLE), -1) AS user_score,
                      CASE WHEN rating = 'K-A' THEN 'E' ELSE rating END AS rating FROM games),
    m AS (SELECT platform AS p, year_of_release AS y, AVG(eu) AS eu_mean,
                 AVG(jp) AS jp_mean FROM g GROUP BY 1, 2),
    clean AS (SELECT DISTINCT name, platform,
                     CAST(COALESCE(year_of_release, 0) AS SMALLINT) AS year_of_release, genre,
                     na_sales, COALESCE(eu, eu_mean) AS eu_sales, COALESCE(jp, jp_mean) AS jp_sales,
                     other_sales, critic_score, user_score, rating
              FROM g LEFT JOIN m ON platform = p AND year_of_release = y)"""


@query("clean_games", _CLEAN_GAMES + " SELECT * FROM clean", digits={"eu_sales": 6, "jp_sales": 6})
def _(t):
    return games.clean_games(t("games").withColumnsRenamed(_RAW_NAMES))


@query("score_crosscount", _CLEAN_GAMES + """,
    c AS (SELECT name, CASE WHEN user_score >= 0 AND user_score < 3 THEN 'низкая оценка'
                            WHEN user_score >= 3 AND user_score < 8 THEN 'средняя оценка'
                            WHEN user_score >= 8 AND user_score < 10 THEN 'высокая оценка' END AS u,
                 CASE WHEN critic_score >= 0 AND critic_score < 30 THEN 'низкая оценка'
                      WHEN critic_score >= 30 AND critic_score < 80 THEN 'средняя оценка'
                      WHEN critic_score >= 80 AND critic_score < 100 THEN 'высокая оценка' END AS k
          FROM clean WHERE year_of_release BETWEEN 2000 AND 2013),
    l AS (SELECT unnest(['низкая оценка', 'средняя оценка', 'высокая оценка']) AS x)
    SELECT a.x AS categories_users, b.x AS categories_critics, COUNT(c.name) AS n
    FROM l a, l b LEFT JOIN c ON c.u = a.x AND c.k = b.x GROUP BY 1, 2""")
def _(t):
    cleaned = games.clean_games(t("games").withColumnsRenamed(_RAW_NAMES))
    return games.score_crosscount(games.with_score_categories(cleaned))
