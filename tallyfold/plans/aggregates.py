"""Aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import mean, parse_number, ratio, total
from ..jobs import games, vacancies, venues
from ..operators import (
    categorical_crosscount, count_bitmaps, describe_column, exact_quantiles, fill_group_mean, group_median,
    id_bitmaps, join_on_keys, per_column_totals, running_max, share_where, sum_share, top_k_with_ties, value_counts,
    wide_sum, with_group_size, with_share,
)
from ..operators.quantiles import column_quantiles
from .registry import query, ratio2, same_rows
from .standins import ROUND_TYPES


@query("group_count", "SELECT region, COUNT(id) AS count_of_donors FROM donors GROUP BY region")
def _(t):
    return t("donors").groupBy("region").agg(F.count("id").alias("count_of_donors"))


@query("group_count_nonnull_key", """
    SELECT region, COUNT(id) AS n FROM donors WHERE region IS NOT NULL GROUP BY region""")
def _(t):
    return t("donors").filter(F.col("region").isNotNull()).groupBy("region").agg(
        F.count("id").alias("n"))


@query("distinct_count", """
    SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers
    FROM lineitem GROUP BY l_returnflag""")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"),
        F.count_distinct("l_suppkey").alias("suppliers"))


@same_rows("distinct_count_bitmaps", "distinct_count")
def _(t):
    lines, key = t("lineitem"), ["l_returnflag"]
    parts = count_bitmaps(id_bitmaps(lines, key, "l_partkey"), key, "parts")
    suppliers = count_bitmaps(id_bitmaps(lines, key, "l_suppkey"), key, "suppliers")
    return join_on_keys(parts, suppliers, key)


@query("filtered_aggregate", f"""
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
           COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchases,
           {ratio2("COUNT(*) FILTER (WHERE event_type = 'purchase')", 'COUNT(*)')} AS share
    FROM events GROUP BY 1""")
def _(t):
    bought = F.col("event_type") == "purchase"
    return t("events").groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.count_if(bought).alias("purchases"), share_where(bought, 2).alias("share"))


@query("group_sum", """
    SELECT l_suppkey, SUM(l_extendedprice) AS revenue
    FROM lineitem GROUP BY l_suppkey""", digits={"revenue": 2})
def _(t):
    return t("lineitem").groupBy("l_suppkey").agg(total(F.col("l_extendedprice")).alias("revenue"))


@query("group_avg", """
    SELECT district, AVG(middle_of_bill_range) AS avg_bill, AVG(rating) AS avg_rating
    FROM venues GROUP BY district""", digits={"avg_bill": 6, "avg_rating": 6})
def _(t):
    return t("venues").groupBy("district").agg(
        mean(F.col("middle_of_bill_range")).alias("avg_bill"),
        mean(F.col("rating")).alias("avg_rating"))


def _whole_mean(c):
    n = f"(SUM(CAST({c} AS DECIMAL(18,2))) * 100)"
    return (f"CAST((2 * CAST({n} AS HUGEINT) + 100 * COUNT({c})) // (200 * COUNT({c})) AS DOUBLE)")


@query("global_range", f"""
    SELECT {_whole_mean('salary_from')} AS average_salary_from,
           ROUND(MIN(salary_from)) AS min_salary_from, ROUND(MAX(salary_from)) AS max_salary_from,
           {_whole_mean('salary_to')} AS average_salary_to,
           ROUND(MIN(salary_to)) AS min_salary_to, ROUND(MAX(salary_to)) AS max_salary_to
    FROM vacancies""")
def _(t):
    return vacancies.salary_span(t("vacancies"))


@query("group_median", """
    SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS median FROM part GROUP BY p_brand""")
def _(t):
    return group_median(t("part"), "p_brand", "p_retailprice")


@query("two_level_aggregate", """
    SELECT n AS orders_per_user, COUNT(*) AS users FROM
    (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n""")
def _(t):
    per_user = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders_per_user"))
    return per_user.groupBy("orders_per_user").agg(F.count(F.lit(1)).alias("users"))


@query("group_by_expression", """
    SELECT CAST(EXTRACT(MONTH FROM o_orderdate) AS INTEGER) AS month,
           o_totalprice >= 250000 AS large, COUNT(*) AS n FROM orders GROUP BY 1, 2""")
def _(t):
    return t("orders").groupBy(
        F.month("o_orderdate").alias("month"), (F.col("o_totalprice") >= 250000).alias("large")
    ).agg(F.count(F.lit(1)).alias("n"))


def _mean2(c):
    n = f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) * 100 AS HUGEINT)"
    return f"(CAST((2 * {n} + COUNT({c})) // (2 * COUNT({c})) AS DOUBLE) / 100)"


@query("multi_key_summary", f"""
    SELECT employer, schedule, employment, {_mean2('salary_from')} AS avg_salary_from,
           {_mean2('salary_to')} AS avg_salary_to, COUNT(id) AS number_of_vacancies
    FROM vacancies GROUP BY employer, schedule, employment
    ORDER BY number_of_vacancies DESC, employer, schedule, employment LIMIT 10""")
def _(t):
    return vacancies.employer_conditions(t("vacancies"))


_AREA_P = (0.01, 0.5, 0.99)


@query("percentile_disc", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS p, "
    f"CAST(quantile_disc({c}, {p}) AS DOUBLE) AS q FROM flats"
    for c in ("total_area", "rooms", "balcony", "ceiling_height") for p in _AREA_P
))
def _(t):
    return column_quantiles(
        t("flats"), ["total_area", "rooms", "balcony", "ceiling_height"], _AREA_P, "discrete")


@query("quantile_linear", " UNION ALL ".join(
    f"SELECT l_returnflag, CAST({p} AS DOUBLE) AS p, quantile_cont(l_extendedprice, {p}) AS q "
    "FROM lineitem GROUP BY l_returnflag" for p in (0.25, 0.5, 0.75, 0.95)
))
def _(t):
    return exact_quantiles(
        t("lineitem"), "l_extendedprice", [0.25, 0.5, 0.75, 0.95], ["l_returnflag"])


@query("describe_column", """
    WITH v AS (SELECT value FROM events),
    s AS (SELECT 1 AS position, 'count' AS stat, CAST(COUNT(value) AS DOUBLE) AS value FROM v
    UNION ALL SELECT 2, 'mean', AVG(value) FROM v
    UNION ALL SELECT 3, 'std', stddev_samp(value) FROM v
    UNION ALL SELECT 4, 'min', MIN(value) FROM v
    UNION ALL SELECT 5, '25%', quantile_cont(value, 0.25) FROM v
    UNION ALL SELECT 6, '50%', quantile_cont(value, 0.5) FROM v
    UNION ALL SELECT 7, '75%', quantile_cont(value, 0.75) FROM v
    UNION ALL SELECT 8, '95%', quantile_cont(value, 0.95) FROM v
    UNION ALL SELECT 9, '99%', quantile_cont(value, 0.99) FROM v
    UNION ALL SELECT 10, 'max', MAX(value) FROM v)
    SELECT CAST(position AS INTEGER) AS position, stat, round(value, 5) AS value FROM s""")
def _(t):
    stats = describe_column(t("events"), "value", (0.25, 0.5, 0.75, 0.95, 0.99))
    return stats.withColumn("value", F.round("value", 5))


@query("share_of_total", f"""
    SELECT lang, COUNT(*) AS n,
           {ratio2('COUNT(*)', '(SELECT COUNT(*) FROM documents)')} AS share
    FROM documents GROUP BY lang""")
def _(t):
    counts = t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts, "n", digits=2)


@query("null_share", f"""
    SELECT {ratio2('COUNT(id) - COUNT(region)', 'COUNT(id)')} AS share_of_nullregion FROM donors""")
def _(t):
    missing = F.count("id") - F.count("region")
    return t("donors").agg(ratio(missing, F.count("id"), 2).alias("share_of_nullregion"))


_FLAGS, _STATUSES = ("A", "N", "R", "X"), ("F", "O", "P")


@query("categorical_crosscount", """
    SELECT a.f AS l_returnflag, b.s AS l_linestatus, COUNT(l.l_orderkey) AS n
    FROM (SELECT unnest(['A', 'N', 'R', 'X']) AS f) a,
         (SELECT unnest(['F', 'O', 'P']) AS s) b
    LEFT JOIN lineitem l ON l.l_returnflag = a.f AND l.l_linestatus = b.s
    GROUP BY 1, 2""")
def _(t):
    return categorical_crosscount(
        t("lineitem"), "l_returnflag", _FLAGS, "l_linestatus", _STATUSES, "l_orderkey")


@query("value_counts_share", """
    SELECT rating, COUNT(*) AS n,
           COUNT(*) / CAST((SELECT COUNT(rating) FROM games) AS DOUBLE) AS share
    FROM games WHERE rating IS NOT NULL GROUP BY rating""")
def _(t):
    return value_counts(t("games"), "rating")


@query("named_aggregates", """
    SELECT name, category, COUNT(name) AS cnt, AVG(rating) AS avg
    FROM venues WHERE chain = 1 GROUP BY name, category""", digits={"avg": 6})
def _(t):
    return venues.chains(t("venues"))


def _sums(columns):
    return ", ".join(
        f"COALESCE(SUM({c}), 0) AS {c}" for c in columns)


@query("wide_sum_by_year", f"""
    SELECT CAST(year(first_funding_at) AS INTEGER) AS year, {_sums(ROUND_TYPES)}
    FROM rounds WHERE first_funding_at IS NOT NULL GROUP BY 1""", digits={c: 2 for c in ROUND_TYPES})
def _(t):
    rounds = t("rounds").withColumn("year", F.year("first_funding_at"))
    return wide_sum(rounds, "year", ROUND_TYPES)


@query("per_column_totals", " UNION ALL ".join(
    f"SELECT '{c}' AS type, COALESCE(SUM({c}), 0) AS total, "
    f"COUNT(*) FILTER (WHERE {c} > 0) AS frequency FROM rounds" for c in ROUND_TYPES
), digits={"total": 2})
def _(t):
    return per_column_totals(t("rounds"), ROUND_TYPES)


@query("sum_share", """
    SELECT market, SUM(funding_total_usd) AS total, SUM(funding_total_usd)
           / (SELECT SUM(funding_total_usd) FROM rounds WHERE market IS NOT NULL) AS share
    FROM rounds WHERE market IS NOT NULL GROUP BY market""", digits={"total": 2, "share": 9})
def _(t):
    return sum_share(t("rounds"), "market", "funding_total_usd")


@query("rank_over_aggregate", """
    SELECT CAST(EXTRACT(MONTH FROM o_orderdate) AS INTEGER) AS month, COUNT(*) AS n,
           RANK() OVER (ORDER BY COUNT(*) DESC) AS rank
    FROM orders GROUP BY 1""")
def _(t):
    # Twelve rows: the window comes after the aggregate.
    months = t("orders").groupBy(F.month("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))
    by_count = Window.orderBy(F.col("n").desc())
    return months.withColumn("rank", F.rank().over(by_count).cast("long"))


@query("running_max", """
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(DISTINCT user_id) AS users,
           MAX(COUNT(DISTINCT user_id)) OVER (ORDER BY CAST(ts AS DATE)) AS running_max
    FROM events GROUP BY CAST(ts AS DATE)""")
def _(t):
    days = t("events").groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.count_distinct("user_id").alias("users"))
    return running_max(
        days.withColumn("__at", F.unix_date("day")), "users", "__at").drop("__at")


@query("running_max_by_cohort", """
    SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(DISTINCT user_id) AS users,
           MAX(COUNT(DISTINCT user_id)) OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE))
               AS running_max
    FROM events GROUP BY event_type, CAST(ts AS DATE)""")
def _(t):
    days = t("events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(
        F.count_distinct("user_id").alias("users"))
    return running_max(
        days.withColumn("__at", F.unix_date("day")), "users", "__at", ["event_type"]).drop("__at")


@query("impute_group_mean", """
    WITH g AS (SELECT name, platform, year_of_release, na_sales,
                      TRY_CAST(eu_sales AS DOUBLE) AS eu_sales FROM games),
    m AS (SELECT platform AS p, year_of_release AS y, AVG(eu_sales) AS mean FROM g
          GROUP BY platform, year_of_release)
    SELECT name, platform, year_of_release, na_sales, COALESCE(eu_sales, mean) AS eu_sales
    FROM g LEFT JOIN m ON platform = p AND year_of_release = y""", digits={"eu_sales": 6})
def _(t):
    parsed = t("games").select(
        "name", "platform", "year_of_release", "na_sales",
        parse_number(F.col("eu_sales")).alias("eu_sales"))
    return fill_group_mean(parsed, "eu_sales", ["platform", "year_of_release"])


@query("group_size_per_row", """
    SELECT r.id, r.market, n AS group_size FROM rounds r
    LEFT JOIN (SELECT market AS m, COUNT(*) AS n FROM rounds WHERE market IS NOT NULL
               GROUP BY market) ON market = m""")
def _(t):
    return with_group_size(t("rounds").select("id", "market"), "market")


@query("sort_multi_key", """
    SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
    ORDER BY r_name, n_name DESC""")
def _(t):
    joined = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_name", "r_name").orderBy("r_name", F.col("n_name").desc())


@query("top_k", """
    SELECT employer, COUNT(id) AS number_of_vacancies FROM vacancies GROUP BY employer
    ORDER BY number_of_vacancies DESC, employer LIMIT 12""")
def _(t):
    return vacancies.vacancies_by(t("vacancies"), "employer", 12)


@query("top_k_with_ties", """
    SELECT l_suppkey, n FROM (
        SELECT l_suppkey, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC) AS r
        FROM lineitem GROUP BY l_suppkey) WHERE r <= 15""")
def _(t):
    counts = t("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return top_k_with_ties(counts, 15, "n")


@query("union_all", """
    SELECT 'поступило' AS month_category, CAST(EXTRACT(MONTH FROM o_orderdate) AS INTEGER) AS month,
           COUNT(*) AS n, AVG(o_totalprice) AS avg_price FROM orders GROUP BY 2
    UNION ALL
    SELECT 'выполнено', CAST(EXTRACT(MONTH FROM o_orderdate) AS INTEGER), COUNT(*),
           AVG(o_totalprice) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2""", digits={"avg_price": 6})
def _(t):
    def months(rows, label):
        return rows.groupBy(F.month("o_orderdate").alias("month")).agg(
            F.lit(label).alias("month_category"), F.count(F.lit(1)).alias("n"),
            mean(F.col("o_totalprice")).alias("avg_price"))

    orders = t("orders")
    return months(orders, "поступило").unionByName(
        months(orders.filter("o_orderstatus = 'F'"), "выполнено"))


@query("union_distinct", """
    SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000
    UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000""")
def _(t):
    rich = t("customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    firms = t("supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return rich.union(firms).distinct()


@query("top_platforms", """
    SELECT platform, COUNT(*) AS n FROM games WHERE platform IS NOT NULL GROUP BY platform
    ORDER BY n DESC, platform LIMIT 7""")
def _(t):
    return games.top_platforms(t("games"))
