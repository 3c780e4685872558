"""The tables of the jobs, expressed on the supplied tables.

The jobs need a delivery log, flats, vacancies, donors, games, venues and start-ups. Each is a
view over the supplied tables, in SQL that Spark and the checking engine both read; ``{name}``
stands for a supplied table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources import TABLES, load

VIEWS = {
    # One row per user and day, so that a busy user is small before any join.
    "visit_days": """
        SELECT user_id, CAST(ts AS DATE) AS log_date,
               MAX(CASE WHEN event_type = 'purchase' THEN event_id END) AS order_id
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "visits": """
        SELECT CASE WHEN c.c_acctbal >= 0 THEN d.user_id END AS user_id,
               c.c_nationkey AS city_id, d.log_date, d.order_id,
               MIN(d.log_date) OVER (PARTITION BY d.user_id) AS first_date
        FROM {visit_days} d JOIN {customer} c ON d.user_id = c.c_custkey""",
    "service_cities": """
        SELECT n_nationkey AS city_id, r_name AS city_name
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "sales": """
        SELECT o.o_custkey AS user_id, c.c_nationkey AS city_id,
               CAST(o.o_orderdate AS DATE) AS log_date, l.l_orderkey AS order_id,
               l.l_suppkey AS rest_id, l.l_partkey AS object_id,
               l.l_extendedprice AS revenue, l.l_discount AS commission
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
        JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "partners": """
        SELECT s_suppkey AS rest_id, s_nationkey AS city_id, s_name AS chain,
               CASE WHEN s_acctbal < 5000 THEN 'Кафе' ELSE 'Ресторан' END AS type
        FROM {supplier}""",
    "dishes": """
        SELECT l.l_partkey AS object_id, l.l_suppkey AS rest_id, p.p_name AS name,
               CASE WHEN p.p_name LIKE 'hot%' THEN 1 ELSE 0 END AS spicy,
               CASE WHEN p.p_name LIKE '%ring' THEN 1 ELSE 0 END AS fish,
               CASE WHEN p.p_name LIKE '%rod' THEN 1 ELSE 0 END AS meat
        FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem}) l
        JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "flats": """
        SELECT o.o_orderkey AS id, c.c_nationkey AS city_id, c.c_mktsegment AS type_id,
               l.total_area, l.rooms, l.balcony, l.ceiling_height
        FROM {orders} o
        JOIN {customer} c ON o.o_custkey = c.c_custkey
        JOIN (SELECT l_orderkey, SUM(l_quantity) AS total_area, COUNT(*) AS rooms,
                     NULLIF(COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END), 0) AS balcony,
                     CASE WHEN COUNT(CASE WHEN l_linestatus = 'F' THEN 1 END) IN (0, COUNT(*))
                          THEN 2.5e0 + MAX(l_tax) END AS ceiling_height
              FROM {lineitem} GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey""",
    "ads": """
        SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS first_day_exposition,
               CASE WHEN o_orderstatus <> 'O' THEN CAST(FLOOR(o_totalprice / 4000) AS DOUBLE) END
                   AS days_exposition,
               o_totalprice AS last_price
        FROM {orders}""",
    "flat_cities": "SELECT n_nationkey AS city_id, n_name AS city FROM {nation}",
    "flat_types": """
        SELECT DISTINCT c_mktsegment AS type_id, c_mktsegment AS type FROM {customer}""",
    "vacancies": """
        SELECT p_partkey AS id, p_name AS name, p_brand AS employer, p_type AS experience,
               CASE WHEN p_size <= 25 THEN 'Полный день' WHEN p_size <= 40 THEN 'Удаленная работа'
                    ELSE 'Гибкий график' END AS schedule,
               CASE WHEN p_retailprice < 905 THEN 'Стажировка' ELSE 'Полная занятость' END
                   AS employment,
               CASE WHEN p_type <> 'SMALL' THEN p_retailprice END AS salary_from,
               CASE WHEN p_size > 10 THEN p_retailprice + p_size END AS salary_to,
               split_part(p_name, ' ', 1) AS key_skills_1,
               split_part(p_name, ' ', 2) AS key_skills_2,
               NULLIF(p_type, 'PROMO') AS key_skills_3,
               CASE WHEN p_size > 25 THEN p_brand END AS key_skills_4,
               LOWER(p_type) AS soft_skills_1,
               NULLIF(split_part(p_name, ' ', 1), 'red') AS soft_skills_2,
               CASE WHEN p_size < 5 THEN ' ' ELSE LOWER(p_brand) END AS soft_skills_3,
               CASE WHEN p_size = 50 THEN split_part(p_name, ' ', 2) END AS soft_skills_4
        FROM {part}""",
    "donations": """
        SELECT o_orderkey AS id, o_custkey AS user_id,
               CAST(o_orderdate AS DATE) AS donation_date, o_orderstatus <> 'P' AS confirmation,
               CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END
                   AS donation_added_date,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(o_orderdate AS DATE)
                    WHEN o_orderpriority = '3-MEDIUM' THEN CAST(o_orderdate AS DATE) + 7 END
                   AS plan_date
        FROM {orders}""",
    "donors": """
        SELECT c.c_custkey AS id, CASE WHEN c.c_acctbal >= 0 THEN n.n_name END AS region,
               CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Мужской' WHEN 'FURNITURE' THEN 'Женский'
                    WHEN 'MACHINERY' THEN 'Женский' END AS gender,
               CASE WHEN c.c_acctbal < 9000
                    THEN DATE '1950-01-01' + CAST(FLOOR(c.c_acctbal * 2.5 + 2600) AS INTEGER) END
                   AS birth_date,
               COALESCE(d.n, 0) AS confirmed_donations,
               c.c_acctbal > 5000 AS autho_vk, c.c_acctbal < 500 AS autho_ok,
               c.c_mktsegment = 'BUILDING' AS autho_tg, n.n_regionkey = 2 AS autho_yandex,
               CASE WHEN c.c_acctbal > 0 THEN n.n_regionkey = 3 END AS autho_google
        FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
        LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM {orders} WHERE o_orderstatus = 'F'
                   GROUP BY o_custkey) d ON c.c_custkey = d.o_custkey""",
    "bonus": """
        SELECT o_custkey AS user_id, COUNT(*) AS donation_count,
               NULLIF(COUNT(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END), 0)
                   AS user_bonus_count
        FROM {orders} WHERE o_orderstatus = 'P' GROUP BY o_custkey""",
    "games": """
        SELECT p_name AS name, p_brand AS platform,
               CASE WHEN p_size < 48 THEN CAST(1975 + p_size AS DOUBLE) END AS year_of_release,
               CASE WHEN p_size > 30 THEN p_type ELSE LOWER(p_type) END AS genre,
               CAST(FLOOR(p_retailprice / 20) AS DOUBLE) AS na_sales,
               CASE WHEN p_type = 'PROMO' THEN 'unknown'
                    ELSE CAST(CAST(FLOOR(p_retailprice / 25) AS INTEGER) AS STRING) END AS eu_sales,
               CASE WHEN p_type <> 'LARGE' THEN CAST(p_size AS STRING) END AS jp_sales,
               CAST(p_size AS DOUBLE) AS other_sales,
               CASE WHEN p_type <> 'LARGE' THEN CAST(p_size * 2 AS DOUBLE) END AS critic_score,
               CASE WHEN p_type = 'SMALL' THEN 'tbd' ELSE CAST(p_size % 11 AS STRING) END
                   AS user_score,
               CASE WHEN p_brand = 'Brand#1' THEN 'K-A' WHEN p_brand = 'Brand#2' THEN 'E'
                    WHEN p_brand <> 'Brand#3' THEN 'T' END AS rating
        FROM {part}""",
    "venue_info": """
        SELECT c.c_custkey AS id,
               CASE WHEN c.c_acctbal > 5000 THEN n.n_name ELSE CONCAT(' ', LOWER(n.n_name)) END
                   AS name,
               c.c_mktsegment AS category,
               CONCAT(CASE WHEN c.c_acctbal > 3000 THEN 'Дом ' ELSE 'дом ' END,
                      CAST(CAST(FLOOR(c.c_acctbal / 1000) AS INTEGER) AS STRING)) AS address,
               CASE n.n_regionkey WHEN 0 THEN 'Центральный административный округ'
                    WHEN 1 THEN 'Западный административный округ'
                    WHEN 2 THEN 'Южный административный округ'
                    WHEN 3 THEN 'Северный административный округ' END AS district,
               CASE WHEN c.c_acctbal > 8000 THEN 'Ежедневно, круглосуточно '
                    WHEN c.c_acctbal > 6000 THEN 'ежедневно, 10:00–22:00'
                    WHEN c.c_acctbal > 4000 THEN 'пн-пт круглосуточно; ежедневно доставка'
                    WHEN c.c_acctbal > 0 THEN 'пн-пт круглосуточно' END AS hours,
               1 + (c.c_custkey % 41) / 10e0 AS rating,
               CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS chain,
               CASE WHEN c.c_acctbal BETWEEN 0 AND 7000 THEN FLOOR(c.c_acctbal / 20) END AS seats
        FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "venue_prices": """
        SELECT c_custkey AS id,
               CASE WHEN c_acctbal > 7000 THEN 'высокие' WHEN c_acctbal > 4000 THEN 'средние' END
                   AS price,
               CASE WHEN c_acctbal > 6000 THEN 'Средний счёт:1000–1500 ₽'
                    WHEN c_acctbal > 3500 THEN 'Цена чашки капучино:150–200 ₽' END AS avg_bill,
               CASE WHEN c_acctbal > 6000 THEN FLOOR(c_acctbal / 5) END AS middle_avg_bill,
               CASE WHEN c_acctbal > 3500 AND c_acctbal <= 6000 THEN FLOOR(c_acctbal / 30) END
                   AS middle_coffee_cup
        FROM {customer} WHERE c_acctbal > 2000""",
    "venues": """
        SELECT i.*, p.price AS price_cat, p.avg_bill AS bill_range,
               p.middle_avg_bill AS middle_of_bill_range,
               p.middle_coffee_cup AS middle_of_coffee_cup_price
        FROM {venue_info} i LEFT JOIN {venue_prices} p ON i.id = p.id""",
    "event_numbers": """
        SELECT event_id, user_id, event_type, value,
               CAST(SUBSTR(props, 7, LENGTH(props) - 7) AS INTEGER) AS k
        FROM {events}""",
    "rounds": """
        SELECT event_id AS id, CONCAT('c', CAST(user_id AS STRING), '-', CAST(k AS STRING)) AS name,
               CASE event_type WHEN 'click' THEN 'click' WHEN 'signup' THEN 'signup'
                    WHEN 'view' THEN CONCAT('view-', CAST(user_id % 40 AS STRING))
                    WHEN 'purchase' THEN CONCAT('purchase-', CAST(k AS STRING)) END AS market,
               value AS funding_total_usd, 1 + k % 4 AS funding_rounds,
               CASE WHEN k < 97 THEN DATE '2000-01-01' + k * 55 END AS first_funding_at,
               CASE WHEN k % 3 = 0
                    THEN DATE '2000-01-01' + (k * 55 + CAST(user_id % 300 AS INTEGER)) END
                   AS mid_funding_at,
               CASE WHEN event_type <> 'error'
                    THEN DATE '2000-01-01' + (k * 55 + CAST(user_id % 701 AS INTEGER)) END
                   AS last_funding_at,
               CASE WHEN event_type = 'click' THEN value END AS seed,
               CASE WHEN event_type = 'view' THEN value END AS venture,
               CASE WHEN event_type = 'purchase' THEN value END AS angel,
               CASE WHEN event_type = 'signup' AND k > 10 THEN value END AS grant_money,
               CASE WHEN event_type = 'error' AND k > 30 THEN value END AS private_equity
        FROM {event_numbers}""",
    # The same as text, as it is before it is cleaned: padded, in capitals, with separators, bad dates and copies.
    "raw_rounds": """
        SELECT id, CASE WHEN id % 50 <> 7 THEN CONCAT(' ', UPPER(name), CASE WHEN id % 2 = 0 THEN ' ' ELSE '' END) END AS name,
               CASE WHEN market IS NOT NULL THEN CONCAT(UPPER(market), '  ') END AS market,
               CASE WHEN id % 9 = 4 THEN ' -   ' WHEN id % 13 = 5 THEN NULL
                    ELSE CONCAT('  ', CAST(CAST(FLOOR(funding_total_usd) AS INTEGER) AS STRING), ',',
                                LPAD(CAST(CAST(id % 1000 AS INTEGER) AS STRING), 3, '0'), ' ') END AS funding_total_usd,
               funding_rounds,
               CASE WHEN id % 17 = 3 THEN 'unknown' WHEN id % 17 = 4 THEN '2013-02-30' WHEN id % 500 = 11 THEN '1636-09-08'
                    ELSE CONCAT(' ', CAST(first_funding_at AS STRING)) END AS first_funding_at,
               CAST(mid_funding_at AS STRING) AS mid_funding_at,
               CONCAT(CAST(last_funding_at AS STRING), ' ') AS last_funding_at
        FROM (SELECT * FROM {rounds} UNION ALL SELECT * FROM {rounds} WHERE id % 11 = 0)""",
    "return_amounts": """
        SELECT CAST(2000 + k % 18 AS INTEGER) AS year,
               CASE event_type WHEN 'click' THEN 'seed' WHEN 'view' THEN 'venture'
                    WHEN 'purchase' THEN 'angel' WHEN 'signup' THEN 'grant_money'
                    ELSE 'private_equity' END AS type,
               CAST(SUM(CAST(value * value AS DECIMAL(18,4))) AS DOUBLE) / 1000000 AS amount
        FROM {event_numbers} GROUP BY 1, 2""",
}
ROUND_TYPES = ("seed", "venture", "angel", "grant_money", "private_equity")


class Tables:
    """The supplied tables and the views over them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return load(self.spark, self.sf_dir, name)
        sql = VIEWS[name]
        used = set(re.findall(r"\{(\w+)\}", sql))
        return self.spark.sql(sql, **{n: self(n) for n in used})


def expand_sql(sql: str) -> str:
    """Puts the views a statement names in front of it as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"(?<![\w.'])\{{?{name}\}}?(?![\w'])", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(
        f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n]).strip()})" for n in needed
    )
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
