"""Sources, projections, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contains_all, day_diff, excludes_all, mean, starts_with, total
from ..operators import bucketed, join_group_values, snake_case_columns, with_group_size
from ..operators.reshape import aligned_ratio
from ..session import scratch_path
from ..sources import SCHEMAS, preview, read_csv, schema_profile
from .registry import query, same_rows


def _csv_round_trip(t, sep):
    path = scratch_path(t.spark, "customer-csv")
    t("customer").write.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return read_csv(t.spark, path, SCHEMAS["customer"], sep)


@query("src_csv", "SELECT * FROM customer")
def _(t):
    return _csv_round_trip(t, ",")


@query("src_csv_semicolon", "SELECT * FROM customer")
def _(t):
    return _csv_round_trip(t, ";")


@query("src_table", "SELECT * FROM supplier")
def _(t):
    return t("supplier")


@query(
    "preview_rows",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10",
)
def _(t):
    return preview(t("orders").select("o_orderkey", "o_totalprice"), 10, ["o_orderkey"])


_PROFILE = (("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
            ("event_type", "string"), ("value", "double"), ("props", "string"))


@query("schema_profile", " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{d}' AS data_type, "
    f"COUNT({c}) AS non_null, COUNT(*) AS n_rows FROM events"
    for i, (c, d) in enumerate(_PROFILE, 1)
))
def _(t):
    return schema_profile(t("events"))


@query("project_alias", "SELECT p_partkey AS id, p_name AS name, p_brand FROM part")
def _(t):
    return t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_brand")


@query("derived_amount", """
    SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS commission_revenue,
           CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS unit_price
    FROM lineitem""")
def _(t):
    return t("lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_extendedprice") * F.col("l_discount")).alias("commission_revenue"),
        F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"),
    )


@query("label_branch", """
    SELECT 'Все заказы' AS scope, COUNT(o_orderkey) AS n FROM orders""")
def _(t):
    return t("orders").agg(F.lit("Все заказы").alias("scope"), F.count("o_orderkey").alias("n"))


@query("rename_columns", """
    SELECT s_suppkey AS rest_id, s_name AS chain, s_nationkey AS city_id, s_acctbal FROM supplier""")
def _(t):
    return t("supplier").withColumnsRenamed(
        {"s_suppkey": "rest_id", "s_name": "chain", "s_nationkey": "city_id"}
    )


@query("snake_case_columns", """
    SELECT p_name AS name, p_size AS year_of_release, p_retailprice AS na_sales FROM part""")
def _(t):
    return snake_case_columns(t("part").select(
        F.col("p_name").alias("Name"), F.col("p_size").alias("Year of Release"),
        F.col("p_retailprice").alias("NA sales"),
    ))


@query("filter_null_tolerant", """
    SELECT id, total_area, balcony FROM flats
    WHERE total_area < 150 AND (balcony < 3 OR balcony IS NULL)""")
def _(t):
    return t("flats").filter(
        (F.col("total_area") < 150) & ((F.col("balcony") < 3) | F.col("balcony").isNull())
    ).select("id", "total_area", "balcony")


@query("filter_between", """
    SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders
    WHERE o_orderdate BETWEEN '1997-05-01' AND '1997-06-30'""")
def _(t):
    return t("orders").filter(
        F.col("o_orderdate").between(F.lit("1997-05-01").cast("timestamp_ntz"),
                                     F.lit("1997-06-30").cast("timestamp_ntz"))
    ).select("o_orderkey", "o_orderdate")


@query("filter_not_null", """
    SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    WHERE l.quality IS NOT NULL""")
def _(t):
    return t("documents").join(t("labels"), "doc_id", "left").filter(
        F.col("quality").isNotNull()
    ).select("doc_id", "quality")


# Patterns that stand for the excluded professions in the supplied texts.
TEXT_PATTERNS = (
    "Thnt", "Eaux", "ation", "ouéé", "Ingth", "usiness", "BI", "ngineer", "inance", "1C",
    "êeux", "erland", "Zx", "ndre,", "rethwh", "ierou.", "çch", "denne", "schund", "lyth",
)


@query("exclude_patterns", "SELECT doc_id, lang FROM documents WHERE "
       + " AND ".join(f"text NOT LIKE '%{p}%'" for p in TEXT_PATTERNS))
def _(t):
    return t("documents").filter(excludes_all(F.col("text"), TEXT_PATTERNS)).select("doc_id", "lang")


@query("prefix_count", """
    SELECT COUNT(*) FILTER (WHERE bill_range NOT LIKE 'Средний счёт%' OR bill_range IS NULL) AS n
    FROM venues""")
def _(t):
    return t("venues").agg(F.count_if(~starts_with(F.col("bill_range"), "Средний счёт")).alias("n"))


@query("contains_all_words", """
    SELECT id, hours FROM venues
    WHERE lower(hours) LIKE '%ежедневно%' AND lower(hours) LIKE '%круглосуточно%'""")
def _(t):
    return t("venues").filter(
        contains_all(F.col("hours"), ("Ежедневно", "круглосуточно"))
    ).select("id", "hours")


@query("scalar_subquery_filter", """
    SELECT c_custkey, c_acctbal FROM customer
    WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)""")
def _(t):
    customer = t("customer").select("c_custkey", "c_acctbal")
    limit = customer.agg(mean(F.col("c_acctbal"))).scalar()
    return customer.filter(F.col("c_acctbal") > limit)


@query("distinct_values", "SELECT DISTINCT p_brand, p_type FROM part")
def _(t):
    return t("part").select("p_brand", "p_type").distinct()


@query("filter_date_part", """
    SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS year FROM orders
    WHERE EXTRACT(YEAR FROM o_orderdate) BETWEEN 1996 AND 1998""")
def _(t):
    # The years as a range of instants, so that file statistics can skip data.
    span = (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (
        F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return t("orders").filter(span).select("o_orderkey", F.year("o_orderdate").alias("year"))


@query("filter_same_date", """
    SELECT id, CAST(donation_date AS VARCHAR) AS donation_date FROM donations
    WHERE donation_date = plan_date""")
def _(t):
    return t("donations").filter(F.col("donation_date") == F.col("plan_date")).select(
        "id", "donation_date")


@query("flag_exact_text", """
    SELECT o_orderkey, COALESCE(o_orderpriority = '1-URGENT', FALSE) AS is_urgent FROM orders""")
def _(t):
    flag = F.coalesce(F.col("o_orderpriority") == "1-URGENT", F.lit(False))
    return t("orders").select("o_orderkey", flag.alias("is_urgent"))


@query("join_inner_using", """
    SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    customer = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return t("orders").join(customer, "o_custkey").select("o_orderkey", "o_custkey", "c_mktsegment")


@query("join_inner_on", """
    SELECT c_custkey, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    customer, nation = t("customer"), t("nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        "c_custkey", "n_nationkey", "n_name")


@query("join_composite_key", """
    SELECT s.order_id, s.rest_id, s.city_id, p.chain FROM sales s
    JOIN partners p ON s.rest_id = p.rest_id AND s.city_id = p.city_id""")
def _(t):
    return t("sales").join(t("partners"), ["rest_id", "city_id"]).select(
        "order_id", "rest_id", "city_id", "chain")


@query("join_star", """
    SELECT r_name, c_mktsegment, COUNT(o_orderkey) AS n, AVG(o_totalprice) AS avg_price
    FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name, c_mktsegment""", digits={"avg_price": 6})
def _(t):
    # Orders are added up per customer first, so a customer with very many orders is one row.
    per_customer = t("orders").groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("n"),
        total(F.col("o_totalprice")).alias("total"),
        F.count("o_totalprice").alias("priced"),
    )
    price = F.sum("total") / F.sum("priced")
    return (
        per_customer.join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "c_mktsegment")
        .agg(F.sum("n").alias("n"), price.alias("avg_price"))
    )


@query("join_star_lines", """
    SELECT o_orderpriority, c_mktsegment, COUNT(*) AS n, SUM(l_quantity) AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    GROUP BY o_orderpriority, c_mktsegment""", digits={"quantity": 4})
def _(t):
    """Orders and lines meet on copies laid out by order, with no exchange on either side."""
    lines = bucketed(t("lineitem").select("l_orderkey", "l_quantity"), ["l_orderkey"], 8)
    orders = bucketed(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_orderkey"], 8)
    per_order = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), total(F.col("l_quantity")).alias("quantity"))
    return (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("o_orderpriority", "c_mktsegment").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"))
    )


@query("join_left", """
    SELECT d.doc_id, d.lang, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(t):
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")


@query("join_left_null_filter", """
    SELECT u.id, u.confirmed_donations FROM donors u LEFT JOIN bonus b ON u.id = b.user_id
    WHERE b.user_bonus_count IS NULL""")
def _(t):
    bonus = t("bonus").select(F.col("user_id").alias("id"), "user_bonus_count")
    return t("donors").join(bonus, "id", "left").filter(
        F.col("user_bonus_count").isNull()
    ).select("id", "confirmed_donations")


@query("join_semi", """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)""")
def _(t):
    big = t("orders").filter(F.col("o_totalprice") > 490000).select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("join_anti", """
    SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("join_equi_range", """
    SELECT f.user_id, CAST(f.first_date AS VARCHAR) AS first_date,
           CAST(d.log_date AS VARCHAR) AS log_date,
           CAST(d.log_date - f.first_date AS INTEGER) AS day_since_install
    FROM (SELECT user_id, MIN(log_date) AS first_date FROM visit_days WHERE order_id IS NOT NULL
          GROUP BY user_id) f
    JOIN visit_days d ON f.user_id = d.user_id AND d.log_date >= f.first_date""")
def _(t):
    days = t("visit_days")
    first = days.filter(F.col("order_id").isNotNull()).groupBy("user_id").agg(
        F.min("log_date").alias("first_date"))
    return first.join(days.select("user_id", "log_date"), "user_id").filter(
        F.col("log_date") >= F.col("first_date")
    ).withColumn("day_since_install", day_diff(F.col("log_date"), F.col("first_date")))


@same_rows("join_equi_range_split", "join_equi_range")
def _(t):
    """The same with users of very many days met in a broadcast instead of in one task."""
    days = t("visit_days")
    first = days.groupBy("user_id").agg(
        F.min(F.when(F.col("order_id").isNotNull(), F.col("log_date"))).alias("first_date"),
        F.count(F.lit(1)).alias("n_days"))
    met = join_group_values(days.select("user_id", "log_date"), first.filter("first_date IS NOT NULL AND user_id IS NOT NULL"),
                            ["user_id"], "n_days", how="inner")
    later = met.filter(F.col("log_date") >= F.col("first_date"))
    return later.select("user_id", "first_date", "log_date", day_diff(F.col("log_date"), F.col("first_date")).alias("day_since_install"))


@query("join_lookup", """
    SELECT p_partkey, p_brand, n AS brand_size FROM part
    LEFT JOIN (SELECT p_brand AS b, COUNT(*) AS n FROM part GROUP BY p_brand) ON p_brand = b""")
def _(t):
    return with_group_size(t("part").select("p_partkey", "p_brand"), "p_brand", "brand_size")


@query("join_aligned_ratio", """
    WITH paid AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS type,
                         SUM(l_tax) AS v
                  FROM lineitem WHERE year(l_shipdate) > 1995 GROUP BY 1, 2),
    sold AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS type,
                    SUM(l_extendedprice) AS v
             FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
    SELECT COALESCE(p.year, s.year) AS year, COALESCE(p.type, s.type) AS type,
           (p.v * 1000000) / s.v AS ratio
    FROM paid p FULL JOIN sold s ON p.year = s.year AND p.type = s.type""", digits={"ratio": 6})
def _(t):
    lines = t("lineitem").select(
        F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("type"),
        "l_tax", "l_extendedprice")

    def amount(rows, column):
        return rows.groupBy("year", "type").agg(total(F.col(column)).alias("v"))

    return aligned_ratio(
        amount(lines.filter("year > 1995"), "l_tax"),
        amount(lines.filter("type <> 'N'"), "l_extendedprice"), ["year", "type"], "v", 1e6)
