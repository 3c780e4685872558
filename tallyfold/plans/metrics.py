"""Whole metrics, as the jobs compute them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import midpoint
from ..jobs import delivery, donors, estate, vacancies, venues, ventures
from ..operators import row_loss_report, sum_share, value_counts
from .analysis import SIZED, TRIMMED
from .registry import query, ratio2, same_rows
from .standins import ROUND_TYPES



def clean_text(column):
    return f"trim(lower({column}))"


_CITY = "ASIA"
_VISITS = ("2024-01-03", "2024-01-28")
_SALES = ("1996-05-01", "1999-06-30")
_IN_CITY = f"JOIN service_cities s ON v.city_id = s.city_id WHERE city_name = '{_CITY}'"
_VISIT_SPAN = f"log_date BETWEEN DATE '{_VISITS[0]}' AND DATE '{_VISITS[1]}'"


@query("dau", f"""
    SELECT CAST(log_date AS VARCHAR) AS log_date, COUNT(DISTINCT user_id) AS dau
    FROM visits v {_IN_CITY} AND {_VISIT_SPAN} AND order_id IS NOT NULL GROUP BY log_date""")
def _(t):
    return delivery.dau(t("visits"), t("service_cities"), *_VISITS, city=_CITY)


@query("conversion_rate", f"""
    SELECT CAST(log_date AS VARCHAR) AS log_date,
           {ratio2('COUNT(DISTINCT user_id) FILTER (WHERE order_id IS NOT NULL)',
                   'COUNT(DISTINCT user_id)')} AS cr
    FROM visits v {_IN_CITY} AND {_VISIT_SPAN} GROUP BY log_date""")
def _(t):
    return delivery.conversion_rate(t("visits"), t("service_cities"), *_VISITS, city=_CITY)


_INCOME = "SUM(CAST(revenue AS DECIMAL(18,2)) * CAST(commission AS DECIMAL(8,4)))"
_PAID = f"""paid AS (SELECT v.* FROM sales v {_IN_CITY} AND revenue IS NOT NULL
    AND log_date BETWEEN DATE '{_SALES[0]}' AND DATE '{_SALES[1]}')"""
_CHECK_N = f"CAST({_INCOME} * 1000000 AS HUGEINT)"


@query("average_check", f"""
    WITH {_PAID}
    SELECT CAST(CAST(date_trunc('month', log_date) AS DATE) AS VARCHAR) AS month,
           CAST((2 * {_CHECK_N} + 10000 * COUNT(DISTINCT order_id))
                // (20000 * COUNT(DISTINCT order_id)) AS DOUBLE) / 100 AS average_check
    FROM paid GROUP BY 1""")
def _(t):
    return delivery.average_check(t("sales"), t("service_cities"), *_SALES, city=_CITY)


_LTV = f"CAST(ROUND({_INCOME}, 2) AS DOUBLE) AS ltv"


@query("ltv_top_partners", f"""
    WITH {_PAID}
    SELECT p.rest_id, chain, type, {_LTV} FROM paid
    JOIN partners p ON paid.rest_id = p.rest_id AND paid.city_id = p.city_id
    GROUP BY p.rest_id, chain, type ORDER BY ltv DESC, p.rest_id LIMIT 3""")
def _(t):
    return delivery.ltv_top_partners(
        t("sales"), t("service_cities"), t("partners"), *_SALES, city=_CITY)


@query("ltv_top_items", f"""
    WITH {_PAID},
    best AS (SELECT p.rest_id, chain, type, {_LTV} FROM paid
             JOIN partners p ON paid.rest_id = p.rest_id AND paid.city_id = p.city_id
             GROUP BY p.rest_id, chain, type ORDER BY ltv DESC, p.rest_id LIMIT 2),
    items AS (SELECT object_id, {_LTV} FROM paid WHERE rest_id IN (SELECT rest_id FROM best)
              GROUP BY object_id ORDER BY ltv DESC, object_id LIMIT 5)
    SELECT chain, name, CAST(spicy AS INTEGER) AS spicy, CAST(fish AS INTEGER) AS fish,
           CAST(meat AS INTEGER) AS meat, {_LTV}
    FROM paid JOIN dishes d ON paid.object_id = d.object_id AND paid.rest_id = d.rest_id
    JOIN partners p ON paid.rest_id = p.rest_id AND paid.city_id = p.city_id
    WHERE paid.object_id IN (SELECT object_id FROM items)
    GROUP BY chain, name, spicy, fish, meat""")
def _(t):
    return delivery.ltv_top_items(
        t("sales"), t("service_cities"), t("partners"), t("dishes"), *_SALES, city=_CITY)


_COHORT = ("2024-01-01", "2024-01-20", "2024-01-01", "2024-01-30")
_RETAINED = f"""
    log AS (SELECT v.* FROM visits v {_IN_CITY} AND user_id IS NOT NULL),
    daily AS (SELECT DISTINCT n.user_id, n.first_date,
                     CAST(a.log_date - n.first_date AS INTEGER) AS day_since_install
              FROM log n JOIN log a ON n.user_id = a.user_id AND a.log_date >= n.first_date
              WHERE n.first_date BETWEEN DATE '{_COHORT[0]}' AND DATE '{_COHORT[1]}'
                AND a.log_date BETWEEN DATE '{_COHORT[2]}' AND DATE '{_COHORT[3]}'
                AND a.log_date - n.first_date < 8)"""


@query("retention_daily", f"""
    WITH {_RETAINED},
    curve AS (SELECT day_since_install, COUNT(DISTINCT user_id) AS retained_users FROM daily
              GROUP BY day_since_install),
    peak AS (SELECT *, MAX(retained_users) OVER (ORDER BY day_since_install) AS p FROM curve)
    SELECT day_since_install, retained_users, {ratio2('retained_users', 'p')} AS retention_rate
    FROM peak""")
def _(t):
    daily = delivery.daily_retention(t("visits"), t("service_cities"), *_COHORT, city=_CITY)
    return delivery.retention(daily)


@query("retention_cohort", f"""
    WITH {_RETAINED},
    curve AS (SELECT CAST(date_trunc('month', first_date) AS DATE) AS month, day_since_install,
                     COUNT(DISTINCT user_id) AS retained_users FROM daily GROUP BY 1, 2),
    peak AS (SELECT *, MAX(retained_users) OVER (PARTITION BY month ORDER BY day_since_install) AS p
             FROM curve)
    SELECT CAST(month AS VARCHAR) AS month, day_since_install, retained_users,
           {ratio2('retained_users', 'p')} AS retention_rate FROM peak""")
def _(t):
    daily = delivery.daily_retention(t("visits"), t("service_cities"), *_COHORT, city=_CITY)
    return delivery.retention(daily, by_month=True)


def _user_bitmaps(t, column, *span):
    log = t("visits").join(t("service_cities").filter(F.col("city_name") == _CITY), "city_id")
    return delivery.user_bitmaps(log.filter(F.col(column).between(*[F.lit(d).cast("date") for d in span])), column)


@same_rows("dau_bitmaps", "dau")
def _(t):
    bought = t("visits").filter("order_id IS NOT NULL").join(
        t("service_cities").filter(F.col("city_name") == _CITY), "city_id")
    days = bought.filter(F.col("log_date").between(*[F.lit(d).cast("date") for d in _VISITS]))
    return delivery.dau_of_bitmaps(delivery.user_bitmaps(days, "log_date"))


@same_rows("retention_daily_bitmaps", "retention_daily")
def _(t):
    return delivery.retention_of_bitmaps(
        _user_bitmaps(t, "first_date", *_COHORT[:2]), _user_bitmaps(t, "log_date", *_COHORT[2:]))


@same_rows("retention_cohort_bitmaps", "retention_cohort")
def _(t):
    return delivery.retention_of_bitmaps(
        _user_bitmaps(t, "first_date", *_COHORT[:2]), _user_bitmaps(t, "log_date", *_COHORT[2:]), by_month=True)


@same_rows("retention_daily_binned", "retention_daily")
def _(t):
    daily = delivery.daily_retention_binned(t("visits"), t("service_cities"), *_COHORT, city=_CITY)
    return delivery.retention(daily)


@query("channel_summary", " UNION ALL ".join(
    f"SELECT '{name}' AS social_media, COUNT(id) AS count_of_users, "
    f"{ratio2('SUM(confirmed_donations)', 'COUNT(confirmed_donations)')} AS avg_donations "
    f"FROM donors WHERE {flag}" for flag, name in donors.CHANNELS.items()
))
def _(t):
    return donors.channel_summary(t("donors"))


_PER_USER = "per_user AS (SELECT user_id, COUNT(donation_date) AS n FROM donations GROUP BY user_id)"


@query("one_time_vs_repeat", f"""
    WITH {_PER_USER}
    SELECT COUNT(user_id) FILTER (WHERE n = 1) AS one_time_users,
           {ratio2('SUM(n) FILTER (WHERE n > 1)', 'COUNT(*) FILTER (WHERE n > 1)')}
               AS avg_of_repeat_users FROM per_user""")
def _(t):
    return donors.one_time_vs_repeat(t("donations"))


@query("treated_vs_rest", f"""
    SELECT 'Использовали бонусы' AS bonus_status, COUNT(user_id) AS n_users,
           {ratio2('SUM(donation_count)', 'COUNT(donation_count)')} AS avg_donations FROM bonus
    UNION ALL
    SELECT 'Не использовали бонусы', COUNT(u.id),
           {ratio2('SUM(confirmed_donations)', 'COUNT(confirmed_donations)')}
    FROM donors u LEFT JOIN bonus b ON u.id = b.user_id WHERE user_bonus_count IS NULL""")
def _(t):
    return donors.treated_vs_rest(t("donors"), t("bonus"))


@query("donors_by_region", """
    SELECT COALESCE(region, 'Регион не указан') AS region, n AS count_of_donors FROM
    (SELECT region, COUNT(id) AS n FROM donors GROUP BY region)
    ORDER BY count_of_donors DESC, 1 LIMIT 10""")
def _(t):
    return donors.donors_by_region(t("donors"))


@query("monthly_volume", """
    SELECT CAST(CAST(date_trunc('month', donation_date) AS DATE) AS VARCHAR) AS month,
           COUNT(id) AS count_of_donations FROM donations
    WHERE donation_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 1""")
def _(t):
    return donors.monthly_volume(t("donations"), "1997-01-01", "1998-12-31")


@query("daily_volume", """
    SELECT CAST(donation_date AS VARCHAR) AS donation_date, COUNT(id) AS count_of_donations
    FROM donations WHERE CAST(date_trunc('month', donation_date) AS DATE) = DATE '1998-11-01'
    GROUP BY donation_date""")
def _(t):
    return donors.daily_volume(t("donations"), "1998-11-01")


@query("most_active_users", """
    SELECT user_id, COUNT(donation_date) AS count_of_donations FROM donations
    WHERE confirmation AND donation_added_date IS NOT NULL GROUP BY user_id
    ORDER BY count_of_donations DESC, user_id LIMIT 10""")
def _(t):
    return donors.most_active_users(t("donations"))


@query("plan_accuracy", """
    SELECT COUNT(id) FILTER (WHERE donation_date = plan_date) AS same_date,
           COUNT(id) FILTER (WHERE donation_date = plan_date) / CAST(COUNT(id) AS DOUBLE)
               AS share_same_date FROM donations""")
def _(t):
    return donors.plan_accuracy(t("donations"))


_AS_OF = "2025-06-15"


@query("activity_by_age_band", f"""
    WITH a AS (SELECT *, CAST(year(DATE '{_AS_OF}') - year(birth_date)
                   - CASE WHEN month(birth_date) * 100 + day(birth_date) > 615 THEN 1 ELSE 0 END
                   AS INTEGER) AS age FROM donors WHERE confirmed_donations > 0),
    b AS (SELECT gender, confirmed_donations, id,
                 CASE WHEN age < 18 THEN 'Error' WHEN age <= 25 THEN '18–25 лет'
                      WHEN age <= 35 THEN '26–35 лет' WHEN age <= 45 THEN '36–45 лет'
                      WHEN age <= 55 THEN '46–55 лет' WHEN age > 55 THEN 'Старше 55'
                      ELSE 'No info' END AS age_group FROM a)
    SELECT COALESCE(gender, 'Пол не указан') AS gender, age_group,
           {ratio2('SUM(confirmed_donations)', 'COUNT(id)')} AS avg_donations
    FROM b GROUP BY b.gender, age_group""")
def _(t):
    return donors.activity_by_age_band(t("donors"), _AS_OF)


@query("activity_frequency", f"""
    WITH p AS (SELECT user_id, COUNT(id) AS n FROM donations
               WHERE donation_date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30' GROUP BY user_id),
    g AS (SELECT gender, COUNT(*) AS n_users, CAST(SUM(n) AS BIGINT) AS n_donations
          FROM p JOIN donors ON user_id = id GROUP BY gender)
    SELECT COALESCE(gender, 'Пол не указан') AS gender, n_users, n_donations,
           {ratio2('n_donations', '18')} AS per_month FROM g""")
def _(t):
    return donors.activity_frequency(t("donations"), t("donors"), "1997-01-01", "1998-06-30")


_CAPITAL, _TOWN = "NATION_0", "BUILDING"
_MEANS = "AVG(last_price / total_area) AS avg_cost_per_meter, AVG(total_area) AS avg_total_area"
_ROOMS = "AVG(rooms) AS avg_rooms, AVG(balcony) AS avg_balcony"
_MEAN_DIGITS = {"avg_cost_per_meter": 4, "avg_total_area": 4}
_ROOM_DIGITS = _MEAN_DIGITS | {"avg_rooms": 6, "avg_balcony": 6}


@query("duration_profile", f"""
    WITH {TRIMMED},
    rows_ AS (SELECT f.*, a.days_exposition, a.last_price,
                     CASE WHEN city = '{_CAPITAL}' THEN '{_CAPITAL}'
                          WHEN type = '{_TOWN}' THEN 'города Лен области' END AS region,
                     CASE WHEN days_exposition < 30 THEN '1_Краткосрочные объявления'
                          WHEN days_exposition > 95 THEN '3_Долгосрочные объявления'
                          ELSE '2_Среднесрочные объявления' END AS exposition_category
              FROM trimmed f JOIN ads a ON f.id = a.id JOIN flat_cities c ON f.city_id = c.city_id
              JOIN flat_types t ON f.type_id = t.type_id WHERE days_exposition IS NOT NULL),
    g AS (SELECT region, exposition_category, COUNT(id) AS flats_count, {_MEANS}, {_ROOMS}
          FROM rows_ WHERE region IS NOT NULL GROUP BY region, exposition_category),
    totals AS (SELECT region AS r, SUM(flats_count) AS total FROM g GROUP BY region)
    SELECT g.*, {ratio2('flats_count', 'total')} AS share_into_region
    FROM g JOIN totals ON region = r""", digits=_ROOM_DIGITS)
def _(t):
    return estate.duration_profile(
        t("flats"), t("ads"), t("flat_cities"), t("flat_types"), capital=_CAPITAL, town=_TOWN)


def _season(label, day, where):
    return f"""SELECT '{label}' AS month_category, CAST(month({day}) AS INTEGER) AS month,
        COUNT(id) AS adv_count, {_MEANS},
        RANK() OVER (ORDER BY COUNT(id) DESC) AS rank,
        SUM(COUNT(id)) OVER () AS total
        FROM listed WHERE {where} GROUP BY 2"""


_LISTED = """listed AS (SELECT a.*, f.total_area, t.type,
    a.first_day_exposition + CAST(a.days_exposition AS INTEGER) AS last_day
    FROM ads a JOIN flats f ON a.id = f.id JOIN flat_types t ON f.type_id = t.type_id)"""
_YEARS = f"type = '{_TOWN}' AND year(first_day_exposition) BETWEEN 1996 AND 1999"


@query("seasonality", f"""
    WITH {_LISTED},
    m AS ({_season(estate.OPENED, 'first_day_exposition', _YEARS)}
          UNION ALL {_season(estate.CLOSED, 'last_day', _YEARS + ' AND last_day IS NOT NULL')})
    SELECT month_category, month, adv_count, avg_cost_per_meter, avg_total_area, rank,
           {ratio2('adv_count', 'total')} AS share_into_month FROM m""", digits=_MEAN_DIGITS)
def _(t):
    return estate.seasonality(
        t("flats"), t("ads"), t("flat_types"), town=_TOWN, first_year=1996, last_year=1999)


@query("seasonality_overview", f"""
    WITH {_LISTED},
    m AS ({_season(estate.OPENED, 'first_day_exposition', 'TRUE')}
          UNION ALL {_season(estate.CLOSED, 'last_day', 'last_day IS NOT NULL')})
    SELECT month_category, month, adv_count, avg_cost_per_meter, avg_total_area FROM m""",
       digits=_MEAN_DIGITS)
def _(t):
    return estate.seasonality_overview(t("flats"), t("ads"))


@query("top_places", f"""
    WITH {TRIMMED}
    SELECT city, COUNT(a.id) AS adv_count,
           {ratio2('COUNT(a.id) FILTER (WHERE days_exposition IS NOT NULL)', 'COUNT(a.id)')}
               AS share_of_removed,
           AVG(days_exposition) AS avg_days_exposition, {_MEANS}, {_ROOMS}
    FROM trimmed f JOIN ads a ON f.id = a.id JOIN flat_cities c ON f.city_id = c.city_id
    WHERE city <> '{_CAPITAL}' GROUP BY city ORDER BY adv_count DESC, city LIMIT 15""",
       digits=_ROOM_DIGITS | {"avg_days_exposition": 4})
def _(t):
    return estate.top_places(t("flats"), t("ads"), t("flat_cities"), capital=_CAPITAL)


_SKILLS = " UNION ALL ".join(
    f"SELECT '{c}' AS slot, {c} AS skill, COUNT(id) AS number_of_vacancies FROM vacancies "
    f"{{where}} GROUP BY {c}" for c in vacancies.SKILL_COLUMNS)


@query("skill_demand", _SKILLS.format(where=""))
def _(t):
    return vacancies.skill_demand(t("vacancies"))


@query("skill_demand_by_grade", _SKILLS.format(where="WHERE experience = 'MEDIUM'"))
def _(t):
    return vacancies.skill_demand(t("vacancies"), "MEDIUM")


@query("skill_totals", f"""
    SELECT split_part(slot, '_', 1) AS kind, skill,
           CAST(SUM(number_of_vacancies) AS BIGINT) AS number_of_vacancies
    FROM ({_SKILLS.format(where="")}) WHERE trim(skill) <> '' GROUP BY 1, 2""")
def _(t):
    return vacancies.skill_totals(vacancies.skill_demand(t("vacancies")))


_LEFT_OUT = ("blue", "gear", "old bolt", "Hot")


@query("grades", "SELECT experience, COUNT(id) AS number_of_vacancies FROM vacancies WHERE "
       + " AND ".join(f"name NOT LIKE '%{p}%'" for p in _LEFT_OUT) + " GROUP BY experience")
def _(t):
    return vacancies.grades(t("vacancies"), _LEFT_OUT)


@query("top_chains", """
    SELECT name, category, cnt, avg FROM (
        SELECT name, category, COUNT(name) AS cnt, AVG(rating) AS avg,
               RANK() OVER (ORDER BY COUNT(name) DESC) AS r
        FROM venues WHERE chain = 1 GROUP BY name, category) WHERE r <= 15""", digits={"avg": 6})
def _(t):
    return venues.top_chains(t("venues"))


@query("clean_venues", """
    SELECT id, trim(lower(name)) AS name, category, trim(lower(address)) AS address, district,
           trim(lower(hours)) AS hours, rating, CAST(chain AS TINYINT) AS chain,
           CAST(COALESCE(seats, -1) AS SMALLINT) AS seats,
           COALESCE(trim(lower(hours)) = 'ежедневно, круглосуточно', FALSE) AS is_24_7
    FROM venues
    QUALIFY row_number() OVER (PARTITION BY trim(lower(name)), trim(lower(address)) ORDER BY id) = 1""")
def _(t):
    joined = venues.join_prices(t("venue_info"), t("venue_prices"))
    return venues.clean_venues(joined).select(
        "id", "name", "category", "address", "district", "hours", "rating", "chain", "seats",
        "is_24_7")


_DATED = f"""
    WITH {SIZED},
    quartiles AS (SELECT market AS m2, quantile_cont(funding_total_usd, 0.25) AS q1,
                         quantile_cont(funding_total_usd, 0.75) AS q3
                  FROM collapsed WHERE market IS NOT NULL GROUP BY market),
    odd AS (SELECT name FROM collapsed JOIN quartiles ON market = m2
            WHERE funding_total_usd > q3 + (q3 - q1) * 1.5
               OR funding_total_usd < q1 - (q3 - q1) * 1.5),
    kept AS (SELECT *, CAST(year(CASE WHEN mid_funding_at IS NOT NULL THEN mid_funding_at
                 ELSE first_funding_at + CAST((last_funding_at - first_funding_at) // 2 AS INTEGER) END)
                 AS INTEGER) AS year
             FROM collapsed WHERE name NOT IN (SELECT name FROM odd)),
    busy AS (SELECT * FROM kept WHERE year IN (SELECT year FROM kept GROUP BY year
                                               HAVING SUM(funding_rounds) >= 50))"""


def _busy(t, *columns):
    """The start-ups of the later metrics: no outliers, middle date filled, busy years only; with the columns asked for."""
    middle = midpoint(F.col("first_funding_at"), F.col("last_funding_at"))
    known = F.col("mid_funding_at").cast("timestamp_ntz")
    rounds = t("rounds").withColumn("mid_funding_at", F.coalesce(known, middle))
    needed = dict.fromkeys(("name", "market", "funding_total_usd", "funding_rounds", "mid_funding_at", *columns))
    return ventures.busy_years(ventures.without_outliers(rounds.select(*needed)))


@query("years_with_min_volume", _DATED + " SELECT id, market, year FROM busy")
def _(t):
    return _busy(t, "id").select("id", "market", "year")


@query("clean_rounds", f"""
    WITH parsed AS (SELECT id, {clean_text('name')} AS name, {clean_text('market')} AS market,
            TRY_CAST(replace(trim(funding_total_usd), ',', '') AS DOUBLE) AS funding_total_usd, funding_rounds,
            CAST(try_strptime(trim(first_funding_at), '%Y-%m-%d') AS DATE) AS first_funding_at,
            CAST(try_strptime(trim(mid_funding_at), '%Y-%m-%d') AS DATE) AS mid_funding_at,
            CAST(try_strptime(trim(last_funding_at), '%Y-%m-%d') AS DATE) AS last_funding_at
        FROM raw_rounds),
    kept AS (SELECT DISTINCT * FROM parsed WHERE funding_total_usd IS NOT NULL)
    SELECT id, COALESCE(name, 'Название неизвестно') AS name, market, funding_total_usd, funding_rounds,
           CAST(first_funding_at AS VARCHAR) AS first_funding_at,
           CAST(COALESCE(CAST(mid_funding_at AS TIMESTAMP), CAST(first_funding_at AS TIMESTAMP)
                + to_hours(CAST(last_funding_at - first_funding_at AS BIGINT) * 12)) AS VARCHAR) AS mid_funding_at,
           CAST(last_funding_at AS VARCHAR) AS last_funding_at FROM kept""")
def _(t):
    raw = t("raw_rounds").withColumnsRenamed({"market": " market ", "funding_total_usd": " funding_total_usd "})
    return ventures.clean_rounds(raw)


@query("clean_rounds_loss", f"""
    WITH c AS (SELECT DISTINCT id, {clean_text('name')} AS name, {clean_text('market')} AS market,
            TRY_CAST(replace(trim(funding_total_usd), ',', '') AS DOUBLE) AS v, funding_rounds,
            try_strptime(trim(first_funding_at), '%Y-%m-%d') AS f, try_strptime(trim(mid_funding_at), '%Y-%m-%d') AS m,
            try_strptime(trim(last_funding_at), '%Y-%m-%d') AS l FROM raw_rounds),
    n AS (SELECT (SELECT COUNT(*) FROM raw_rounds) AS n_before, (SELECT COUNT(*) FROM c WHERE v IS NOT NULL) AS n_after)
    SELECT n_before, n_after, n_before - n_after AS n_lost, {ratio2('100 * (n_before - n_after)', 'n_before')} AS pct_lost FROM n""")
def _(t):
    raw = t("raw_rounds").withColumnsRenamed({"market": " market ", "funding_total_usd": " funding_total_usd "})
    return row_loss_report(raw, ventures.clean_rounds(raw))


@query("funding_by_type", _DATED + ", s AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS type, COALESCE(SUM({c}), 0) AS total, "
    f"COUNT(*) FILTER (WHERE {c} > 0) AS frequency FROM busy" for c in ROUND_TYPES
) + """) SELECT type, total, frequency,
    total / (SELECT SUM(total) FROM s) AS share FROM s""", digits={"total": 2, "share": 9}, owned=True)
def _(t):
    return ventures.funding_by_type(_busy(t, *ROUND_TYPES), ROUND_TYPES)


@query("funding_spans", """
    SELECT funding_periods_categories, COUNT(*) AS n,
           COUNT(*) / CAST((SELECT COUNT(*) FROM rounds) AS DOUBLE) AS share FROM (
    SELECT CASE WHEN funding_rounds = 1 THEN 'Единичное финансирование'
                WHEN last_funding_at IS NULL THEN 'Вне описанных категорий'
                WHEN last_funding_at - first_funding_at <= 365 THEN 'Срок финансирования до года'
                ELSE 'Срок финансирования более года' END AS funding_periods_categories FROM rounds)
    GROUP BY 1""")
def _(t):
    return value_counts(ventures.with_span_class(t("rounds")), "funding_periods_categories")


@query("funding_span_volume", """
    SELECT funding_periods_categories, total, total / SUM(total) OVER () AS share FROM (
    SELECT CASE WHEN funding_rounds = 1 THEN 'Единичное финансирование'
                WHEN last_funding_at IS NULL THEN 'Вне описанных категорий'
                WHEN last_funding_at - first_funding_at <= 365 THEN 'Срок финансирования до года'
                ELSE 'Срок финансирования более года' END AS funding_periods_categories,
           SUM(funding_total_usd) AS total FROM rounds GROUP BY 1)""", digits={"total": 2, "share": 9})
def _(t):
    return sum_share(ventures.with_span_class(t("rounds")), "funding_periods_categories", "funding_total_usd")


@query("returns_by_type", """
    SELECT type, SUM(amount) AS total, SUM(amount) / (SELECT SUM(amount) FROM return_amounts) AS share
    FROM return_amounts GROUP BY type""", digits={"total": 6, "share": 9})
def _(t):
    return sum_share(t("return_amounts"), "type", "amount")


@query("yearly_dynamics", _DATED + """
    SELECT year, AVG(funding_total_usd / funding_rounds) AS avg_round,
           CAST(SUM(funding_rounds) AS BIGINT) AS n_rounds FROM busy GROUP BY year""",
       digits={"avg_round": 4}, owned=True)
def _(t):
    return ventures.yearly_dynamics(_busy(t))


@query("growing_segments", _DATED + """,
    y AS (SELECT market, year, SUM(funding_total_usd) AS total
          FROM busy WHERE market NOT IN ('mid', 'niche') GROUP BY market, year)
    SELECT market, year, total FROM y WHERE market IN (
        SELECT a.market FROM y a JOIN y b ON a.market = b.market AND a.year = 2006 AND b.year = 2007
        WHERE b.total > a.total)""", digits={"total": 2}, owned=True)
def _(t):
    return ventures.growing_segments(_busy(t), 2006, 2007)


@query("return_rate", _DATED + ", invested AS (" + " UNION ALL ".join(
    f"SELECT year, '{c}' AS type, COALESCE(SUM({c}), 0) AS v "
    "FROM busy GROUP BY year" for c in ROUND_TYPES
) + """),
    rates AS (SELECT COALESCE(r.year, i.year) AS year, COALESCE(r.type, i.type) AS type,
                     CASE WHEN v <> 0 THEN amount * 1000000 / v END AS ratio
              FROM return_amounts r FULL JOIN invested i ON r.year = i.year AND r.type = i.type),
    f AS (SELECT type AS t, quantile_cont(ratio, 0.25) AS q1, quantile_cont(ratio, 0.75) AS q3
          FROM rates GROUP BY type)
    SELECT year, type, CASE WHEN NOT ratio > q3 + (q3 - q1) * 1.5 THEN ratio END AS ratio
    FROM rates JOIN f ON type = t""", digits={"ratio": 6}, owned=True)
def _(t):
    invested = ventures.long_by_year(_busy(t, *ROUND_TYPES), "year", ROUND_TYPES)
    return ventures.return_rate(t("return_amounts"), invested)
