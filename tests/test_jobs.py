"""The jobs on small tables with the columns they were written for."""

import datetime as dt

import pytest

from tallyfold.jobs import delivery, donors, estate, games, vacancies, venues, ventures

D = dt.date


@pytest.fixture(scope="module")
def log(spark):
    """A user with two first dates, an unregistered visitor, activity before the first date."""
    rows = [
        (1, "S", D(2021, 5, 1), D(2021, 5, 1), None, None, None, None, None),
        (1, "S", D(2021, 5, 2), D(2021, 5, 1), "o1", 100.0, 0.1, "r1", "d1"),
        (1, "S", D(2021, 5, 2), D(2021, 5, 2), "o1", 50.0, 0.1, "r1", "d2"),
        (2, "S", D(2021, 5, 2), D(2021, 5, 2), None, None, None, None, None),
        (3, "S", D(2021, 5, 1), D(2021, 5, 3), None, None, None, None, None),
        (3, "S", D(2021, 5, 4), D(2021, 5, 3), "o2", 30.0, 0.2, "r2", "d3"),
        (4, "S", D(2021, 5, 4), D(2021, 5, 3), None, None, None, None, None),
        (None, "S", D(2021, 5, 2), D(2021, 5, 2), None, None, None, None, None),
        (5, "M", D(2021, 5, 2), D(2021, 5, 2), "o3", 1000.0, 0.3, "r1", "d1"),
    ]
    events = spark.createDataFrame(
        rows, "user_id int, city_id string, log_date date, first_date date, order_id string, "
              "revenue double, commission double, rest_id string, object_id string")
    cities = spark.createDataFrame([("S", "Саранск"), ("M", "Москва")], "city_id string, city_name string")
    return events, cities


SPAN = ("2021-05-01", "2021-06-30")


def test_daily_users_and_conversion(log, rows):
    assert rows(delivery.dau(*log, *SPAN, city="Саранск")) == [(D(2021, 5, 2), 1), (D(2021, 5, 4), 1)]
    assert rows(delivery.dau(*log, *SPAN)) == [(D(2021, 5, 2), 2), (D(2021, 5, 4), 1)]
    assert rows(delivery.conversion_rate(*log, *SPAN, city="Саранск")) == [
        (D(2021, 5, 1), 0.0), (D(2021, 5, 2), 0.5), (D(2021, 5, 4), 0.5)]


def test_average_check_counts_orders_once(log, rows):
    assert rows(delivery.average_check(*log, *SPAN, city="Саранск")) == [(D(2021, 5, 1), 10.5)]


def test_lifetime_value(spark, log, rows):
    partners = spark.createDataFrame(
        [("r1", "S", "А", "Кафе"), ("r2", "S", "Б", "Бар"), ("r1", "M", "В", "Бар")],
        "rest_id string, city_id string, chain string, type string")
    dishes = spark.createDataFrame(
        [("d1", "r1", "суп", 0, 0, 1), ("d2", "r1", "рыба", 0, 1, 0), ("d3", "r2", "чай", 0, 0, 0)],
        "object_id string, rest_id string, name string, spicy int, fish int, meat int")
    assert rows(delivery.ltv_top_partners(*log, partners, *SPAN, city="Саранск", k=1)) == [("r1", "А", "Кафе", 15.0)]
    got = rows(delivery.ltv_top_items(*log, partners, dishes, *SPAN, city="Саранск", k_partners=1, k_items=1))
    assert got == [("А", "суп", 0, 0, 1, 10.0)]


def test_retention_uses_the_highest_value_so_far(log, rows):
    daily = delivery.daily_retention(*log, "2021-05-01", "2021-06-24", *SPAN, city="Саранск", days=8)
    # Day 0: users 1 and 2. Day 1: user 1 (from the first of two dates), users 3 and 4.
    assert rows(delivery.retention(daily)) == [(0, 2, 1.0), (1, 3, 1.0)]
    assert rows(delivery.retention(daily, by_month=True)) == [(D(2021, 5, 1), 0, 2, 1.0), (D(2021, 5, 1), 1, 3, 1.0)]


def test_donors(spark, rows):
    donations = spark.createDataFrame(
        [(1, 10, D(2022, 1, 5), True, D(2022, 1, 6), D(2022, 1, 5)), (2, 10, D(2022, 1, 9), True, None, None),
         (3, 11, D(2022, 2, 1), False, D(2022, 2, 1), D(2022, 2, 2)), (4, 12, None, True, D(2022, 2, 1), None),
         (5, 10, D(2023, 2, 1), True, D(2022, 2, 1), D(2023, 2, 1))],
        "id int, user_id int, donation_date date, confirmation boolean, donation_added_date date, plan_date date")
    users = spark.createDataFrame(
        [(10, "А", "Мужской", D(2000, 1, 1), 3, True, None), (11, None, None, None, 1, True, False),
         (12, "А", "Мужской", D(1960, 1, 1), 0, False, True)],
        "id int, region string, gender string, birth_date date, confirmed_donations int, autho_vk boolean, autho_ok boolean")
    bonus = spark.createDataFrame([(10, 4, 2), (11, 2, None)], "user_id int, donation_count int, user_bonus_count int")

    assert rows(donors.monthly_volume(donations, "2022-01-01", "2022-12-31")) == [(D(2022, 1, 1), 2), (D(2022, 2, 1), 1)]
    assert rows(donors.most_active_users(donations)) == [(10, 2), (12, 0)]
    # User 11 is in the bonus table without a bonus on record, so it counts on both sides.
    assert rows(donors.treated_vs_rest(users, bonus)) == [
        ("Использовали бонусы", 2, 3.0), ("Не использовали бонусы", 2, 0.5)]
    assert rows(donors.channel_summary(users, {"autho_vk": "ВКонтакте", "autho_ok": "Одноклассники"})) == [
        ("ВКонтакте", 2, 2.0), ("Одноклассники", 1, 0.0)]
    assert rows(donors.one_time_vs_repeat(donations)) == [(1, 3.0)]
    assert rows(donors.plan_accuracy(donations)) == [(2, 0.4)]
    assert rows(donors.activity_by_age_band(users, "2025-01-01")) == [
        ("Мужской", "18–25 лет", 3.0), ("Пол не указан", "No info", 1.0)]
    assert rows(donors.activity_frequency(donations, users, "2022-01-01", "2022-02-28")) == [
        ("Мужской", 1, 2, 1.0), ("Пол не указан", 1, 1, 0.5)]
    assert rows(donors.donors_by_region(users)) == [("А", 2), ("Регион не указан", 1)]


def test_listings(spark):
    flats = spark.createDataFrame(
        [(i, "c1" if i % 2 else "c2", "t1" if i % 3 else "t2", 10.0 + i % 20, 1 + i % 3, None, None) for i in range(1, 61)],
        "id int, city_id string, type_id string, total_area double, rooms int, balcony int, ceiling_height double")
    ads = spark.createDataFrame(
        [(i, D(2014 + i % 3, 1 + i % 12, 10), None if i % 5 == 0 else float(i * 2), 1000.0 * i) for i in range(1, 61)],
        "id int, first_day_exposition date, days_exposition double, last_price double")
    cities = spark.createDataFrame([("c1", "Санкт-Петербург"), ("c2", "Выборг")], "city_id string, city string")
    types = spark.createDataFrame([("t1", "город"), ("t2", "село")], "type_id string, type string")

    profile = estate.duration_profile(flats, ads, cities, types).toPandas()
    assert set(profile.region) == {"Санкт-Петербург", "города Лен области"}
    f, a = flats.toPandas().set_index("id"), ads.toPandas().set_index("id")
    f = f.join(a)
    top, rooms = (f.total_area.quantile(0.99, interpolation="higher"), 3)
    kept = f[(f.total_area < top) & (f.rooms < rooms) & f.days_exposition.notna()]
    capital = kept[kept.city_id == "c1"]
    short = profile[(profile.region == "Санкт-Петербург") & profile.exposition_category.str.startswith("1")].iloc[0]
    assert short.flats_count == (capital.days_exposition < 30).sum()
    assert short.share_into_region == round((capital.days_exposition < 30).mean() + 1e-9, 2)
    assert short.avg_balcony is None or short.avg_balcony != short.avg_balcony

    seasons = estate.seasonality(flats, ads, types, first_year=2015, last_year=2016).toPandas()
    span = f[(f.type_id == "t1") & a.first_day_exposition.apply(lambda d: d.year in (2015, 2016))]
    opened = seasons[seasons.month_category == estate.OPENED]
    closed = seasons[seasons.month_category == estate.CLOSED]
    assert opened.adv_count.sum() == len(span) and closed.adv_count.sum() == span.days_exposition.notna().sum()
    assert opened["rank"].min() == 1
    assert estate.seasonality_overview(flats, ads).filter("month_category like '%размещ%'").toPandas().adv_count.sum() == 60

    places = estate.top_places(flats, ads, cities).collect()
    assert [p.city for p in places] == ["Выборг"]


def test_vacancies(spark, rows):
    df = spark.createDataFrame(
        [(1, "Аналитик данных", "J", "A", 100.0, None, "SQL", None, " "), (2, "Бизнес-аналитик", "J", "A", 200.0, 300.5, "SQL", "Python", "x"),
         (3, None, "M", "B", None, None, None, "SQL", "x"), (4, "Data Analyst", "M", "B", None, 10.0, "Python", None, None)],
        "id int, name string, experience string, employer string, salary_from double, salary_to double, "
        "key_skills_1 string, key_skills_2 string, soft_skills_1 string")
    assert rows(vacancies.salary_span(df)) == [(150.0, 100.0, 200.0, 155.0, 10.0, 301.0)]
    assert rows(vacancies.grades(df)) == [("J", 1), ("M", 1)]
    columns = ["key_skills_1", "key_skills_2", "soft_skills_1"]
    demand = vacancies.skill_demand(df, columns=columns)
    assert ("key_skills_1", "SQL", 2) in rows(demand) and ("key_skills_2", None, 2) in rows(demand)
    assert rows(vacancies.skill_totals(demand)) == [("key", "Python", 2), ("key", "SQL", 3), ("soft", "x", 2)]
    assert ("key_skills_1", "SQL", 2) not in rows(vacancies.skill_demand(df, "M", columns))
    assert rows(vacancies.vacancies_by(df, "employer", 1)) == [("A", 2)]


def test_games(spark, rows):
    raw = spark.createDataFrame(
        [("a", "P", 2005.0, "Action", 1.0, "1.0", "2", 0.5, 100.0, "10", "K-A"), ("b", "P", 2005.0, "ACTION", 1.0, "tbd", "2", 0.5, 79.0, "tbd", "E"),
         ("c", "P", None, "action", 1.0, "tbd", "2", 0.5, None, "8.5", None), ("c", "P", None, "Action", 1.0, "tbd", "2", 0.5, None, "8.5", None)],
        "Name string, Platform string, `Year of Release` double, Genre string, `NA sales` double, `EU sales` string, "
        "`JP sales` string, `Other sales` double, `Critic Score` double, `User Score` string, Rating string")
    clean = games.clean_games(raw)
    assert rows(clean.select("name", "year_of_release", "genre", "eu_sales", "critic_score", "user_score", "rating")) == [
        ("a", 2005, "action", 1.0, 100.0, 10.0, "E"), ("b", 2005, "action", 1.0, 79.0, -1.0, "E"),
        ("c", 0, "action", None, -1.0, 8.5, None)]
    assert dict(clean.dtypes)["year_of_release"] == "smallint"
    counted = games.score_crosscount(games.with_score_categories(clean))
    assert counted.count() == 9 and counted.filter("n > 0").count() == 0
    closed = games.score_crosscount(games.with_score_categories(clean, include_top=True)).filter("n > 0")
    assert rows(closed) == [("высокая оценка", "высокая оценка", 1)]
    assert rows(games.top_platforms(clean)) == [("P", 3)]


def test_venues(spark, rows):
    info = spark.createDataFrame(
        [(1, " Кафе", "кафе", "Дом 1", "Центральный административный округ", "Ежедневно, круглосуточно", 4.5, 1, 10.0),
         (2, "кафе", "кафе", "дом 1", None, None, 3.0, 1, None), (3, "Бар", "бар", "дом 2", "Южный административный округ", "пн", 5.0, 0, 3.0)],
        "id int, name string, category string, address string, district string, hours string, rating double, chain int, seats double")
    prices = spark.createDataFrame([(3, "средние", "Средний счёт:1", 1.0, None)],
                                   "id int, price string, avg_bill string, middle_avg_bill double, middle_coffee_cup double")
    joined = venues.join_prices(info, prices)
    assert joined.count() == 3 and "price_cat" in joined.columns
    clean = venues.clean_venues(joined).withColumn("distance", venues.distance())
    assert rows(clean.select("id", "name", "seats", "is_24_7", "distance")) == [
        (1, "кафе", 10, True, 0), (3, "бар", 3, False, 8)]
    assert joined.filter(venues.mentions_24_7()).count() == 1
    assert rows(venues.top_chains(clean)) == [("кафе", "кафе", 1, 4.5)]
    assert rows(venues.mean_by(clean, "distance", "rating")) == [(0, 4.5), (8, 5.0)]


def test_ventures(spark, rows):
    raw = spark.createDataFrame(
        [("A ", " Soft ", " 1,000 ", 1, "2014-01-01", None, "2014-01-03"), ("a", "soft", "1,000", 1, "2014-01-01", None, "2014-01-03"),
         (None, "hard", "50", 2, "bad", "2013-05-05", "2014-01-01"), ("x", "hard", " - ", 2, None, None, None)],
        "name string, ` market ` string, ` funding_total_usd ` string, funding_rounds int, first_funding_at string, "
        "mid_funding_at string, last_funding_at string")
    clean = ventures.clean_rounds(raw)
    got = [(r.name, r.market, r.funding_total_usd, str(r.mid_funding_at)) for r in clean.orderBy("market").collect()]
    assert got == [(ventures.NO_NAME, "hard", 50.0, "2013-05-05 00:00:00"), ("a", "soft", 1000.0, "2014-01-02 00:00:00")]
    spans = rows(ventures.with_span_class(clean).select("market", "funding_periods_categories"))
    assert spans == [("hard", "Срок финансирования более года"), ("soft", "Единичное финансирование")]


def test_venture_metrics(spark, rows):
    df = spark.createDataFrame(
        [("s", 2013, 10.0, 2, 10.0, None), ("s", 2014, 20.0, 3, None, 20.0), ("mid", 2013, 1.0, 60, 1.0, None), ("mid", 2014, 5.0, 1, 5.0, None),
         ("d", 2014, 7.0, 1, None, 7.0), (None, 2014, 1.0, 1, 1.0, None)],
        "market string, year int, funding_total_usd double, funding_rounds int, seed double, angel double")
    assert rows(ventures.growing_segments(df)) == [("s", 2013, 10.0), ("s", 2014, 20.0)]
    assert rows(ventures.funding_by_type(df, ["seed", "angel"])) == [
        ("angel", 27.0, 2, pytest.approx(27 / 44)), ("seed", 17.0, 4, pytest.approx(17 / 44))]
    assert [r[0] for r in rows(ventures.yearly_dynamics(df))] == [2013, 2014]
    dated = df.withColumn("mid_funding_at", df.year.cast("string").cast("date")).drop("year")
    assert {r.year for r in ventures.busy_years(dated, 50).collect()} == {2013}
    invested = ventures.long_by_year(df, "year", ["seed", "angel"])
    returns = spark.createDataFrame([(2013, "seed", 11.0), (2013, "angel", 2.0)], "year int, type string, amount double")
    assert rows(ventures.return_rate(returns, invested, unit=1.0)) == [
        (2013, "angel", None), (2013, "seed", 1.0), (2014, "angel", None), (2014, "seed", None)]
