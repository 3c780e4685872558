import datetime as dt

from pyspark.sql import functions as F

from tallyfold.functions import starts_with
from tallyfold.operators import (
    count_duplicates, dedup_keep_first, domain_check, duplicate_groups, fill_group_mean,
    hidden_duplicates, implausible_dates, key_uniqueness, missing_share_by, missing_stats,
    missingness_rule, period_completeness, row_loss_report, snake_case_columns, unfill_sentinel,
)
from tallyfold.session import scratch_path, settle
from tallyfold.sources import preview, read_csv, schema_profile


def gaps(spark):
    return spark.createDataFrame(
        [("a", 2000, 1.0), ("a", 2000, None), ("a", 2000, 2.0), ("a", None, None), (None, 2000, None),
         (None, 2000, 9.0), ("b", 2001, None), ("c", 2002, -1.0)],
        "platform string, year int, sales double")


def test_missing_stats_lists_only_columns_with_gaps(spark, rows):
    df = gaps(spark).withColumn("full", F.lit(1))
    assert rows(missing_stats(df)) == [("platform", 2, 0.25), ("sales", 4, 0.5), ("year", 1, 0.125)]
    assert missing_stats(df.select("full")).count() == 0


def test_not_a_number_is_missing(spark, rows):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    assert rows(missing_stats(df)) == [("v", 1, 0.5)]


def test_missing_share_drops_the_null_group(spark, rows):
    assert rows(missing_share_by(gaps(spark), "platform").select("platform", "sales")) == [
        ("a", 0.5), ("b", 1.0), ("c", 0.0)]


def test_group_mean_never_uses_a_missing_key(spark):
    filled = fill_group_mean(gaps(spark), "sales", ["platform", "year"])
    got = {(r.platform, r.year): sorted(x.sales or 0 for x in filled.collect()
                                        if (x.platform, x.year) == (r.platform, r.year))
           for r in filled.collect()}
    assert got[("a", 2000)] == [1.0, 1.5, 2.0]
    assert got[("a", None)] == [0] and got[(None, 2000)] == [0, 9.0] and got[("b", 2001)] == [0]


def test_sentinel_round_trip(spark, rows):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 0.0)], "id int, seats double")
    assert rows(unfill_sentinel(df.fillna({"seats": -1}), -1.0, ["seats"])) == rows(df)


def dups(spark):
    return spark.createDataFrame(
        [(1, "Кафе", "x", 1), (2, "кафе ", "x", 2), (3, "Бар", None, 3), (4, "Бар", None, 4),
         (5, "Кафе", "x", 5)], "id int, name string, address string, payload int")


def test_duplicates_count_null_as_equal(spark, rows):
    df = dups(spark).select("name", "address")
    assert rows(count_duplicates(df)) == [(5, 3, 2)]
    assert rows(count_duplicates(df.filter("false"))) == [(0, 0, 0)]


def test_keep_first_takes_the_whole_row(spark, rows):
    once = dedup_keep_first(dups(spark), ["name", "address"], "id")
    assert [r[0] for r in rows(once)] == [1, 2, 3] and once.columns == ["id", "name", "address", "payload"]
    assert rows(dedup_keep_first(once, ["name", "address"], "id")) == rows(once)


def test_all_members_of_duplicate_groups(spark, rows):
    assert [r[0] for r in rows(duplicate_groups(dups(spark), ["name", "address"]))] == [1, 3, 4, 5]


def test_hidden_duplicates(spark, rows):
    assert rows(hidden_duplicates(dups(spark), "name")) == [(3, 2)]


def test_row_loss(spark, rows):
    df = dups(spark)
    assert rows(row_loss_report(df, df.dropna())) == [(5, 3, 2, 40.0)]
    assert rows(row_loss_report(df.filter("false"), df.filter("false"))) == [(0, 0, 0, None)]


def test_rule_explains_gaps(spark, rows):
    df = spark.createDataFrame(
        [("Средний счёт: 1", 1.0), ("Цена", None), (None, None), ("Средний счёт: 2", None)],
        "bill string, mid double")
    rule = ~starts_with(F.col("bill"), "Средний счёт")
    assert rows(missingness_rule(df, "mid", rule)) == [(3, 2, 1)]


def test_domain(spark, rows):
    df = spark.createDataFrame([("E",), ("K-A",), (None,), ("E",)], "r string")
    assert rows(domain_check(df, "r", ["E", "T"])) == [("E", 2, True), ("K-A", 1, False), (None, 1, False)]


def test_period_shows_missing_days(spark, rows):
    df = spark.createDataFrame(
        [(dt.datetime(2014, 12, 1, 5),), (dt.datetime(2014, 12, 3, 23, 59),), (dt.datetime(2014, 12, 4),)],
        "t timestamp_ntz")
    got = rows(period_completeness(df, "t", "2014-12-01", "2014-12-03"))
    assert [(d.day, n) for d, n in got] == [(1, 1), (2, 0), (3, 1)]


def test_keys(spark, rows):
    assert rows(key_uniqueness(dups(spark), ["id"])) == [(5, 5, True)]
    assert rows(key_uniqueness(dups(spark), ["name", "address"])) == [(5, 3, False)]


def test_implausible_dates(spark, rows):
    days = [dt.date(201, 4, 27), dt.date(1999, 5, 1), dt.date(1999, 6, 1), dt.date(3016, 3, 28), None]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = rows(implausible_dates(df, F.col("d"), "1970-01-01", "2025-01-01"))
    assert [(r[0], r[3], r[4]) for r in got] == [(1999, 2, 0), (201, 1, 1), (3016, 1, 1)]


def test_profile_and_preview(spark, rows):
    got = rows(schema_profile(gaps(spark)))
    assert got == [(1, "platform", "string", 6, 8), (2, "year", "int", 7, 8), (3, "sales", "double", 4, 8)]
    assert [r.id for r in preview(dups(spark), 2, [F.col("id").desc()]).collect()] == [5, 4]


def test_snake_case(spark):
    df = spark.createDataFrame([(1, 2)], "`Year of Release` int, Name int")
    assert snake_case_columns(df).columns == ["year_of_release", "name"]


def test_csv_round_trip_with_quotes_and_breaks(spark, rows):
    df = spark.createDataFrame([("a;b", 'say "x"', 1), ("line\nbreak", None, None)], "a string, b string, n int")
    path = scratch_path(spark, "csv")
    df.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    assert rows(read_csv(spark, path, "a string, b string, n int", ";", quoted_newlines=True)) == rows(df)


def test_settled_table_is_the_same(spark, rows):
    assert rows(settle(gaps(spark), "gaps")) == rows(gaps(spark))


def test_dedup_keeps_rows_without_order_and_breaks_ties(spark):
    df = spark.createDataFrame(
        [("a", None, "x"), ("b", 2, "late"), ("b", 1, "q"), ("b", 1, "p"), ("c", None, "z"), ("c", 5, "y")], "k string, o int, p string")
    got = sorted(tuple(r) for r in dedup_keep_first(df, ["k"], "o").collect())
    assert got == [("a", None, "x"), ("b", 1, "p"), ("c", 5, "y")]


def test_group_mean_fills_not_a_number_and_keeps_small_values(spark):
    df = spark.createDataFrame([("a", 0.004), ("a", None), ("a", float("nan")), (None, None)], "k string, v double")
    got = sorted((tuple(r) for r in fill_group_mean(df, "v", ["k"]).collect()), key=repr)
    assert got == [("a", 0.004), ("a", 0.004), ("a", 0.004), (None, None)]
