"""Expressions on hand-made values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import (
    add_days, age_band, age_years, bin_half_open, contains_all, exact_amount, excludes_all, mean, midpoint,
    narrow_to_byte, narrow_to_short, normalize_text, ordinal_lookup, parse_date, parse_number, ratio,
    round_half_up, safe_ratio, starts_with, three_bands, total,
)
from tallyfold.operators import downcast


def values(spark, data, schema, expression):
    return [r[0] for r in spark.createDataFrame([(v,) for v in data], f"v {schema}").select(
        expression(F.col("v"))).collect()]


def test_normalize_text_trims_like_python(spark):
    texts = [" Кафе\t", "\n BAR  ", "a b", "", None, "\x1cx\x1f"]
    got = values(spark, texts, "string", normalize_text)
    assert got == [None if t is None else t.lower().strip() for t in texts]


def test_null_text_counts_as_no(spark):
    assert values(spark, ["abc", "xabc", None], "string", lambda c: starts_with(c, "ab")) == [True, False, False]
    got = values(spark, ["Ежедневно, КРУГЛОСУТОЧНО", "ежедневно", None], "string",
                 lambda c: contains_all(c, ["ежедневно", "круглосуточно"]))
    assert got == [True, False, False]
    assert values(spark, ["Web", "web", None], "string", lambda c: excludes_all(c, ["We"])) == [False, True, None]


def test_parse_number(spark):
    data = ["1.5", " 7 ", "1e3", "tbd", "", None, "1d", "2f", "nan", "1,000", "-3"]
    assert values(spark, data, "string", parse_number) == [
        1.5, 7.0, 1000.0, None, None, None, None, None, None, None, -3.0]


def test_parse_date(spark):
    data = ["2014-01-05", "1636-09-08", "0201-04-27", "bad", None, "2014-13-01"]
    got = values(spark, data, "string", parse_date)
    assert got == [dt.date(2014, 1, 5), dt.date(1636, 9, 8), dt.date(201, 4, 27), None, None, None]
    got = values(spark, data, "string", lambda c: parse_date(c, min_date="1677-09-22"))
    assert got == [dt.date(2014, 1, 5), None, None, None, None, None]


def test_narrowing_fails_instead_of_losing_values(spark):
    assert values(spark, [1, 127, -128, None], "int", narrow_to_byte) == [1, 127, -128, None]
    assert values(spark, [2000.0, None], "double", narrow_to_short) == [2000, None]
    for value in (40000.0, 2000.5):
        with pytest.raises(Exception, match="does not fit short"):
            values(spark, [value], "double", narrow_to_short)


def test_narrowest_type_that_fits(spark):
    df = spark.createDataFrame([(1, 1288.0, 40000, 0.5), (None, -1.0, 5, 2.0)], "a long, b double, c long, d double")
    assert [f.dataType.simpleString() for f in downcast(df, df.columns).schema] == ["tinyint", "smallint", "int", "double"]
    assert [tuple(r) for r in downcast(df, df.columns).collect()] == [tuple(r) for r in df.collect()]


def test_age_by_month_and_day(spark):
    births = [dt.date(2004, 2, 29), dt.date(2004, 2, 28), dt.date(2004, 3, 1), None]
    as_of = F.lit("2025-02-28").cast("date")
    assert values(spark, births, "date", lambda c: age_years(c, as_of)) == [20, 21, 20, None]


def test_age_bands(spark):
    ages = [17, 18, 25, 26, 35, 36, 45, 46, 55, 56, None]
    assert values(spark, ages, "int", age_band) == [
        "Error", "18–25 лет", "18–25 лет", "26–35 лет", "26–35 лет", "36–45 лет", "36–45 лет",
        "46–55 лет", "46–55 лет", "Старше 55", "No info"]


def test_half_open_bins(spark):
    scores = [-1.0, 0.0, 2.99, 3.0, 8.0, 9.99, 10.0, None]
    cut = lambda **kw: values(spark, scores, "double", lambda c: bin_half_open(c, (0, 3, 8, 10), "lmh", **kw))
    assert cut() == [None, "l", "l", "m", "h", "h", None, None]
    assert cut(include_top=True) == [None, "l", "l", "m", "h", "h", "h", None]


def test_three_bands(spark):
    data = [34, 35, 120, 121, None]
    assert values(spark, data, "int", lambda c: three_bands(c, 35, 120, ["s", "m", "l"])) == [
        "s", "m", "m", "l", None]


def test_ordinal_lookup(spark):
    got = values(spark, ["a", "b", "zz", None], "string", lambda c: ordinal_lookup(c, {"a": 0, "b": 3}, 8))
    assert got == [0, 3, 8, 8]


def test_rounding_is_decimal(spark):
    assert values(spark, [1.005, 2.675, -1.005, None], "double", lambda c: round_half_up(c, 2)) == [
        1.01, 2.68, -1.01, None]
    df = spark.createDataFrame([(29, 200), (1, 8), (1, 0)], "a long, b long")
    got = [r[0] for r in df.select(ratio(F.col("a"), F.col("b"), 2)).collect()]
    assert got == [0.15, 0.13, None]


def test_sums_and_means_keep_all_digits(spark):
    def both(values):
        return tuple(spark.createDataFrame([(v,) for v in values], "v double").agg(total(F.col("v")), mean(F.col("v"))).first())

    assert both([0.004, 0.004, 1.0]) == pytest.approx((1.008, 0.336), rel=1e-15)
    assert both([1e17, 2e17]) == (3e17, 1.5e17)
    assert both([0.00004]) == (0.00004, 0.00004)
    assert both([1.0, float("nan"), None]) == (1.0, 1.0)
    assert both([None]) == (None, None)


def test_amounts_of_any_number_of_digits(spark):
    got = values(spark, [0.1 + 0.2, 1234.56, 0.004, 0.0000004, 1e300, None], "double", exact_amount)
    assert [None if v is None else f"{v:f}" for v in got] == ["0.300000", "1234.560000", "0.004000", "0.000000", None, None]


def test_zero_denominator(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_ratio(F.col("a"), F.col("b"))).collect()] == [None, 0.5]
    assert [r[0] for r in df.select(safe_ratio(F.col("a"), F.col("b"), 1e-60)).collect()][0] > 1e59


def test_dates(spark):
    df = spark.createDataFrame(
        [(dt.date(2014, 1, 1), dt.date(2014, 1, 4), 2.5), (None, dt.date(2014, 1, 4), 3.5),
         (dt.date(2014, 1, 1), None, None)], "a date, b date, n double")
    got = df.select(midpoint(F.col("a"), F.col("b")).cast("string"), add_days(F.col("b"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [
        ("2014-01-02 12:00:00", dt.date(2014, 1, 6)), (None, dt.date(2014, 1, 8)), (None, None)]
