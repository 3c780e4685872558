import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import (
    FLAT_TRIMS, Trim, boxplot_stats, categorical_crosscount, collapse_segments, describe_column,
    drop_outlier_entities, growing_keys, histogram, iqr_null_upper, iqr_outliers, percentile_trim,
    per_column_totals, pivot_count, running_max, size_classes, span_class, top_k, top_k_with_ties,
    value_counts, with_group_size,
)
from tallyfold.operators.reshape import aligned_ratio


def test_trim_is_strict_and_nulls_pass_only_where_allowed(spark):
    data = [(i, float(i), i % 5, None if i % 2 else i % 7, 2.0 + i / 100) for i in range(1, 201)]
    data += [(901, None, 1, 1, 3.0), (902, 50.0, None, None, None)]
    df = spark.createDataFrame(
        data, "id int, total_area double, rooms int, balcony int, ceiling_height double")
    kept = {r.id for r in percentile_trim(df, FLAT_TRIMS).collect()}
    arr = lambda i: np.array([r[i] for r in data if r[i] is not None], float)
    q = lambda i, p: np.quantile(arr(i), p, method="inverted_cdf")
    want = {
        r[0] for r in data
        if r[1] is not None and r[1] < q(1, 0.99)
        and (r[2] is None or r[2] < q(2, 0.99)) and (r[3] is None or r[3] < q(3, 0.99))
        and (r[4] is None or q(4, 0.01) < r[4] < q(4, 0.99))
    }
    assert kept == want and 902 in kept and 901 not in kept
    again = percentile_trim(df, [Trim("total_area", below=0.99)])
    assert again.columns == df.columns


def segments(spark):
    data = [(f"n{i}", "s", float(v)) for i, v in enumerate([10, 11, 12, 13, 14, 100])]
    data += [("n5", "t", 50.0), ("n7", "t", 51.0), (None, "s", 12.0), ("n8", None, 1e9), ("n9", "s", None)]
    return spark.createDataFrame(data, "name string, market string, total double")


def test_iqr_lists_the_missing_segment_without_members(spark, rows):
    got = rows(iqr_outliers(segments(spark), "market", "total", "name"))
    assert got == [("s", 8, 1, 0.125), ("t", 2, 0, 0.0), (None, 0, 0, None)]


def test_namesakes_go_too_and_nameless_rows_stay(spark):
    left = drop_outlier_entities(segments(spark), "market", "total", "name").collect()
    assert sorted((r.name or "", r.market or "") for r in left) == [
        ("", "s"), ("n0", "s"), ("n1", "s"), ("n2", "s"), ("n3", "s"), ("n4", "s"), ("n7", "t"),
        ("n8", ""), ("n9", "s")]


def test_upper_values_become_null_only(spark):
    got = {(r.name, r.market): r.total for r in iqr_null_upper(segments(spark), "market", "total").collect()}
    assert got["n5", "s"] is None and got["n5", "t"] == 50.0 and got["n8", None] == 1e9


def test_size_classes_at_the_limits(spark):
    data = [(s,) for s, n in (("a", 34), ("b", 35), ("c", 120), ("d", 121)) for _ in range(n)] + [(None,)] * 3
    df = spark.createDataFrame(data, "m string")
    got = {r.m: (r.n, r.size_class) for r in size_classes(df, "m").collect()}
    assert got == {"a": (34, "Нишевые"), "b": (35, "Средние"), "c": (120, "Средние"), "d": (121, "Массовые")}
    names = {(r.m, r.segment_category) for r in collapse_segments(df, "m").collect()}
    assert names == {("niche", "Нишевые"), ("mid", "Средние"), ("d", "Массовые"), (None, None)}
    assert {r.group_size for r in with_group_size(df, "m").filter("m is null").collect()} == {None}


def test_span_class_follows_the_order_of_rules(spark):
    df = spark.sql("""select * from values
        (1, null, null), (2, date'2014-01-01', date'2015-01-01'), (2, date'2014-01-01', date'2015-01-02'),
        (2, null, date'2015-01-01'), (null, date'2014-01-01', null) as t(r, a, b)""")
    got = [r[0] for r in df.select(span_class(F.col("r"), F.col("a"), F.col("b"))).collect()]
    assert got == ["Единичное финансирование", "Срок финансирования до года",
                   "Срок финансирования более года", "Срок финансирования более года", "Вне описанных категорий"]


def test_histogram_matches_numpy(spark):
    values = [0.0, 1.0, 1.5, 2.0, 9.9, 10.0, None]
    got = histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", 5).orderBy("bin").collect()
    counts, edges = np.histogram([v for v in values if v is not None], 5)
    assert [r.n for r in got] == counts.tolist()
    assert [r.lower for r in got] + [got[-1].upper] == pytest.approx(edges.tolist())
    same = histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r.n for r in same] == np.histogram([3.0, 3.0], 4)[0].tolist()


def test_boxplot(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100, -50]], "v double")
    assert tuple(boxplot_stats(df, "v").first()) == (1.5, 3.0, 4.5, 1.0, 5.0, 2)


def test_describe(spark):
    values = [1.0, 2.0, 4.0, 8.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.stat: r.value for r in describe_column(df, "v", (0.25, 0.5, 0.75, 0.95)).collect()}
    import pandas as pd

    assert got == pytest.approx(pd.Series(values).describe(percentiles=[0.25, 0.5, 0.75, 0.95]).to_dict())


def test_ties_and_top_k(spark, rows):
    df = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", 1), ("e", None)], "k string, n int")
    assert rows(top_k_with_ties(df, 2, "n")) == [("a", 3), ("b", 2), ("c", 2)]
    assert rows(top_k_with_ties(df, 9, "n")) == [("a", 3), ("b", 2), ("c", 2), ("d", 1)]
    assert [r.k for r in top_k(df, 2, "n", ["k"]).collect()] == ["a", "b"]


def test_cross_count_shows_empty_pairs(spark, rows):
    df = spark.createDataFrame([("x", "1", "n"), ("x", "1", None), (None, "1", "n")], "a string, b string, c string")
    assert rows(categorical_crosscount(df, "a", ["x", "y"], "b", ["1", "2"], "c")) == [
        ("x", "1", 1), ("x", "2", 0), ("y", "1", 0), ("y", "2", 0)]


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    got = {r.v: (r.n, r.share) for r in value_counts(df, "v").collect()}
    assert got == {"a": (2, pytest.approx(2 / 3)), "b": (1, pytest.approx(1 / 3))}


def test_column_totals(spark, rows):
    df = spark.createDataFrame([(1.0, None), (0.0, None), (2.5, None)], "seed double, angel double")
    assert rows(per_column_totals(df, ["seed", "angel"])) == [("angel", 0.0, 0), ("seed", 3.5, 2)]


def test_pivot_null_or_zero(spark, rows):
    df = spark.createDataFrame([("r", "a", "n"), ("r", "a", None), (None, "a", "n")], "k string, c string, n string")
    assert rows(pivot_count(df, "k", "c", ["a", "b"], "n")) == [("r", 1, None)]
    assert rows(pivot_count(df, "k", "c", ["a", "b"], "n", fill_zero=True)) == [("r", 1, 0)]


def test_growth_needs_both_periods(spark, rows):
    df = spark.createDataFrame(
        [("a", 2013, 1.0), ("a", 2014, 2.0), ("b", 2014, 5.0), ("c", 2013, 2.0), ("c", 2014, 2.0), (None, 2014, 1.0)],
        "m string, y int, v double")
    assert rows(growing_keys(df, "m", "y", "v", 2013, 2014)) == [("a", 1.0, 2.0)]


def test_aligned_ratio_keeps_keys_of_one_side(spark, rows):
    num = spark.createDataFrame([(1, "a", 2.0), (2, "a", 3.0), (3, "a", 1.0)], "year int, type string, v double")
    den = spark.createDataFrame([(1, "a", 4.0), (2, "a", 0.0), (4, "a", 1.0)], "year int, type string, v double")
    assert rows(aligned_ratio(num, den, ["year", "type"], "v", 10.0)) == [
        (1, "a", 5.0), (2, "a", None), (3, "a", None), (4, "a", None)]
    shifted = {r.year: r.ratio for r in aligned_ratio(num, den, ["year", "type"], "v", 1.0, 1e-60).collect()}
    assert shifted[2] > 1e59 and shifted[3] is None


def test_running_max(spark, rows):
    df = spark.createDataFrame([("m", 0, 3), ("m", 1, 5), ("m", 2, 4), ("k", 0, 1)], "g string, d int, n int")
    assert rows(running_max(df, "n", "d", ["g"])) == [("k", 0, 1, 1), ("m", 0, 3, 3), ("m", 1, 5, 5), ("m", 2, 4, 5)]
