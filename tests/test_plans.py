"""What the physical plans must and must not contain."""

import re

import pytest

from pyspark.sql import functions as F

from tallyfold import session
from tallyfold.jobs import delivery
from tallyfold.operators import bucketed, count_values, exact_quantiles, quantiles, top_k
from tallyfold.plans import QUERIES, run
from tallyfold.plans.standins import Tables


def final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text


def static_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_product_and_no_python_rows(name, spark, sf_dir):
    if name in ("src_csv", "src_csv_semicolon"):
        return
    plan = static_plan(run(name, spark, sf_dir))
    assert "CartesianProduct" not in plan
    if not name.startswith("phik_"):
        assert "Python" not in plan and "Pandas" not in plan
    # The only joins without a key add one row of totals or limits.
    for line in plan.splitlines():
        if "BroadcastNestedLoopJoin" in line:
            assert "Inner" in line and name in ONE_ROW_JOINS, line


ONE_ROW_JOINS = {
    "percentile_trim", "boxplot_stats", "histogram", "phik_matrix", "contingency_table",
    "cramers_v", "duration_profile", "top_places", "phik_rated_venues", "phik_row_of_rating", "phik_distance_bill",
}


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = static_plan(run("filter_date_part", spark, sf_dir))
    assert "GreaterThanOrEqual(o_orderdate,1996" in plan and "LessThan(o_orderdate,1" in plan
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>", plan)
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double>" in static_plan(
        run("group_sum", spark, sf_dir))


def test_top_k_sorts_no_full_table(spark, sf_dir):
    plan = static_plan(run("top_k", spark, sf_dir))
    assert "TakeOrderedAndProject" in plan


def test_quantiles_read_one_table_of_counted_values(spark, sf_dir, monkeypatch):
    """Neither the short walk nor the search by cells reads the rows again, and the counts are made in part before the shuffle."""
    lines = Tables(spark, sf_dir)("lineitem")
    counted = static_plan(count_values(lines, "l_extendedprice", ["l_returnflag"]))
    assert counted.count("FileScan parquet") == 1 and counted.count("HashAggregate") == 2 and counted.count("Exchange") == 1
    for few in (quantiles.FEW, 0):
        monkeypatch.setattr(quantiles, "FEW", few)
        plan = final_plan(exact_quantiles(lines, "l_extendedprice", [0.25, 0.75], ["l_returnflag"]))
        assert "l_extendedprice:double" not in plan and "SortMergeJoin" not in plan


def test_a_trim_scans_each_base_table_once(spark, sf_dir, monkeypatch):
    written = []
    monkeypatch.setattr(session, "settle", lambda df, name, do=session.settle: (written.append(static_plan(df)), do(df, name))[1])
    monkeypatch.setattr(quantiles, "settle", session.settle)
    written.append(static_plan(run("percentile_trim", spark, sf_dir)))
    scans = [s for plan in written for s in re.findall(r"FileScan parquet .*?Location: .*?/(\w+)\.parquet", plan)]
    assert sorted(scans) == ["customer", "lineitem", "orders"]


def test_counting_copies_sorts_nothing(spark, sf_dir):
    assert "SortAggregate" not in final_plan(run("dedup_all_columns", spark, sf_dir))


def test_bucketed_copies_meet_without_an_exchange(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = Tables(spark, sf_dir)
        lines, orders = bucketed(t("lineitem"), ["l_orderkey"], 4), bucketed(t("orders"), ["o_orderkey"], 4)
        both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        assert "Exchange" not in static_plan(both) and both.count() == t("lineitem").count()
        sales = lines.join(t("orders"), lines.l_orderkey == F.col("o_orderkey"))
        assert static_plan(sales).count("Exchange") == 1
        # The best items of the best partners, from a log laid out by partner: its sums need no exchange.
        log = t("sales").where("revenue IS NOT NULL")
        laid = bucketed(log, ["rest_id", "city_id"], 4)
        per_partner = laid.groupBy("rest_id", "city_id").agg(F.sum("revenue").alias("r"))
        assert "Exchange" not in static_plan(per_partner)
        assert per_partner.count() == log.select("rest_id", "city_id").distinct().count()
        best = [delivery.ltv_top_items(x, t("service_cities"), t("partners"), t("dishes"), "1996-05-01", "1999-06-30", city="ASIA") for x in (log, laid)]
        assert sorted(best[0].collect()) == sorted(best[1].collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_aggregates_combine_before_the_shuffle(spark, sf_dir):
    plan = static_plan(run("group_sum", spark, sf_dir))
    assert plan.index("partial_sum") > plan.index("Exchange")
    assert "Window" not in static_plan(run("group_size_per_row", spark, sf_dir))
    assert "Window" not in static_plan(run("dedup_keep_first", spark, sf_dir))
    assert "Window" not in static_plan(run("top_k_with_ties", spark, sf_dir))


def test_top_k_breaks_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 1)], "k string, n int")
    assert [r.k for r in top_k(df, 2, "n", ["k"]).collect()] == ["a", "b"]
