"""Bitmaps, range joins, group values, counted values, zip members, profiles and owned tables."""

import csv
import datetime as dt
import io
import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold import session
from tallyfold.jobs import delivery
from tallyfold.operators import (
    Histogram, TableProfile, coarser_bitmaps, count_bitmaps, count_duplicates, count_values, domain_check,
    duplicate_groups, fill_group_mean, id_bitmaps, implausible_dates, join_group_values, key_uniqueness, merge_bitmaps,
    merge_counts, missing_share_by, missing_stats, number_ids, range_join, with_group_size,
)
from tallyfold.operators import keys as key_joins
from tallyfold.operators import quantiles
from tallyfold.session import scratch_scope, settle, settle_computed
from tallyfold.sources import read_zip_csv, schema_profile

D = dt.date


def test_bitmaps_count_what_distinct_counts(spark, rows):
    rng = random.Random(1)
    data = [(rng.randint(0, 3), rng.choice([None, rng.randint(-50_000, 200_000)])) for _ in range(5000)]
    df = spark.createDataFrame(data, "day int, user long")
    want = rows(df.groupBy("day").agg(F.count_distinct("user").alias("n")))
    assert rows(count_bitmaps(id_bitmaps(df, ["day"], "user"), ["day"], "n")) == want
    # New rows are added without the old ones; coarser keys need no rows at all.
    old, new = id_bitmaps(df.where("day < 2"), ["day"], "user"), id_bitmaps(df.where("day >= 2"), ["day"], "user")
    merged = settle(merge_bitmaps([old, new, new], ["day"]), "bitmaps")
    assert rows(count_bitmaps(merged, ["day"], "n")) == want
    halves = merged.withColumn("half", F.expr("day div 2"))
    assert rows(count_bitmaps(coarser_bitmaps(halves, ["half"]), ["half"], "n")) == rows(
        df.groupBy(F.expr("day div 2").alias("half")).agg(F.count_distinct("user").alias("n")))


def test_ids_are_numbered_without_gaps_and_on(spark):
    df = spark.createDataFrame([(f"u{i * i % 977}",) for i in range(3000)] + [(None,)], "id string")
    known = settle(number_ids(df, "id"), "known")
    got = known.orderBy("number").collect()
    assert [r.number for r in got] == list(range(1, len(got) + 1)) and [r.id for r in got] == sorted({f"u{i * i % 977}" for i in range(3000)})
    more = number_ids(spark.createDataFrame([("u0",), ("new",), ("a",)], "id string"), "id", known).collect()
    assert len(more) == len(got) + 2 and {r.id: r.number for r in more}["a"] == len(got) + 1
    assert number_ids(df.limit(0), "id").count() == 0


def test_retention_of_bitmaps(spark, rows):
    rng = random.Random(2)
    events = []
    for user in range(1, 80):
        first = D(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 45))
        for _ in range(rng.randint(1, 9)):
            events.append((user if rng.random() < 0.95 else None, 1, first + dt.timedelta(days=rng.randint(0, 12)), first))
    log = spark.createDataFrame(events, "user_id long, city_id int, log_date date, first_date date")
    cities = spark.createDataFrame([(1, "x")], "city_id int, city_name string")
    span = ("2024-01-01", "2024-02-10", "2024-01-01", "2024-02-20")
    daily = delivery.daily_retention(log, cities, *span)
    assert rows(delivery.daily_retention_binned(log, cities, *span)) == rows(daily)
    first = delivery.user_bitmaps(log.where("first_date <= '2024-02-10'"), "first_date")
    active = delivery.user_bitmaps(log.where("log_date <= '2024-02-20'"), "log_date")
    for by_month in (False, True):
        assert rows(delivery.retention_of_bitmaps(first, active, by_month)) == rows(delivery.retention(daily, by_month))
    assert "Exchange" in delivery.retention_of_bitmaps(first, active)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("low, high", [(0, 7), (-3, 3), (5, 5), (-9, -2)])
def test_range_join_is_the_filtered_join(spark, rows, low, high):
    rng = random.Random(high)
    left = [(rng.choice(["a", "b", None]), rng.choice([None, D(2024, 1, 1) + dt.timedelta(days=rng.randint(-40, 40))]), i) for i in range(60)]
    right = [(rng.choice(["a", "b", "c", None]), D(2023, 12, 1) + dt.timedelta(days=rng.randint(0, 90)), i) for i in range(200)]
    a, b = spark.createDataFrame(left, "k string, s date, i int"), spark.createDataFrame(right, "k string, t date, j int")
    want = rows(a.join(b, "k").filter(F.datediff("t", "s").between(low, high)).select("k", "s", "i", "t", "j"))
    assert rows(range_join(a, b, "k", "s", "t", low, high).select("k", "s", "i", "t", "j")) == want and want
    with pytest.raises(ValueError):
        range_join(a, b, "k", "s", "t", 2, 1)


def test_a_hot_user_is_dealt_over_the_bins_of_a_range_join(spark):
    """A third of the visits is one user's; no task of the join reads more than twice the median."""
    n, tasks = 60_000, 8
    user = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 2000)
    visits = spark.range(n).select(user.alias("u"), ((F.col("id") * 7919) % 1600).alias("t"))
    first = spark.range(2000).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("s")).union(spark.range(200).selectExpr("-1L", "id * 8"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": str(tasks)}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        met = range_join(first, visits, "u", "s", "t", 0, 7)
        per_task = sorted(r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect())
        assert len(per_task) == tasks and per_task[-1] <= 2 * np.median(per_task)
        assert met.where("u = -1").count() == n // 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("hot_key", ["-1", "null"])
def test_group_values_reach_hot_keys_without_adaptive_splits(spark, hot_key):
    """A third of the rows in one key or without a key, and no help from adaptive execution."""
    n, tasks = 90_000, 8
    key = F.when(F.col("id") % 3 == 0, F.expr(hot_key).cast("long")).otherwise(F.col("id") % 5000)
    df = spark.range(n).select("id", key.alias("k"))
    groups = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": str(tasks)}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        met = join_group_values(df, groups, ["k"], "n")
        per_task = sorted(r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect())
        assert sum(per_task) == n and per_task[-1] <= 2 * np.median(per_task)
        assert met.columns == ["id", "k", "n", "first"] and met.where("n IS NULL").count() == 0
        assert met.where("k <=> " + hot_key).agg(F.min("n"), F.max("n"), F.min("first")).first()[:] == (n // 3, n // 3, 0)
        some = join_group_values(df, groups.where("n < 100 OR k % 2 = 0"), ["k"], "n", how="inner")
        assert some.count() == n - n // 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_few_groups_are_broadcast_whole(spark, rows, monkeypatch):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0), (None, None)], "k string, v double")
    want = [rows(with_group_size(df, "k")), rows(fill_group_mean(df, "v", ["k"]))]
    monkeypatch.setattr(key_joins, "HOT_SHARE", 1)
    assert [rows(with_group_size(df, "k")), rows(fill_group_mean(df, "v", ["k"]))] == want


def test_counts_of_days_merge_into_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    days = [rng.lognormal(0, 3, 700).round(2).tolist() for _ in range(3)]
    frames = [spark.createDataFrame([("k", v) for v in d], "k string, v double") for d in days]
    every = np.concatenate(days)
    for few in (quantiles.FEW, 10):
        monkeypatch.setattr(quantiles, "FEW", few)
        counted = merge_counts([count_values(f, "v", ["k"]) for f in frames], ["k"])
        histogram = Histogram(counted, ["k"])
        got = {r.p: r.q for r in histogram.quantiles([0.1, 0.5, 0.9]).collect()}
        assert got == pytest.approx({p: np.quantile(every, p) for p in got}, rel=1e-12)
        assert [tuple(r) for r in histogram.sizes("n").collect()] == [("k", 2100)]


def test_digests_tell_nulls_apart(spark, rows):
    df = spark.createDataFrame([(None, "a", 0.0), ("a", None, 0.0), ("a", None, -0.0), ("", "a", 0.0), (None, "a", None)], "x string, y string, z double")
    assert tuple(count_duplicates(df).first()) == (5, 4, 1)
    assert rows(duplicate_groups(df, ["x", "y"]).select("x", "y")) == sorted([("a", None)] * 2 + [(None, "a")] * 2, key=repr)


def zipped(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, lines, sep in members:
            out = io.StringIO()
            writer = csv.writer(out, delimiter=sep, lineterminator="\n")
            writer.writerow(["id", "name", "price", "day"])
            writer.writerows(lines)
            archive.writestr(name, out.getvalue())
        archive.writestr("notes/readme.txt", "nothing to read")
        archive.writestr("empty.csv", "")


def test_members_of_zip_archives_are_read_in_pieces(spark, rows, tmp_path):
    rng = random.Random(6)
    line = lambda i: [i, rng.choice(["a;b", 'q"uote', "é", "x,y", ""]), rng.choice(["1.5", "", "-2e3"]), "2024-01-%02d" % (1 + i % 28)]
    small, large = [line(i) for i in range(50)], [line(i) for i in range(50, 60_000)]
    path = str(tmp_path / "data.zip")
    zipped(path, [("one.csv", small, ";"), ("folder/two.csv", large, ";")])
    schema = "name string, id long, price double, day date"
    df = read_zip_csv(spark, path, schema, sep=";", members="*.csv")
    assert df.rdd.getNumPartitions() == 3
    want = [(n or None, i, float(p) if p else None, dt.date.fromisoformat(d)) for i, n, p, d in small + large]
    assert rows(df) == sorted(want, key=repr)
    plain = tmp_path / "plain"
    plain.mkdir()
    with open(plain / "one.csv", "w", newline="") as f:
        writer = csv.writer(f, delimiter=";", lineterminator="\n")
        writer.writerow(["id", "name", "price", "day"])
        writer.writerows(small)
    from tallyfold.sources import read_csv

    unpacked = read_csv(spark, str(plain), "id long, name string, price double, day date", ";").select("name", "id", "price", "day")
    assert rows(read_zip_csv(spark, path, schema, sep=";", members="one.csv")) == rows(unpacked)
    os.mkdir(tmp_path / "many")
    for i in range(3):
        zipped(str(tmp_path / "many" / f"{i}.zip"), [("a.csv", small, ",")])
    assert read_zip_csv(spark, str(tmp_path / "many"), schema, members="a.csv").count() == 150
    assert read_zip_csv(spark, path, schema, members="no such").count() == 0


def test_one_scan_feeds_all_reports(spark, rows, tmp_path):
    rng = random.Random(8)
    data = [(rng.choice(["x", "y", None]), rng.choice([1, 2, None]), rng.choice([1.5, float("nan"), None]), D(rng.choice([1999, 2024]), 1, 1 + i % 9), i // 2) for i in range(300)]
    path = str(tmp_path / "t")
    spark.createDataFrame(data, "k string, n int, v double, d date, id int").write.parquet(path)
    df = spark.read.parquet(path)
    plans = []
    import tallyfold.operators.profiles as module

    keep = module.settle
    module.settle = lambda frame, name: (plans.append(frame._jdf.queryExecution().executedPlan().toString()), keep(frame, name))[1]
    try:
        profile = TableProfile(df, groups=["k"], values=["k", "n"], keys=[["id"], ["id", "d"]], days={"d": (F.col("d"), "2000-01-01", "2024-12-31")})
    finally:
        module.settle = keep
    assert len(plans) == 1 and plans[0].count("FileScan parquet") == 1
    assert rows(profile.missing_stats()) == rows(missing_stats(df))
    assert rows(profile.missing_share_by("k")) == rows(missing_share_by(df, "k"))
    assert rows(profile.domain_check("n", [1])) == rows(domain_check(df, "n", [1]))
    assert rows(profile.domain_check("k", ["x"])) == rows(domain_check(df, "k", ["x"]))
    for k in (["id"], ["id", "d"]):
        assert rows(profile.key_uniqueness(k)) == rows(key_uniqueness(df, k))
    assert rows(profile.implausible_dates("d")) == rows(implausible_dates(df, F.col("d"), "2000-01-01", "2024-12-31"))
    assert rows(profile.schema_profile().drop("non_null")) == rows(schema_profile(df).drop("non_null"))
    assert profile.missing_stats().columns == missing_stats(df).columns
    empty = TableProfile(df.limit(0), keys=[["id"]])
    assert rows(empty.key_uniqueness(["id"])) == rows(key_uniqueness(df.limit(0), ["id"])) and empty.missing_stats().count() == 0


def files(base):
    return sorted(n for n in os.listdir(base))


def test_a_scope_deletes_its_tables_and_hands_out_its_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    with scratch_scope() as outer:
        with scratch_scope() as inner:
            a = settle(spark.range(5), "a")
            kept = inner.result(a.selectExpr("id * 2 AS x"), "kept")
            assert files(tmp_path) == ["a", "kept"]
        assert files(tmp_path) == ["kept"] and sorted(r.x for r in kept.collect()) == [0, 2, 4, 6, 8]
        settle(spark.range(3), "b")
        outer.free()
        assert files(tmp_path) == []
    with pytest.raises(RuntimeError), scratch_scope():
        settle(spark.range(3), "c")
        raise RuntimeError
    assert files(tmp_path) == []
    assert settle(spark.range(2), "stays").count() == 2 and files(tmp_path) == ["stays"]


def test_only_computed_rows_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    plain = spark.read.parquet(path).where("id > 3").selectExpr("id + 1 AS x")
    assert settle_computed(plain, "x") is plain
    grouped = plain.groupBy("x").count()
    assert settle_computed(grouped, "x") is not grouped
