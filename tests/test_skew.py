"""A third of the rows in one key, with joins that cannot broadcast."""

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import keys
from tallyfold.operators import (
    dedup_keep_first, duplicate_groups, fill_group_mean, flag_iqr_outliers, with_group_size,
)

N = 30_000


@pytest.fixture
def no_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def hot(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 997)
    value = F.when(F.col("id") % 7 != 0, (F.col("id") % 100).cast("double"))
    return spark.range(0, N, 1, 6).select("id", key.alias("k"), value.alias("v"))


def plan_of(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[: text.index("== Initial Plan ==")]


def test_rows_of_a_hot_key_meet_their_group_in_a_broadcast(no_broadcast, hot, monkeypatch):
    assert "SortMergeJoin" not in plan_of(with_group_size(hot, "k"))
    monkeypatch.setattr(keys, "HOT_SHARE", 500)  # more groups than that: only those of hot keys are broadcast
    sized = with_group_size(hot, "k")
    assert "BroadcastHashJoin" in plan_of(sized) and "SortMergeJoin" in plan_of(sized)
    assert sized.filter("k = -1").agg(F.min("group_size"), F.count("*")).first()[:] == (N // 3, N // 3)


def test_results_are_whole(no_broadcast, hot):
    assert fill_group_mean(hot, "v", ["k"]).filter("v is null").count() == 0
    assert flag_iqr_outliers(hot, "k", "v").count() == N
    assert dedup_keep_first(hot, ["k"], "id").agg(F.count("*"), F.min("id")).first()[:] == (998, 0)
    assert duplicate_groups(hot, ["k"]).count() == N
