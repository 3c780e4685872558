import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyfold.operators import column_quantiles, exact_quantiles, group_median

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


@pytest.fixture(scope="module")
def mixed():
    """Wide range, both signs, decade borders, and a third of the rows equal to zero."""
    rng = np.random.default_rng(7)
    values = np.concatenate([
        rng.lognormal(0, 5, 2000), -rng.lognormal(0, 5, 1200), np.zeros(3000),
        rng.integers(0, 50, 1500).astype(float), 100 + rng.random(1500) * 1e-7,
        [9.99, 10.0, 99.999999, 100.0, 999.9999999, 1000.0, 0.1, 0.01, 1e-300, 1e300, -1.0, -10.0],
    ])
    keys = np.where(rng.random(len(values)) < 0.4, "hot", rng.choice(list("abc"), len(values)))
    return pd.DataFrame({"k": keys, "v": values})


def test_linear_matches_numpy(spark, mixed):
    got = exact_quantiles(spark.createDataFrame(mixed), "v", PROBS).toPandas().sort_values("p")
    np.testing.assert_allclose(got.q, np.quantile(mixed.v, PROBS), rtol=1e-12)


def test_groups_match_numpy(spark, mixed):
    df = spark.createDataFrame(mixed)
    linear = exact_quantiles(df, "v", PROBS, ["k"]).toPandas().set_index(["k", "p"]).q
    discrete = exact_quantiles(df, "v", PROBS, ["k"], "discrete").toPandas().set_index(["k", "p"]).q
    assert len(linear) == len(discrete) == 4 * len(PROBS)
    for key, part in mixed.groupby("k"):
        for p in PROBS:
            assert linear[key, p] == pytest.approx(np.quantile(part.v, p), rel=1e-12)
            assert discrete[key, p] == np.quantile(part.v, p, method="inverted_cdf")


def test_null_key_is_a_group_and_null_values_are_left_out(spark):
    df = spark.createDataFrame(
        [(None, 1.0), (None, 3.0), (None, None), ("a", 5.0), ("a", float("nan")), ("b", None)],
        "k string, v double",
    )
    got = {r.k: r.q for r in exact_quantiles(df, "v", [0.5], ["k"]).collect()}
    assert got == {None: 2.0, "a": 5.0}
    assert [tuple(r) for r in group_median(df, "k", "v").collect()] == [("a", 5.0)]


def test_empty_input_gives_no_rows(spark):
    assert exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0


def test_several_columns(spark):
    df = spark.createDataFrame([(float(i), i % 3) for i in range(100)], "a double, b int")
    got = {(r.column_name, r.p): r.q for r in column_quantiles(df, ["a", "b"], [0.5, 0.9], "discrete").collect()}
    assert got == {("a", 0.5): 49.0, ("a", 0.9): 89.0, ("b", 0.5): 1.0, ("b", 0.9): 2.0}


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        exact_quantiles(spark.createDataFrame([(1.0,)], "v double"), "v", [0.5], method="nearest")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=40))
def test_any_list(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.p: r.q for r in exact_quantiles(df, "v", [0.0, 0.3, 1.0], method="discrete").collect()}
    for p in got:
        assert got[p] == np.quantile(values, p, method="inverted_cdf")


def test_extreme_doubles(spark):
    values = [5e-324, -5e-324, 1e-310, 1.7976931348623157e308, float("inf"), float("-inf"), 0.0, -0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.1, 0.3, 0.6, 0.8, 0.9, 1.0]
    got = {r.p: r.q for r in exact_quantiles(df, "v", probs, method="discrete").collect()}
    assert got == {p: np.quantile(values, p, method="inverted_cdf") for p in probs}


def test_values_that_share_many_digits(spark):
    """Instants of one day in microseconds: the first digits say nothing."""
    rng = np.random.default_rng(5)
    values = (1.7e15 + rng.integers(0, 86_400_000_000, 5000)).astype(float)
    values[::3] = 0.0
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = {r.p: r.q for r in exact_quantiles(df, "v", PROBS, method="discrete").collect()}
    assert got == {p: np.quantile(values, p, method="inverted_cdf") for p in PROBS}
