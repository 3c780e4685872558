import math
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest

from tallyfold.operators import binned, chi_square, contingency_table, cramers_v, phik_matrix
from tallyfold.operators.association import phik_from_chi2


@pytest.fixture(scope="module")
def people():
    rng = np.random.default_rng(3)
    a = rng.choice(["x", "y", "z"], 800)
    b = np.where(rng.random(800) < 0.6, a, rng.choice(["x", "y", "z"], 800))
    size = rng.normal(0, 1, 800) + (a == "x") * 1.5
    frame = pd.DataFrame({"a": a, "b": b, "size": size, "copy": a, "one": "same"})
    frame.loc[::10, "b"] = None
    return frame


def _chi2(table):
    table = table.to_numpy(float)
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    return ((table - expected) ** 2 / expected).sum()


def test_chi_square_matches_direct_computation(spark, people):
    df = spark.createDataFrame(people)
    got = chi_square(contingency_table(df, ["a", "b"])).first()
    table = pd.crosstab(people.a, people.b)
    assert got.n == int(table.to_numpy().sum()) == 720
    assert (got.n_left, got.n_right) == table.shape
    assert got.chi2 == pytest.approx(_chi2(table))


def test_cramers_v(spark, people):
    cells = contingency_table(spark.createDataFrame(people), ["a", "copy", "one"])
    got = {(r.left_column, r.right_column): r.cramers_v for r in cramers_v(cells).collect()}
    assert got["a", "copy"] == pytest.approx(1.0)
    assert got["a", "one"] is None


def test_interval_columns_get_equal_bins(spark, people):
    df = binned(spark.createDataFrame(people), ["a"], ["size"])
    counts = {int(r["size"]): r["count"] for r in df.groupBy("size").count().collect()}
    edges = np.linspace(people["size"].min(), people["size"].max(), 11)
    expected = np.histogram(people["size"], edges)[0]
    assert [counts.get(i, 0) for i in range(10)] == expected.tolist()


def _weight_on_a_grid(rho, nx, ny, n=1200):
    """The same sum from the two-dimensional density on a fine grid."""
    x = (np.arange(n) + 0.5) / n * 10 - 5
    density = np.exp(-(x[:, None] ** 2 - 2 * rho * x[:, None] * x + x**2) / (2 * (1 - rho**2)))
    density *= (10 / n) ** 2 / (2 * math.pi * math.sqrt(1 - rho**2))
    ix, iy = np.minimum((np.arange(n) * nx) // n, nx - 1), np.minimum((np.arange(n) * ny) // n, ny - 1)
    joint = np.zeros((nx, ny))
    np.add.at(joint, (ix[:, None], iy[None, :]), density)
    phi = lambda e: 0.5 * math.erfc(-e / math.sqrt(2))
    px = np.diff([phi(e) for e in np.linspace(-5, 5, nx + 1)])
    py = np.diff([phi(e) for e in np.linspace(-5, 5, ny + 1)])
    free = np.outer(px, py)
    return ((joint - free) ** 2 / free).sum()


@pytest.mark.parametrize("rho,nx,ny", [(0.3, 4, 4), (0.6, 3, 5), (0.8, 2, 6), (0.9, 4, 3)])
def test_cell_weight(rho, nx, ny):
    assert phik_from_chi2.cell_weight(rho, nx, ny) == pytest.approx(_weight_on_a_grid(rho, nx, ny), rel=2e-2)


def test_solution_inverts_the_weight():
    n, nx, ny = 5000, 4, 5
    noise, largest = 12, n * 3
    scale = (largest - noise) / (n * phik_from_chi2.cell_weight(1.0, nx, ny))
    for rho in (0.2, 0.5, 0.8):
        chi2 = noise + n * scale * phik_from_chi2.cell_weight(rho, nx, ny)
        assert phik_from_chi2(chi2, n, nx, ny) == pytest.approx(rho, abs=1e-5)
    assert phik_from_chi2(5.0, n, nx, ny) == 0.0
    assert phik_from_chi2(largest, n, nx, ny) == 1.0
    assert math.isnan(phik_from_chi2(5.0, n, 1, ny))


def test_matrix(spark, people):
    got = {
        (r.left_column, r.right_column): r.phik
        for r in phik_matrix(spark.createDataFrame(people), ["a", "b", "copy", "one"], ["size"]).collect()
    }
    assert len(got) == 20
    assert got["a", "copy"] == got["copy", "a"] == 1.0
    assert got["a", "one"] is None
    assert 0.5 < got["a", "b"] < 1.0 and 0.4 < got["a", "size"] < 1.0
    table = pd.crosstab(people.a, people.b)
    assert got["a", "b"] == pytest.approx(phik_from_chi2(_chi2(table), 720, 3, 3), abs=1e-9)


def test_columns_are_told_apart_by_type(spark, people):
    frame = people[["a", "size"]].assign(flag=people.a == "x")
    frame.loc[3, "size"] = float("nan")
    df = spark.createDataFrame(frame)
    guessed = {(r[0], r[1]): r[2] for r in phik_matrix(df).collect()}
    stated = {(r[0], r[1]): r[2] for r in phik_matrix(df, ["a", "flag"], ["size"]).collect()}
    assert guessed == stated and len(guessed) == 6 and guessed["a", "flag"] == 1.0
    cells = contingency_table(binned(df, ["a"], ["size"]), ["a", "size"])
    assert cells.agg({"n": "sum"}).first()[0] == len(frame) - 1


def test_columns_of_many_classes_are_answered(spark):
    df = spark.range(3000).selectExpr("cast(id % 1500 as string) AS name", "cast(id % 3 as string) AS kind", "cast(id as string) AS each")
    got = {(r.left_column, r.right_column): r.phik for r in phik_matrix(df, ["name", "kind", "each"]).collect()}
    assert got["name", "kind"] == pytest.approx(1) and got["each", "kind"] == pytest.approx(1) and 0 <= got["name", "each"] <= 1


@pytest.mark.parametrize("rho", [0.05, 0.5, 0.88, 0.95, 0.99])
def test_weights_of_many_classes(rho):
    """The series and the band against the sum over all cells; that one integrates by two nodes a class here."""
    weight = phik_from_chi2.weight_of(1001, 40)
    assert weight(rho) == pytest.approx(phik_from_chi2.cell_weight(rho, 1001, 40), rel=2e-3)
    assert weight(1.0) == pytest.approx(phik_from_chi2.cell_weight(1.0, 1001, 40), rel=1e-9)


def test_many_classes_are_solved_alike():
    """Finer integration agrees where the number of nodes changes with the number of classes."""
    few, many = (phik_from_chi2.cell_weight(0.5, n, 6) for n in (199, 201))
    assert few == pytest.approx(many, rel=2e-2)


def test_solver_travels_to_workers_without_the_package(tmp_path):
    """From another folder, where only the driver can import the package."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from tallyfold.session import local_session
from tallyfold.operators import phik_matrix
spark = local_session(cpus=2, shuffle_partitions=2)
df = spark.range(200).selectExpr("id % 3 AS a", "id % 6 AS b")
print("rows", phik_matrix(df, ["a", "b"], []).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 2" in done.stdout, done.stderr[-2000:]
