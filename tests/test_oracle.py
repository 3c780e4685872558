"""Every registered query with a SQL twin gives the twin's rows, types included."""

import oracle
import pytest

from tallyfold.plans import QUERIES, run


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = oracle.connect(sf_dir)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_matches_sql(name, spark, con, sf_dir):
    assert oracle.compare(name, spark, con, sf_dir) == []


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is None])
def test_gives_rows(name, spark, sf_dir):
    assert run(name, spark, sf_dir).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
