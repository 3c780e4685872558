"""Runs registered queries on Spark and their SQL twins on DuckDB, and compares the rows."""

from __future__ import annotations

import math

import duckdb

from tallyfold.plans import QUERIES, run
from tallyfold.sources import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _rows(table, columns):
    data = [table.column(c).to_pylist() for c in columns]
    return sorted((tuple(_plain(v) for v in row) for row in zip(*data)), key=repr)


def compare(name: str, spark, con, sf_dir: str) -> list[str]:
    """Differences between the two answers; empty when they agree to the last bit."""
    got = run(name, spark, sf_dir).toArrow()
    want = con.sql(QUERIES[name].sql).to_arrow_table()
    problems = []
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {got.column_names} against {want.column_names}"]
    columns = sorted(got.column_names)
    for c in columns:
        a, b = str(got.schema.field(c).type), str(want.schema.field(c).type)
        if a.replace("large_", "") != b.replace("large_", ""):
            problems.append(f"type of {c}: {a} against {b}")
    left, right = _rows(got, columns), _rows(want, columns)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} against {len(right)}")
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, first {wrong[0][0]} against {wrong[0][1]}")
    if not right:
        problems.append("no rows")
    return problems
