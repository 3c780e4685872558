"""The list of queries: a Spark plan and, where SQL can say the same, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_scope
from .standins import Tables, expand_sql


@dataclass(frozen=True)
class Query:
    plan: Callable[[Tables], DataFrame]
    sql: str | None
    digits: Mapping[str, int]
    owned: bool = False


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, digits: Mapping[str, int] | None = None, owned: bool = False):
    """Registers a plan and its SQL twin.

    ``owned`` is for small results of plans that write intermediate tables: the result is written too, and
    the others are deleted before it is handed out.
    ``digits`` rounds columns of the result, on both sides: sums and means of doubles differ in their
    last bits with the order of the rows, within one engine too.
    """
    if sql is not None and digits:
        rounded = ", ".join(f'ROUND("{c}", {d}) AS "{c}"' for c, d in digits.items())
        sql = f"SELECT * REPLACE ({rounded}) FROM ({sql})"

    def add(plan: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(plan, None if sql is None else expand_sql(sql), digits or {}, owned)
        return plan

    return add


def same_rows(name: str, of: str):
    """Registers a second plan for the rows of another query."""
    def add(plan: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = replace(QUERIES[of], plan=plan)
        return plan

    return add


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = QUERIES[name]
    if asked.owned:
        with scratch_scope() as scope:
            found = scope.result(asked.plan(Tables(spark, sf_dir)), name)
    else:
        found = asked.plan(Tables(spark, sf_dir))
    found = plain_types(found)
    return found.withColumns({c: F.round(F.col(f"`{c}`"), d) for c, d in asked.digits.items()})


def plain_types(df: DataFrame) -> DataFrame:
    """Dates and times as text, decimals as double: the same in every client."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(field.name))
    return df.select(*out)


def ratio2(numerator: str, denominator: str) -> str:
    """SQL for a quotient of whole numbers rounded half up to two digits, without float error."""
    n, d = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    return f"(CAST((200 * {n} + {d}) // (2 * {d}) AS DOUBLE) / 100)"
