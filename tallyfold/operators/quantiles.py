"""Exact quantiles from one table of counted values, never with a group in one buffer.

Spark's own ``percentile`` keeps every distinct value of a group in one buffer. Here the values are
counted once, with partial counts before the only shuffle, and the counts are written: an exact
histogram that all groups, ranks and columns read, and to which the counts of new rows can be added
(``count_values``, ``merge_counts``). The rows are scanned once.

A histogram of up to ``FEW`` distinct values is walked by a running count in one step. In a larger one
a wanted rank is located in steps: among the cells of values that share sign, magnitude and four
leading digits, by a running count over cells; inside that cell, among cells of ten digits; and
last among the values of that cell. However the values lie, a step then orders no more than some
millions of rows per group, because a double has seventeen digits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import settle
from .keys import join_on_keys

COARSE, FINE = 4, 10
#: Counted values that one running count may walk.
FEW = 1 << 20
_ALL = "__all"


def _cell(digits: int) -> str:
    """A whole number that never falls as the value grows; zero has a cell of its own.

    The magnitude is shifted to be positive and carries the sign; the limits keep the smallest
    doubles and infinity in the outermost cells. The result is declared never null, which keeps
    the planner from adding a filter of its own to each use.
    """
    magnitude = "greatest(least(floor(log10(abs(__v))), 309), -290)"
    leading = f"__v / pow(10D, {magnitude} - {digits - 1})"
    leading = f"floor(greatest(least({leading}, 1E{digits}D), -1E{digits}D))"
    shifted = f"cast(signum(__v) as bigint) * ({magnitude} + 400) * {10 ** (digits + 1)}L"
    return f"coalesce(CASE WHEN __v <> 0 THEN {shifted} + {leading} END, 0L)"


def _wanted_ranks(probs: Sequence[float], method: str) -> list[tuple[str, str]]:
    """(rank, struct of p, rank, upper and weight) of the order statistics of each quantile."""
    wanted = []
    for p in probs:
        at = f"cast('{float(p)!r}' as double)"
        if method == "discrete":
            parts = [(f"greatest(1L, ceil({at} * __total))", "false", "0D")]
        else:
            position = f"({at} * (__total - 1))"
            weight = f"{position} - floor({position})"
            parts = [(f"floor({position}) + 1", "false", weight),
                     (f"ceil({position}) + 1", "true", weight)]
        wanted += [
            (rank, f"named_struct('p', {at}, 'rank', {rank}, 'upper', {upper}, 'weight', {weight})")
            for rank, upper, weight in parts
        ]
    return wanted


def _holds(rank: str) -> str:
    return f"({rank} > __upto - __n AND {rank} <= __upto)"


def _running(order: str, keys: Sequence[str]) -> str:
    by = ", ".join(f"`{k}`" for k in keys)
    return (f"sum(__n) OVER (PARTITION BY {by} ORDER BY {order} "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def _group_columns(keys: Sequence[str]) -> list[str]:
    return list(keys) or [_ALL]


def count_values(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*keys, __v, __n)``: how often each value occurs in each group. Nulls are left out; null
    keys form a group."""
    columns = [F.col(k) for k in keys] or [F.lit(1).alias(_ALL)]
    rows = (
        df.select(*columns, F.col(value).cast("double").alias("__v"))
        .filter("__v IS NOT NULL AND NOT isnan(__v)")
    )
    return rows.groupBy(*_group_columns(keys), "__v").agg(F.count(F.lit(1)).alias("__n"))


def merge_counts(counts: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """The counts of several tables, such as one a day, as if all rows had been counted together."""
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    return every.groupBy(*_group_columns(keys), "__v").agg(F.sum("__n").alias("__n"))


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (),
    method: str = "linear", few_keys: bool = False,
) -> DataFrame:
    """Rows ``(*keys, p, q)`` with the exact quantile of ``value`` in each group.

    ``method``: "linear" interpolates between neighbours, "discrete" takes the first value whose
    share of rows reaches ``p``. Nulls are left out; null keys form a group. ``few_keys`` states
    that the caller's arguments bound the number of groups, which lets small sides be broadcast.
    """
    return Histogram(count_values(df, value, keys), keys, few_keys).quantiles(probs, method)


class Histogram:
    """Counted values of each group, written once; every quantile and size is read from them."""

    def __init__(self, counts: DataFrame, keys: Sequence[str] = (), few_keys: bool = False):
        """``counts`` as from ``count_values``, which runs here; ``few_keys`` as in ``exact_quantiles``."""
        size = Observation()
        self.counts = settle(counts.observe(size, F.count(F.lit(1)).alias("n")), "quantile-counts")
        self.keys, self._few, self._n = list(keys), few_keys or not keys, size.get["n"]

    def sizes(self, name: str) -> DataFrame:
        """``(*keys, name)``: how many values each group has."""
        return self.counts.groupBy(*_group_columns(self.keys)).agg(F.sum("__n").alias(name)).select(*self.keys, name)

    def quantiles(self, probs: Sequence[float], method: str = "linear") -> DataFrame:
        """Rows ``(*keys, p, q)``."""
        if method not in ("linear", "discrete"):
            raise ValueError(f"unknown method {method!r}")
        wanted = _wanted_ranks(probs, method)
        if self._n <= FEW:
            found = _walked(self.counts, wanted, self.keys)
        else:
            found = _located(self.counts, wanted, self.keys, self._few)
        found = found.groupBy(*_group_columns(self.keys), "p").agg(
            F.expr("max(CASE WHEN NOT upper THEN __v END) AS __lo"),
            F.expr("max(CASE WHEN upper THEN __v END) AS __hi"),
            F.expr("max(weight) AS __weight"))
        by = [f"`{k}`" for k in self.keys]
        return found.selectExpr(*by, "p", "coalesce(__lo + (__hi - __lo) * __weight, __lo) AS q")


def _at_ranks(counted: DataFrame, order: str, wanted, keys: Sequence[str], *kept: str) -> DataFrame:
    """Rows of a table of counts that hold a wanted rank, one for each; ``__before`` counts what lies before."""
    groups = _group_columns(keys)
    by = [f"`{k}`" for k in groups]
    chosen = ", ".join(f"CASE WHEN {_holds(rank)} THEN {it} END" for rank, it in wanted)
    return (
        counted.selectExpr(
            *by, *kept, "__n", f"{_running(order, groups)} AS __upto",
            f"sum(__n) OVER (PARTITION BY {', '.join(by)}) AS __total",
        )
        .filter(" OR ".join(_holds(rank) for rank, _ in wanted))
        .selectExpr(*by, *kept, "__upto - __n AS __before", f"inline(array_compact(array({chosen})))")
    )


def _walked(counts: DataFrame, wanted, keys: Sequence[str]) -> DataFrame:
    """The value at each wanted rank, by one running count."""
    return _at_ranks(counts, "__v", wanted, keys, "__v")


def _located(counts: DataFrame, wanted, keys: Sequence[str], few: bool) -> DataFrame:
    """The value at each wanted rank, by cells of four digits, of ten digits, and values."""
    groups = _group_columns(keys)
    by = [f"`{k}`" for k in groups]
    coarse = counts.selectExpr(*by, "__v", "__n", f"{_cell(COARSE)} AS __cell")
    fine = counts.selectExpr(*by, "__v", "__n", f"{_cell(FINE)} AS __cell")

    def in_located(values: DataFrame, cells: DataFrame) -> DataFrame:
        # Written first, a row for each group and rank: its size is known and it travels to the values.
        cells = settle(cells, "quantile-cells")
        return join_on_keys(values, cells, groups, never_null=["__cell"], small_right=few)

    cells = coarse.groupBy(*groups, "__cell").agg(F.sum("__n").alias("__n"))
    located = _at_ranks(cells, "__cell", wanted, keys, "__cell")
    # Inside each, the cell of ten digits; then, inside that, the value itself.
    target = [*by, "p", "upper", "rank", "weight", "__before"]
    along = [*groups, "p", "upper"]
    closer = (
        in_located(coarse, located)
        .selectExpr(*target, "__n", f"{_cell(FINE)} AS __cell")
        .groupBy(*groups, *target[len(by):], "__cell").agg(F.sum("__n").alias("__n"))
        .selectExpr(*target, "__cell", "__n",
                    f"__before + {_running('__cell', along)} AS __upto")
        .filter(_holds("rank"))
        .selectExpr(*target[:-1], "__cell", "__upto - __n AS __before")
    )
    return (
        in_located(fine, closer)
        .selectExpr(*target[:-1], "__v", "__n", f"__before + {_running('__v', along)} AS __upto")
        .filter(_holds("rank"))
    )


def quantile_columns(
    quantiles: DataFrame, names: Mapping[float, str], keys: Sequence[str] = ()
) -> DataFrame:
    """``(*keys, p, q)`` rows turned into one column per quantile."""
    return quantiles.groupBy(*keys).agg(
        *[F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(n) for p, n in names.items()]
    )


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], method: str = "linear"
) -> DataFrame:
    """Rows ``(column_name, p, q)`` for several columns from one pass over the table, whose
    values are counted in one table."""
    numbers = df.select([F.col(c).cast("double").alias(c) for c in columns])
    long = numbers.unpivot([], list(columns), "column_name", "__value")
    return exact_quantiles(long, "__value", probs, ["column_name"], method, few_keys=True)


def group_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """Median per group; rows without a key are left out."""
    rows = df.filter(F.col(key).isNotNull())
    found = exact_quantiles(rows, value, [0.5], [key])
    return found.select(key, F.col("q").alias("median"))
