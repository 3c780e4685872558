"""Association between columns of mixed type.

The rows are only counted: into cells per pair of columns, and from the cells into one chi-square
per pair. What is left to solve is one number per pair, on a table with one row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import number
from .keys import with_row

# Bins of an interval column, and the range the normal is cut to.
INTERVAL_BINS = 10
NORMAL_RANGE = 5.0


def binned(
    df: DataFrame, nominal: Sequence[str], interval: Sequence[str], bins: int = INTERVAL_BINS
) -> DataFrame:
    """Every column as text: nominal values as they are, interval values as a bin number."""
    out = [F.col(c).cast("string").alias(c) for c in nominal]
    for c in interval:
        v, lo, hi = number(F.col(c)), F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        at = F.coalesce(F.least(F.floor(F.try_divide(v - lo, hi - lo) * bins), F.lit(bins - 1)), F.lit(0))
        out.append(F.when(v.isNotNull(), at).cast("string").alias(c))
    if not interval:
        return df.select(*out)
    ends = df.agg(
        *[F.min(number(F.col(c))).alias(f"__lo_{c}") for c in interval],
        *[F.max(number(F.col(c))).alias(f"__hi_{c}") for c in interval],
    )
    return with_row(df, ends).select(*out)


def contingency_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``(left_column, right_column, left_value, right_value, n)`` for every pair.

    Each task counts its own cells first, so the shuffle carries cells, never rows. A row counts
    for a pair only if both values are there.
    """
    pairs = F.array(*[
        F.struct(
            F.lit(a).alias("left_column"), F.lit(b).alias("right_column"),
            F.col(a).cast("string").alias("left_value"),
            F.col(b).cast("string").alias("right_value"),
        )
        for a, b in combinations(columns, 2)
    ])
    return (
        df.select(F.inline(pairs))
        .filter(F.col("left_value").isNotNull() & F.col("right_value").isNotNull())
        .groupBy("left_column", "right_column", "left_value", "right_value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def chi_square(cells: DataFrame) -> DataFrame:
    """One row per pair: ``n``, the numbers of classes and Pearson's chi-square."""
    pair = ["left_column", "right_column"]
    lefts = cells.groupBy(*pair, "left_value").agg(F.sum("n").alias("__left"))
    rights = cells.groupBy(*pair, "right_value").agg(F.sum("n").alias("__right"))
    part = F.col("n").cast("double") * F.col("n") / (F.col("__left").cast("double") * F.col("__right"))
    sizes = cells.groupBy(*pair).agg(F.sum("n").alias("n"))
    n_left = lefts.groupBy(*pair).agg(F.count(F.lit(1)).alias("n_left"))
    n_right = rights.groupBy(*pair).agg(F.count(F.lit(1)).alias("n_right"))
    weights = (
        cells.join(lefts, [*pair, "left_value"]).join(rights, [*pair, "right_value"])
        .groupBy(*pair).agg(F.sum(part).alias("__w"))
    )
    return (
        sizes.join(n_left, pair).join(n_right, pair).join(weights, pair)
        .withColumn("chi2", F.greatest(F.col("n") * (F.col("__w") - 1), F.lit(0.0)))
        .drop("__w")
    )


def cramers_v(cells: DataFrame) -> DataFrame:
    """Cramér's V per pair; null when a column has a single class."""
    smaller = F.least("n_left", "n_right") - 1
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * smaller))
    return chi_square(cells).select("left_column", "right_column", "n", v.alias("cramers_v"))


def phik(cells: DataFrame) -> DataFrame:
    """The φK coefficient per pair (Baak et al., arXiv:1811.11440).

    The correlation of a bivariate normal, cut into equally wide bins on [-5, 5], whose expected
    chi-square equals the one observed. The scale makes a correlation of one give the largest
    possible chi-square, and the degrees of freedom are taken off as noise. Columns may have any number of
    classes.
    """
    solver = phik_solver()

    @F.pandas_udf("double")
    def solve(chi2: pd.Series, n: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([solver(*row) for row in zip(chi2, n, left, right)], dtype=float)

    solved = F.when(F.least("n_left", "n_right") > 1, solve("chi2", "n", "n_left", "n_right"))
    return chi_square(cells).select("left_column", "right_column", solved.alias("phik"))


def phik_matrix(
    df: DataFrame, nominal: Sequence[str] | None = None, interval: Sequence[str] | None = None,
    bins: int = INTERVAL_BINS,
) -> DataFrame:
    """Rows ``(left_column, right_column, phik)`` in both directions.

    Without lists of columns, numbers are taken as interval and everything else as nominal.
    """
    if nominal is None and interval is None:
        interval = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
        nominal = [c for c in df.columns if c not in interval]
    nominal, interval = list(nominal or ()), list(interval or ())
    columns = [*nominal, *interval]
    one_way = phik(contingency_table(binned(df, nominal, interval, bins), columns))
    ways = F.array(
        F.struct("left_column", "right_column"),
        F.struct(F.col("right_column").alias("left_column"), F.col("left_column").alias("right_column")),
    )
    return one_way.select(F.inline(ways), "phik")


def association_row(matrix: DataFrame, column: str, value: str = "phik") -> DataFrame:
    """``(column_name, value)``: a matrix's row of one column, without itself, strongest first; ties by name."""
    others = matrix.filter((F.col("left_column") == column) & (F.col("right_column") != column))
    return others.select(F.col("right_column").alias("column_name"), value).orderBy(F.col(value).desc_nulls_last(), "column_name")


def phik_solver() -> Callable[[float, int, int, int], float]:
    """The function that solves for φK, whole in itself: it travels to executors that lack this package.

    The expected chi-square is summed over all cells of a small table. In one with more than 1000 classes it is a
    power series in the correlation (Mehler's, whose coefficients need one pass over the classes) up to 0.9, and above
    that a sum over the band of cells that the density reaches, the others being empty.
    """
    grid = np.linspace(-10, 10, 200_001)
    table = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in grid])
    reach, terms = NORMAL_RANGE, 150

    def cdf(x: np.ndarray) -> np.ndarray:
        return np.interp(x, grid, table)

    def cell_weight(rho: float, nx: int, ny: int) -> float:
        """Sum over cells of (probability at rho - at 0)^2 / probability at 0."""
        ex, ey = np.linspace(-reach, reach, nx + 1), np.linspace(-reach, reach, ny + 1)
        px, py = np.diff(cdf(ex)), np.diff(cdf(ey))
        # Narrow classes need few nodes; some classes at a time, so that memory stays bounded.
        cuts = max(1, math.ceil(200 / nx))
        nodes, weights = np.polynomial.legendre.leggauss(4 if nx < 200 else 2)
        width = 2 * reach / nx / cuts
        step = max(1, 2_000_000 // (cuts * len(nodes) * (ny + 1)))
        total = 0.0
        for start in range(0, nx, step):
            left = ex[start:min(start + step, nx)]
            if rho >= 1:
                lo = np.maximum(left[:, None], ey[:-1])
                hi = np.minimum(left[:, None] + 2 * reach / nx, ey[1:])
                joint = np.where(hi > lo, cdf(hi) - cdf(lo), 0.0)
            else:
                mid = left[:, None] + width * (np.arange(cuts) + 0.5)
                x = mid[:, :, None] + width / 2 * nodes
                dx = width / 2 * weights * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
                edges = (ey - rho * x[..., None]) / math.sqrt(1 - rho * rho)
                joint = np.einsum("icn,icny->iy", dx, np.diff(cdf(edges), axis=-1))
            free = np.maximum(px[start:start + len(left), None] * py, 1e-20)
            total += float((((joint - free) ** 2) / free).sum())
        return total

    def normalised(size: int) -> np.ndarray:
        """Products, over the classes, of the first Hermite integrals of each, divided by its probability."""
        gram = np.zeros((terms, terms))
        for start in range(0, size, 20_000):
            x = -reach + 2 * reach * np.arange(start, min(start + 20_000, size) + 1) / size
            d = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
            p = np.maximum(np.diff(cdf(x)), 1e-300)
            h, before, out = np.ones_like(x), np.zeros_like(x), np.empty((terms, len(p)))
            for k in range(1, terms + 1):
                out[k - 1] = -np.diff(h * d) / math.sqrt(k) / np.sqrt(p)
                h, before = (x * h - math.sqrt(k - 1) * before) / math.sqrt(k), h
            gram += out @ out.T
        return gram

    def band_weight(rho: float, nx: int, ny: int) -> float:
        """``cell_weight`` of many classes: rows in blocks, and of each block the columns within nine deviations."""
        ex, ey = np.linspace(-reach, reach, nx + 1), np.linspace(-reach, reach, ny + 1)
        px, py = np.diff(cdf(ex)), np.diff(cdf(ey))
        sigma, all_y, total = math.sqrt(max(0.0, 1 - rho * rho)), float(py.sum()), 0.0
        if not sigma:
            return cell_weight(rho, nx, ny)
        step = max(1, nx // 400)
        for start in range(0, nx, step):
            end = min(start + step, nx)
            near = rho * ex[start] - 9 * sigma, rho * ex[end] + 9 * sigma
            lo = max(0, int(np.searchsorted(ey, near[0])) - 1)
            hi = min(ny, int(np.searchsorted(ey, near[1])) + 1)
            for first in range(lo, hi, 100_000):
                last = min(first + 100_000, hi)
                for row in range(start, end, max(1, 2_000_000 // (last - first))):
                    rows = slice(row, min(row + max(1, 2_000_000 // (last - first)), end))
                    half, mid = np.diff(ex[:2])[0] / 2, (ex[rows] + ex[rows.start + 1: rows.stop + 1]) / 2
                    joint = 0.0
                    for node in (-1 / math.sqrt(3), 1 / math.sqrt(3)):
                        x = mid + half * node
                        edges = (ey[None, first:last + 1] - rho * x[:, None]) / sigma
                        joint = joint + (half * np.exp(-x * x / 2) / math.sqrt(2 * math.pi))[:, None] * np.diff(cdf(edges), axis=1)
                    free = np.maximum(px[rows, None] * py[first:last], 1e-300)
                    total += float((((joint - free) ** 2) / free).sum())
            total += float(px[start:end].sum()) * (all_y - float(py[lo:hi].sum()))
        return total

    def weight_of(nx: int, ny: int) -> Callable[[float], float]:
        if max(nx, ny) <= 1000:
            return lambda rho: cell_weight(rho, nx, ny)
        both = normalised(nx) * normalised(ny)

        def weight(rho: float) -> float:
            if rho > 0.9:
                return diagonal_weight(nx, ny) if rho >= 1 else band_weight(rho, nx, ny)
            powers = rho ** np.arange(1, terms + 1)
            return float(powers @ both @ powers)

        return weight

    def diagonal_weight(nx: int, ny: int) -> float:
        """``cell_weight`` at 1: only cells on the diagonal have a probability; the others give their own."""
        ex, ey = np.linspace(-reach, reach, nx + 1), np.linspace(-reach, reach, ny + 1)
        cuts = np.union1d(ex, ey)
        joint = np.diff(cdf(cuts))
        middle = (cuts[1:] + cuts[:-1]) / 2
        ix = np.clip(np.searchsorted(ex, middle) - 1, 0, nx - 1)
        iy = np.clip(np.searchsorted(ey, middle) - 1, 0, ny - 1)
        px, py = np.diff(cdf(ex)), np.diff(cdf(ey))
        cells, place = np.unique(ix.astype(np.int64) * ny + iy, return_inverse=True)
        joint = np.bincount(place, joint)
        free = np.maximum(px[cells // ny] * py[cells % ny], 1e-300)
        return float((((joint - free) ** 2) / free).sum() + px.sum() * py.sum() - free.sum())

    def solve(chi2: float, n: int, nx: int, ny: int, steps: int = 30) -> float:
        """Solves for the correlation by bisection."""
        if min(nx, ny) < 2:
            return math.nan
        noise = (nx - 1) * (ny - 1)
        largest = n * (min(nx, ny) - 1)
        if chi2 <= noise:
            return 0.0
        # The sum of many cells may miss the largest by rounding, and the weight is flat there.
        if chi2 >= largest * (1 - 1e-9):
            return 1.0
        nx, ny = int(nx), int(ny)
        weight = weight_of(nx, ny)
        scale = (largest - noise) / (n * weight(1.0))
        low, high = 0.0, 1.0
        for _ in range(steps):
            rho = (low + high) / 2
            if noise + n * scale * weight(rho) < chi2:
                low = rho
            else:
                high = rho
        return (low + high) / 2

    solve.cell_weight, solve.weight_of, solve.diagonal_weight = cell_weight, weight_of, diagonal_weight
    return solve


phik_from_chi2 = phik_solver()
