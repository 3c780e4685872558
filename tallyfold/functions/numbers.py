"""Numeric expressions.

Sums and means are of the values as they are; nothing is rounded before it is added. Amounts of money are
added as doubles per key first; ``exact_amount`` turns such a sum into a decimal, so that what is added from
then on, and the rounding of the result, is exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(col: Column) -> Column:
    """As double, with "not a number" as a gap."""
    value = col.cast("double")
    return F.when(~F.isnan(value), value)


def total(col: Column) -> Column:
    """Sum as double, gaps and "not a number" left out."""
    return F.sum(number(col))


def mean(col: Column) -> Column:
    """Mean as double, gaps and "not a number" left out."""
    return F.avg(number(col))


def exact_amount(col: Column, scale: int = 6) -> Column:
    """A sum of amounts as decimal with ``scale`` digits after the point: the last bits of a double, which
    depend on the order of the rows, are rounded away. More digits are no error; the scale is the caller's."""
    return col.try_cast(f"decimal(38,{scale})")


def round_half_up(col: Column, digits: int) -> Column:
    """Round half away from zero in decimal, as an SQL numeric does, then back to double."""
    return F.round(col.cast("decimal(38,12)"), digits).cast("double")


def ratio(numerator: Column, denominator: Column, digits: int | None = None) -> Column:
    """Quotient of two counts or sums; null when the denominator is zero."""
    if digits is None:
        return F.try_divide(numerator.cast("double"), denominator.cast("double"))
    exact = F.try_divide(numerator.cast("decimal(20,4)"), denominator.cast("decimal(20,0)"))
    return F.round(exact, digits).cast("double")


def safe_ratio(numerator: Column, denominator: Column, epsilon: float | None = None) -> Column:
    """Null on a zero denominator, or, with ``epsilon``, the denominator shifted by it."""
    if epsilon is None:
        return F.try_divide(numerator, denominator)
    return numerator / (denominator + F.lit(epsilon))


def zero_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(0))


def strip_separators(col: Column, separator: str = ",") -> Column:
    return F.replace(col, F.lit(separator), F.lit(""))


def parse_number(col: Column) -> Column:
    """Text to double; anything that is not a number gives null.

    Java's parser also reads a type letter ("1d", "2f"), which is no number here.
    """
    parsed = F.when(~col.rlike(r"(?i)[0-9.][df]\s*$"), col).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def _narrow(col: Column, bits: int, name: str) -> Column:
    top = 1 << (bits - 1)
    fits = col.isNull() | (col.between(-top, top - 1) & (col == F.floor(col)))
    return F.when(fits, col.cast(name)).otherwise(F.raise_error(F.lit(f"a value does not fit {name}")))


def narrow_to_short(col: Column) -> Column:
    """Cast to 16 bit; a fraction or a value out of range fails instead of being changed."""
    return _narrow(col, 16, "short")


def narrow_to_byte(col: Column) -> Column:
    return _narrow(col, 8, "byte")
