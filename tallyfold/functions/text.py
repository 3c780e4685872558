"""Text expressions; a null text is "no" wherever a yes/no answer is asked."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes, so that trimming gives the same text.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def normalize_text(col: Column) -> Column:
    """Lower case, no leading or trailing white space of any kind."""
    return F.btrim(F.lower(col), F.lit(WHITESPACE))


def starts_with(col: Column, prefix: str) -> Column:
    return F.coalesce(col.startswith(prefix), F.lit(False))


def contains_all(col: Column, words: Sequence[str]) -> Column:
    """Case-insensitive test that every word occurs."""
    lowered = F.lower(col)
    return F.coalesce(reduce(and_, [lowered.contains(w.lower()) for w in words]), F.lit(False))


def excludes_all(col: Column, patterns: Sequence[str]) -> Column:
    """Case-sensitive test that no pattern occurs. Null stays null, so a filter drops it."""
    return reduce(and_, [~col.contains(p) for p in patterns])
