"""Labels from values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_by_rules(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The label of the first rule that holds."""
    condition, label = rules[0]
    out = F.when(condition, F.lit(label))
    for condition, label in rules[1:]:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(default))


def three_bands(col: Column, low: float, high: float, labels: Sequence[str]) -> Column:
    """``labels[0]`` below ``low``, ``labels[2]`` above ``high``, ``labels[1]`` in between.

    Both limits belong to the middle band. Null stays null.
    """
    return (
        F.when(col < low, F.lit(labels[0]))
        .when(col > high, F.lit(labels[2]))
        .when(col.isNotNull(), F.lit(labels[1]))
    )


def bin_half_open(
    col: Column, edges: Sequence[float], labels: Sequence[str], include_top: bool = False
) -> Column:
    """Bins ``[edge, next edge)``. Outside all bins, the top edge included, is null.

    ``include_top`` closes the last bin, for rules stated as "up to and including".
    """
    last = len(labels) - 1
    rules = []
    for i, label in enumerate(labels):
        below = (col <= edges[i + 1]) if include_top and i == last else (col < edges[i + 1])
        rules.append(((col >= edges[i]) & below, label))
    return label_by_rules(rules)


# The upper ages of the bands (inclusive) and their labels.
AGE_BANDS = ((25, "18–25 лет"), (35, "26–35 лет"), (45, "36–45 лет"), (55, "46–55 лет"))
AGE_TOO_YOUNG, AGE_OLDEST, AGE_UNKNOWN = "Error", "Старше 55", "No info"


def age_band(age: Column) -> Column:
    rules = [(age < 18, AGE_TOO_YOUNG)]
    rules += [(age <= upper, label) for upper, label in AGE_BANDS]
    rules.append((age > AGE_BANDS[-1][0], AGE_OLDEST))
    return label_by_rules(rules, AGE_UNKNOWN)


def ordinal_lookup(col: Column, ranks: Mapping[str, int], default: int) -> Column:
    """A fixed name -> number table; anything else, null too, is ``default``."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(ranks.items())])
    return F.coalesce(F.try_element_at(table, col), F.lit(default))
