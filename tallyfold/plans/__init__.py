from . import aggregates, analysis, basics, cleaning, metrics, scalars  # noqa: F401
from .registry import QUERIES, Query, run

__all__ = ["QUERIES", "Query", "run"]
