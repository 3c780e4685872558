"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.keys import join_on_keys
from tallyfold.session import scratch_scope, settle


def _large_star(pairs: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the node's smallest neighbour."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    tied = join_on_keys(both, least, ["a"]).where("b > a")
    return tied.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Ties a node (``a``) and its smaller neighbours (``b``) to the smallest of them."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    tied = join_on_keys(pairs, least, ["a"])
    return tied.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node with a link to another.

    ``links`` has two columns of whole numbers; direction, copies and self links do not matter. Each round
    is written to the shared scratch folder, and deleted at the end; the number of rounds grows with the logarithm of the
    longest path. Hot nodes are aggregated before the shuffle, and their joins can be split.
    """
    a, b = links.columns
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    with scratch_scope() as scope:
        pairs = settle(links.distinct(), "links")
        state = None
        while True:
            pairs = settle(_small_star(_large_star(pairs)), "components")
            found = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if found == state:
                return scope.result(pairs.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
            state = found
