"""Shards of near equal bytes by a k-d tree over text metadata. Native.

Space is split again and again at a weighted median of the widest dimension until each leaf holds
its share of the bytes. The dimensions are bytes, characters by byte (which tells scripts apart), words, lines and the
share of capitals. All are computed from the text alone, so equal texts are one point and always share a shard. Texts
of equal metadata can make the median of one dimension lopsided; the split then goes to the widest dimension whose
median is even enough. Only where none is, a checksum of the text tells equal metadata apart.

Medians are exact: bytes are counted by the leading digits of the value, then by the next digits
inside the digit that holds the median. Only these counts, at most ``nodes x dimensions x 1024``
rows, reach the driver. Null texts count as empty. Repeated rows are rows of their own. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.operators.keys import join_on_keys
from tallyfold.session import settle

#: Dimensions are whole numbers of 30 bits, read in three digits of ten.
DIMENSIONS = ("d_bytes", "d_density", "d_words", "d_lines", "d_capitals", "d_checksum")
#: The dimension that only breaks ties.
TIES = len(DIMENSIONS) - 1
DIGIT, DIGITS = 10, 3
#: A split is even enough when it misses its goal by this share of the node.
EVEN = 0.005
#: Rows are numbered within cells of about so many.
CELL_ROWS = 2_000


@dataclass
class Node:
    """A part of space that becomes ``leaves`` shards, the first of them ``first``."""

    first: int
    leaves: int
    inside: Column
    weight: int = 0


def with_dimensions(docs: DataFrame) -> DataFrame:
    """Adds bytes, checksum and the dimensions of ``text``, and drops it."""
    t = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(t).cast("long") + 1
    top = F.lit((1 << DIGIT * DIGITS) - 1)
    count = lambda marks: (F.char_length(t) - F.char_length(F.translate(t, marks, ""))).cast("double")
    scaled = lambda c, factor: F.least(top, F.floor(c * factor)).cast("long")
    return docs.select(
        "k", F.monotonically_increasing_id().alias("u"), size.alias("size"), F.crc32(t).alias("crc"), F.xxhash64(t).alias("h"),
        F.least(top, F.floor(F.log2(size.cast("double")) * (1 << 24))).cast("long").alias("d_bytes"),
        F.least(top, F.floor((F.char_length(t) + 1) / size * (1 << 29))).cast("long").alias("d_density"),
        scaled(F.log2(1 + count(" \t\n\r")), 1 << 24).alias("d_words"), scaled(F.log2(1 + count("\n")), 1 << 24).alias("d_lines"),
        scaled(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, 1 << 29).alias("d_capitals"),
        F.shiftright(F.crc32(t), 2).cast("long").alias("d_checksum"),
    )


def _tables(points: DataFrame, nodes: list[Node]) -> DataFrame:
    """Points of the nodes with their node's number, one row for each dimension."""
    number = F.lit(None).cast("int")
    for i, node in enumerate(nodes):
        number = F.when(node.inside, F.lit(i)).otherwise(number)
    stacked = ", ".join(f"{i}, {d}" for i, d in enumerate(DIMENSIONS))
    rows = points.select(number.alias("node"), "weight", *DIMENSIONS).where("node IS NOT NULL")
    return rows.select("node", "weight", F.expr(f"stack({len(DIMENSIONS)}, {stacked}) AS (dim, value)"))


def _medians(points: DataFrame, nodes: list[Node]) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """For each node and dimension: split value, weight up to it, least and greatest value.

    The split value is the one at which the weight of values up to it comes nearest to the goal.
    """
    rows = _tables(points, nodes)
    whole = {r.node: r for r in rows.where("dim = 0").groupBy("node").agg(F.sum("weight").alias("w")).collect()}
    for i, node in enumerate(nodes):
        node.weight = whole[i].w if i in whole else 0
    goal = {i: n.weight * (n.leaves // 2) / n.leaves for i, n in enumerate(nodes)}
    ends = {(r.node, r.dim): (r.lo, r.hi) for r in rows.groupBy("node", "dim").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}
    # In each step the digit that the goal falls into, and the weight before it.
    prefix = {key: 0 for key in ends}
    before = {key: 0 for key in ends}
    found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for step in range(DIGITS):
        shift = DIGIT * (DIGITS - 1 - step)
        digit = F.shiftright("value", shift)
        part = rows
        if step:
            held = F.lit(False)
            for (node, dim), p in prefix.items():
                held = held | ((F.col("node") == node) & (F.col("dim") == dim) & (F.shiftright("value", shift + DIGIT) == p))
            part = rows.where(held)
        counts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in part.groupBy("node", "dim", digit.alias("digit")).agg(F.sum("weight").alias("w")).collect():
            counts.setdefault((r.node, r.dim), []).append((r.digit, r.w))
        for key, cells in counts.items():
            total = before[key]
            for value, w in sorted(cells):
                # Up to the end of this digit the weight is total + w: a possible split.
                miss = abs(total + w - goal[key[0]])
                edge = ((value + 1) << shift) - 1
                if key not in best or miss < best[key][0]:
                    best[key] = (miss, edge, total + w)
                if total + w >= goal[key[0]]:
                    prefix[key], before[key] = value, total
                    break
                total += w
    for key, (_, edge, up_to) in best.items():
        found[key] = (edge, up_to, *ends[key])
    return found


def grow_tree(points: DataFrame, shards: int) -> Column:
    """The shard of a row as an expression of its dimensions; ``points`` has ``weight`` too."""
    nodes = [Node(0, shards, F.lit(True))]
    leaves: list[Node] = []
    spans: dict[int, int] = {}
    while nodes:
        open_nodes = [n for n in nodes if n.leaves > 1]
        leaves += [n for n in nodes if n.leaves == 1]
        if not open_nodes:
            break
        medians = _medians(points, open_nodes)
        if not spans:
            spans = {d: max(1, medians[0, d][3] - medians[0, d][2]) for d in range(len(DIMENSIONS)) if (0, d) in medians}
        nodes = []
        for i, node in enumerate(open_nodes):
            few = node.leaves // 2
            options = []
            for d in range(len(DIMENSIONS)):
                if (i, d) in medians:
                    edge, up_to, low, high = medians[i, d]
                    miss = abs(up_to - node.weight * few / node.leaves) / max(1, node.weight)
                    options.append((2, miss, d, edge) if miss > EVEN else (int(d == TIES), -(high - low) / spans[d], d, edge))
            _, _, d, edge = min(options, default=(0, 0, 0, 0))
            side = F.col(DIMENSIONS[d]) <= F.lit(edge)
            nodes.append(Node(node.first, few, node.inside & side))
            nodes.append(Node(node.first + few, node.leaves - few, node.inside & ~side))
    shard = F.lit(None).cast("int")
    for leaf in leaves:
        shard = F.when(leaf.inside, F.lit(leaf.first)).otherwise(shard)
    return shard


def shard_documents(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Key, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of every row.

    Give the number of shards, or the bytes that each should reach. Slots count from 0 in each shard
    without gaps; they follow cells of rows, so that no shard is numbered by one task.
    """
    docs = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    rows = settle(with_dimensions(docs), "shard-rows")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w")).first()
    if shards is None:
        shards = max(1, -(-(totals.w or 0) // target_bytes))
    points = settle(rows.groupBy("crc", "h", *DIMENSIONS).agg(F.sum("size").alias("weight")), "shard-points")
    shard = grow_tree(points, shards) if totals.n else F.lit(0)
    cells = max(1, -(-totals.n // (shards * CELL_ROWS)))
    placed = rows.select("k", "u", "size", "crc", shard.alias("shard"), F.pmod(F.xxhash64("u"), F.lit(cells)).alias("cell"))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    starts = settle(counts.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("start")), "shard-cells")
    place = F.row_number().over(W.partitionBy("shard", "cell").orderBy("u")) - 1
    numbered = join_on_keys(placed.withColumn("place", place), starts, ["shard", "cell"])
    return numbered.select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
