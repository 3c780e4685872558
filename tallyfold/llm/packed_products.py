"""Hard-negative mining with Kronecker-packed products.

Rows are dealt into groups of bounded bytes. A task holds one group of candidates: for every component, the
biased components of all candidates of a label lie side by side in one wide integer, in fields wide enough for a whole
inner product. An anchor's component is multiplied once with such an integer, and the sum over the components has every
candidate's score in its field, from which the biases are taken off. Anchors stream through each group, which returns its
best rows for each anchor; the best of all groups follow from a window that limits its groups before the shuffle.

Scores are exact. Rows without an id, label or vector, or with a null or non-finite component, take no part. Shorter
vectors count as ended by zeros. Rows of one id are one row, the least by label, then by components. Components and
scores beyond 64 bits are held at the ends of that range. Equal scores are ordered by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.operators.keys import join_on_keys
from tallyfold.session import settle

#: Bytes of the wide integers of one group, and candidates in one wide integer.
GROUP_BYTES = 32 << 20
FIELDS = 4096
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def usable(label: Column, vector: Column) -> Column:
    """Whether a row takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return label.isNotNull() & vector.isNotNull() & finite


def quantised(vector: Column, scale: int) -> Column:
    """Components as whole numbers: floor of scale times each, as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


class Packed:
    """Candidates of one label, at most FIELDS of them, in one wide integer for each component."""

    def __init__(self, ids: np.ndarray, parts: np.ndarray, most: int, width: int):
        self.ids, self.most, self.width = ids, most, width
        n, self.dims = parts.shape
        biased = (parts.astype(np.uint64) + np.uint64(most)).astype("<u8")
        self.wide = []
        for column in biased.T:
            fields = np.zeros((n, max(width, 8)), np.uint8)
            fields[:, :8] = np.ascontiguousarray(column).view(np.uint8).reshape(n, 8)
            self.wide.append(int.from_bytes(np.ascontiguousarray(fields[:, :width]).tobytes(), "little"))
        self.sums = [sum(row) for row in biased.tolist()] if width > 7 else biased.sum(axis=1).astype(np.int64)

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products with an anchor of as many components."""
        most, n = self.most, len(self.ids)
        total = sum((a + most) * wide for a, wide in zip(anchor, self.wide) if a + most)
        raw = total.to_bytes(n * self.width, "little")
        off = most * sum(anchor)
        if self.width <= 7:
            fields = np.zeros((n, 8), np.uint8)
            fields[:, :self.width] = np.frombuffer(raw, np.uint8).reshape(n, self.width)
            return fields.view("<i8")[:, 0] - off - most * self.sums
        w = self.width
        exact = [int.from_bytes(raw[i * w: i * w + w], "little") - off - most * self.sums[i] for i in range(n)]
        return np.array([min(max(s, LOWEST), HIGHEST) for s in exact], np.int64)


def field_width(most: int, dims: int) -> int:
    """Bytes that hold any sum of ``dims`` products of two biased components."""
    return max(1, -(-(dims * (2 * most) * (2 * most)).bit_length() // 8))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows, ended by zeros."""
    out = np.zeros((len(column), dims), np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(column)), sizes)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, places] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first k by score, then id; ``ids`` ascend."""
    if len(ids) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        ids, scores = ids[near], scores[near]
    order = np.argsort(~scores, kind="stable")[:k]
    return [(int(ids[i]), int(scores[i])) for i in order]


def _positives(blocks: dict, anchor: tuple, k: int) -> Iterator[tuple]:
    key, label, parts, _ = anchor
    found = []
    for block in blocks.get(label, []):
        scores, other = block.scores(parts), block.ids != key
        found += _best(block.ids[other], scores[other], k)
    for i, s in sorted(found, key=lambda x: (-x[1], x[0]))[:k]:
        yield key, 0, 0, i, s


def _negatives(blocks: dict, anchor: tuple, k: int, low: int, high: int) -> Iterator[tuple]:
    key, label, parts, positives = anchor
    own = [b for other, found in blocks.items() if other != label for b in found]
    if not own or not positives:
        return
    ids = np.concatenate([b.ids for b in own])
    scores = np.concatenate([b.scores(parts) for b in own])
    order = np.lexsort((ids, scores))
    ids, scores = ids[order], scores[order]
    for p, s in positives:
        # low * s <= 100 * score <= high * s
        least, most = -(-low * s // 100), high * s // 100
        if least > most:
            continue
        start = int(np.searchsorted(scores, max(least, LOWEST), "left")) if least <= HIGHEST else len(scores)
        end = int(np.searchsorted(scores, min(most, HIGHEST), "right")) if most >= LOWEST else 0
        if end <= start:
            continue
        # All rows with the score of the k-th from the top, so that ties go by id.
        first = max(start, int(np.searchsorted(scores, scores[max(start, end - k)], "left")))
        for under, i in sorted(zip((~scores[first:end]).tolist(), ids[first:end].tolist()))[:k]:
            yield key, p, s, i, ~under


def _through_groups(score: Callable, most: int, dims: int) -> Callable:
    """The task: candidates come first and are packed by label, then anchors meet them."""
    width = field_width(most, dims)

    def blocks_of(held: list) -> dict:
        if not held:
            return {}
        ids, labels = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        parts = np.concatenate([x[2] for x in held])
        order = np.lexsort((ids, labels))
        ids, labels, parts = ids[order], labels[order], parts[order]
        out: dict[int, list[Packed]] = {}
        for label in np.unique(labels).tolist():
            mine = np.flatnonzero(labels == label)
            for at in range(0, len(mine), FIELDS):
                part = mine[at: at + FIELDS]
                out.setdefault(label, []).append(Packed(ids[part], parts[part], most, width))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blocks, group = [], None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            groups, kinds = table["g"].to_numpy(), table["kind"].to_numpy()
            # A partition can hold several groups, one after the other.
            cuts = np.flatnonzero((np.diff(groups) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(groups)]):
                if end == start:
                    continue
                part = batch.slice(start, end - start)
                if groups[start] != group:
                    held, blocks, group = [], None, groups[start]
                keys, labels = part.column("k").to_numpy(), part.column("label").to_numpy()
                matrix = _matrix(part.column("c"), dims)
                if kinds[start] == 0:
                    held.append((keys, labels, matrix))
                    continue
                if blocks is None:
                    blocks, held = blocks_of(held), []
                positives = part.column("pos").to_pylist()
                rows = []
                for key, label, parts, pos in zip(keys.tolist(), labels.tolist(), matrix.tolist(), positives):
                    rows += score(blocks, (key, label, parts, [(x["k"], x["s"]) for x in pos or []]))
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k", "p", "ps", "i", "s"])

    return run


def _met(candidates: DataFrame, anchors: DataFrame, score: Callable, groups: int, most: int, dims: int) -> DataFrame:
    """Rows ``k, p, ps, i, s`` that each group returns for each anchor."""
    group = F.pmod(F.xxhash64("k"), F.lit(groups)).cast("int")
    dealt = candidates.select(group.alias("g"), F.lit(0).alias("kind"), "k", "label", "c", F.lit(None).cast("array<struct<k: long, s: long>>").alias("pos"))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    sent = anchors.select(every, F.lit(1).alias("kind"), "k", "label", "c", "pos")
    laid = dealt.union(sent).repartitionById(groups, "g").sortWithinPartitions("g", "kind")
    return laid.mapInArrow(_through_groups(score, most, dims), "k long, p long, ps long, i long, s long")


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    key: str = "vec_id", label: str = "label", parts: str = "parts",
) -> DataFrame:
    """For each anchor and each of its first ``positives`` other rows of its label: the first ``negatives`` rows of another
    label whose score is from ``low`` to ``high`` percent of the positive's.

    ``rows`` has whole-number components in ``parts``; ``anchors`` is a condition on the key column.
    """
    plain = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(parts).isNotNull())
    held = F.transform(parts, lambda x: F.greatest(x, F.lit(LOWEST + 1)))
    plain = plain.select(F.col(key).cast("long").alias("k"), F.struct(F.col(label).cast("long").alias("label"), held.alias("c")).alias("v"), anchors.alias("a"))
    one = plain.groupBy("k").agg(F.min("v").alias("v"), F.max("a").alias("a"))
    table = settle(one.select("k", "v.label", "v.c", "a"), "negatives-rows")
    largest = F.greatest(F.max(F.array_max("c")), -F.min(F.array_min("c")))
    n, most, dims = table.agg(F.count(F.lit(1)), largest, F.max(F.size("c"))).first()
    most, dims = max(int(most or 0), 1), max(int(dims or 0), 1)
    per_group = max(1, GROUP_BYTES // (dims * field_width(most, dims)))
    groups = max(1, -(-n // per_group), rows.sparkSession.sparkContext.defaultParallelism)
    candidates = table.select("k", "label", "c")
    chosen = table.where("a").select("k", "label", "c")
    unasked = chosen.withColumn("pos", F.lit(None).cast("array<struct<k: long, s: long>>"))
    near = _met(candidates, unasked, lambda b, a: _positives(b, a, positives), groups, most, dims)
    first = near.withColumn("rank", F.row_number().over(W.partitionBy("k").orderBy(F.desc("s"), "i"))).where(F.col("rank") <= positives)
    found = first.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("rank", "i", "s"))).alias("pos"))
    found = settle(found.select("k", F.transform("pos", lambda x: F.struct(x["i"].alias("k"), x["s"].alias("s"))).alias("pos")), "negatives-positives")

    asked = join_on_keys(chosen, found, ["k"]).select("k", "label", "c", "pos")
    far = _met(candidates, asked, lambda b, a: _negatives(b, a, negatives, low, high), groups, most, dims)
    ranked = far.withColumn("rank", F.row_number().over(W.partitionBy("k", "p").orderBy(F.desc("s"), "i"))).where(F.col("rank") <= negatives)
    return ranked.select(
        F.col("k").alias("anchor_id"), F.col("p").alias("positive_id"), "rank", F.col("i").alias("negative_id"),
        F.col("ps").alias("positive_score"), F.col("s").alias("negative_score"))
