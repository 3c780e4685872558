"""Near-duplicate vectors by an inverted multi-index.

Each half of the unit vectors has a codebook of its own, learned from a bounded sample; the pairs of
half codes form a grid of cells. A vector visits cells in the order of a lower bound of its distance
to anything in the cell (the multi-sequence order over the two sorted halves) until the target recall is reached, which the
sample gives for vectors at the very limit of similarity (0.999 by default: some ten cells of 4096 on
vectors of 64 dimensions). With ``recall=1`` it stops only where no vector of the asked similarity can lie
further on. Everything in a visited cell is verified by cosine in double precision. A link counts for both of its
vectors, each time once: the one that visits the other's cell also counts for the other, unless that one comes to its cell
too, which the task tells from both vectors and the codebooks. The codebooks grow with the number of vectors, so that
a cell holds some ``CELL`` of them at every size.

Vectors are compared only when their labels and their lengths are equal. Null labels, null or
zero vectors, and vectors with null or non-finite components link with nothing, and stay in the
result. Equal vectors are compared once and counted as often as they occur. A crowded cell is cut
into blocks, and so are its visitors, so no task holds more than two blocks. Of the links only sums
and a spanning forest of each pair of blocks leave the task. An id that occurs twice is two vectors
with one id; its links are added up. Vectors of equal cosine are all linked; no order among them matters.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.keys import join_on_keys
from tallyfold.session import scratch_scope, settle

from .batches import bounded_batches, frugal
from .components import components

#: Vectors that the codebooks are learned from, vectors wanted in a cell, codes of each half, learning steps.
SAMPLE, CELL, CODES, STEPS = 8_000, 8, (8, 2_000), 8
#: Vectors of a block, and visitors compared with it at once.
BLOCK = 512
#: Distances from vectors to codes that are held at once.
HELD = 1 << 18
#: Copies of each vector that are dealt to blocks in one round, and copies in all that one round takes at any size.
COPIES, ROUND = 3, 1_000_000


def learn_codebook(x: np.ndarray, codes: int, seed: int) -> np.ndarray:
    """Centres of a half by k-means."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(codes, len(x)), replace=False)]
    for _ in range(STEPS):
        near = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances; each is the same to the last bit whatever rows stand beside it."""
    d = (x * x).sum(1)[:, None] - 2 * np.einsum("ij,kj->ik", x, y) + (y * y).sum(1)
    return np.maximum(d, 0)


def bounds(x: np.ndarray, centres: np.ndarray, codes: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Own code of each row, and the squared distance at least needed to get into the region of each of ``codes``."""
    d = squared(x, centres)
    own = d.argmin(1)
    homes, at = np.unique(own, return_inverse=True)
    apart = np.sqrt(squared(centres[homes], centres[codes]))[at]
    with np.errstate(divide="ignore", invalid="ignore"):
        need = (d[:, codes] - d[np.arange(len(x)), own][:, None]) / (2 * apart)
    need = np.where(apart > 0, np.maximum(need, 0), 0)
    return own, need * need


def held_at_once(books: tuple[np.ndarray, ...]) -> int:
    """Rows whose distances to all codes are held at once."""
    return max(1, min(1024, HELD // max(len(b) for b in books)))


def stays_away(left, right, i: np.ndarray, j: np.ndarray, books, limit: float) -> np.ndarray:
    """Whether the right vector of each pair (rows ``i`` and ``j`` of two sets of halves) does not come to the left one's cell.

    Codes and bounds are found once for each vector, however many pairs it is in."""
    rows, at = np.unique(i, return_inverse=True)
    others, to = np.unique(j, return_inverse=True)
    need = 0
    for x, y, book in zip(left, right, books):
        codes, place = np.unique(squared(x[rows], book).argmin(1), return_inverse=True)
        need = need + bounds(y[others], book, codes)[1][to, place[at]]
    return need > limit


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Grid cells by growing sum of the two halves' bounds, up to ``limit``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, []
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            break
        out.append((int(a[i]), int(b[j])))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (first[a[p]] + second[b[q]], p, q))
    return out


def unit_halves(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    x /= np.linalg.norm(x, axis=1)[:, None]
    half = -(-width // 2)
    return x[:, :half], x[:, half:]


def visiting_limit(halves, books, least: float, recall: float) -> float:
    """Squared distance bound up to which cells are visited.

    For a recall below 1 every sample vector is moved in a random direction until its similarity to
    itself is ``least``, the farthest a link can be; the bound then reaches that share of the moved
    vectors' cells. Closer vectors are found more often.
    """
    limit = 2 - 2 * least + 1e-9
    if recall >= 1:
        return limit
    x = np.hstack(halves)
    aside = np.random.default_rng(11).normal(size=x.shape)
    aside -= (aside * x).sum(1)[:, None] * x
    length = np.linalg.norm(aside, axis=1)[:, None]
    moved = least * x + np.sqrt(1 - least * least) * aside / np.where(length > 0, length, 1)
    cut = halves[0].shape[1]
    need = np.zeros(len(x))
    step = held_at_once(books)
    for part, there, book in zip(halves, (moved[:, :cut], moved[:, cut:]), books):
        for start in range(0, len(x), step):
            some = slice(start, start + step)
            found = bounds(part[some], book)[1]
            need[some] += found[np.arange(len(found)), squared(there[some], book).argmin(1)]
    return min(limit, float(np.quantile(need, recall, method="higher")) + 1e-9)


def link_forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what ``links`` (left by right) connects, at most one for each vector."""
    label = np.concatenate([left, right])
    n, out = len(left), []
    for i in np.nonzero(links.any(1))[0]:
        at = np.concatenate([[i], n + np.nonzero(links[i])[0]])
        parts = np.unique(label[at])
        if len(parts) > 1:
            least = parts[0]
            out += [(int(p), int(least)) for p in parts[1:]]
            label[np.isin(label, parts)] = least
    return out


def near_duplicates(
    vectors: DataFrame, least: float = 0.98, recall: float = 0.999, key: str = "vec_id", vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Key, ``n_links``, ``component_id`` and ``kept`` of every row."""
    v = F.col(vector)
    sound = v.isNotNull() & F.col(label).isNotNull() & (F.size(v) > 0)
    sound &= ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    sound &= F.exists(v, lambda e: e != 0)
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(label).alias("label"), v.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    whole = rows.select("id").distinct()
    rows = rows.where("sound").drop("sound")
    # Equal vectors are one: two different ones share both hashes about once in 10^38 pairs.
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v"), "n": F.size("v")})
    same = ["label", "n", "h1", "h2"]
    ones = rows.groupBy(*same).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    ones = settle(ones.withColumn("u", F.monotonically_increasing_id()), "vectors")
    sample = [r.v for r in ones.select("v").orderBy(F.xxhash64("v"), "u").limit(SAMPLE).collect()]
    if not sample:
        return whole.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    width = max(2, ones.agg(F.max("n")).first()[0])
    halves = unit_halves(sample, width)
    codes = min(max(int((ones.count() / CELL) ** 0.5), CODES[0]), CODES[1])
    books = tuple(learn_codebook(h, codes, s) for s, h in enumerate(halves))
    limit = visiting_limit(halves, books, least, recall)

    @frugal
    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's own cell, and the cells it visits."""
        step = held_at_once(books)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                (own1, need1), (own2, need2) = (bounds(h, b) for h, b in zip(unit_halves(part.column("v").to_pylist(), width), books))
                at, cells, home = [], [], []
                for i in range(part.num_rows):
                    for a, b in multi_sequence(need1[i], need2[i], limit):
                        at.append(i)
                        cells.append(a * len(books[1]) + b)
                        home.append(a == own1[i] and b == own2[i])
                u = part.column("u").to_numpy()[at] if at else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u, pa.int64()), pa.array(cells, pa.int32()), pa.array(home, pa.bool_())], ["u", "cell", "home"])

    # Only ids go through the counts; vectors join once the blocks are known.
    with scratch_scope() as scope:
        seen = settle(bounded_batches(ones.select("u", "v")).mapInArrow(visits, "u long, cell int, home boolean"), "visits")
        seen = join_on_keys(seen, ones.select("u", "label", "n"), ["u"])
        place = ["label", "n", "cell"]
        counts = seen.groupBy(*place).agg(F.count_if("home").alias("held"), F.count(F.lit(1)).alias("came"))
        # Who is alone in a cell that nobody else visits meets only itself there.
        counts = settle(counts.where("held > 0 AND came > 1").withColumn("spot", F.monotonically_increasing_id()), "cells")
        seen = join_on_keys(seen, counts, place)
        blocks, crowds = F.ceil(F.col("held") / BLOCK), F.ceil(F.col("came") / BLOCK)
        block = F.pmod(F.xxhash64("u"), blocks).cast("int")
        crowd = F.pmod(F.xxhash64(F.lit(1), "u"), crowds).cast("int")
        lower = F.lit(0).cast("int")
        visitors = seen.select("u", "spot", F.lit(False).alias("held_here"), crowd.alias("crowd"), F.explode(F.sequence(lower, (blocks - 1).cast("int"))).alias("block"))
        held = seen.where("home").select("u", "spot", F.lit(True).alias("held_here"), F.explode(F.sequence(lower, (crowds - 1).cast("int"))).alias("crowd"), block.alias("block"))
        cast = visitors.union(held.select(*visitors.columns[:-2], "crowd", "block"))
        cast = scope.result(cast, "casts")

    group = ["spot", "block", "crowd"]
    kept = ["held_here", "u", "id", "copies", "v"]

    @frugal
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group; of the last group of a batch the next may hold more."""
        rest = None
        for batch in filter(len, batches):
            rows = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()[0]
            new = np.zeros(rows.num_rows, bool)
            new[0] = True
            for c in group:
                number = rows.column(c).to_numpy()
                new[1:] |= number[1:] != number[:-1]
            starts = np.flatnonzero(new)
            yield found_links(rows.slice(0, starts[-1]), starts)
            rest = rows.slice(starts[-1])
        if rest is not None:
            yield found_links(rest, np.array([0, rest.num_rows]))

    def found_links(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        held, u, id_, copies = (rows.column(c).to_numpy(zero_copy_only=False) for c in kept[:-1])
        lists = rows.column("v")
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        numbers = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        out = {"id": [], "links": [], "other": []}
        for start, end in zip(starts[:-1], starts[1:]):
            here = held[start:end]
            if here.all() or not here.any():
                continue
            # All vectors of a group have one length.
            vectors = numbers[first[start]: first[end]].reshape(end - start, -1)
            left, right = (np.flatnonzero(x) for x in (~here, here))
            raw = vectors[left], vectors[right]
            a, b = (m / np.linalg.norm(m, axis=1)[:, None] for m in raw)
            mine, theirs = u[start:end][left], u[start:end][right]
            links = (a @ b.T >= least) & (mine[:, None] != theirs)
            if not links.any():
                continue
            found = links @ copies[start:end][right]
            some = found > 0
            ids, other = id_[start:end][left], id_[start:end][right]
            out["id"] += ids[some].tolist()
            out["links"] += found[some].tolist()
            # A held vector that does not come to its visitor's cell has no other place to count the link.
            i, j = np.nonzero(links)
            alone = stays_away(*(unit_halves(list(m), width) for m in raw), i, j, books, limit)
            out["id"] += other[j[alone]].tolist()
            out["links"] += copies[start:end][left][i[alone]].tolist()
            out["other"] += [None] * (len(out["id"]) - len(out["other"]))
            for p, q in link_forest(links, ids, other):
                out["id"].append(p)
                out["links"].append(0)
                out["other"].append(q)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out.values()], list(out))

    # A vector is dealt to tens of blocks; in rounds of whole cells, only the copies of one round are on disk at a time.
    rounds = -(-cast.count() // max(COPIES * ones.count(), ROUND))
    found = []
    for turn in range(max(rounds, 1)):
        work = cast.where(F.pmod(F.xxhash64(F.lit(2), "spot"), F.lit(max(rounds, 1))) == turn)
        work = join_on_keys(work, ones.select("u", "id", "copies", "v"), ["u"])
        work = bounded_batches(work.select(*group, *kept).repartition(*group).sortWithinPartitions(*group))
        found.append(settle(work.mapInArrow(compare, "id long, links long, other long"), "vector-links"))
    found = reduce(DataFrame.union, found)
    direct = found.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("other IS NOT NULL").select("id", "other"))
    reps = ones.select(*same, F.col("id").alias("rep"), "copies")
    reps = join_on_keys(reps, direct.select(F.col("id").alias("rep"), "links"), ["rep"], how="left")
    reps = join_on_keys(reps, joined.select(F.col("node").alias("rep"), "component"), ["rep"], how="left")
    reps = settle(reps, "vector-classes")
    # Every row of a class has the links of its class and the other rows of the class.
    members = join_on_keys(rows.drop("v"), reps, same)
    members = members.groupBy("id").agg(
        F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.min(F.coalesce("component", "rep")).alias("component"))
    out = join_on_keys(whole, members, ["id"], how="left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
