"""N-gram Jaccard join: documents whose sets of word n-grams overlap by 0.8, and their groups.

The join works on relations between sets rather than on pairs of documents.

1. Equal sets become one. Each set is ordered by rarity (a count sketch of all n-grams) and its prefix,
   of which two linked sets must share a member, goes into inverted lists, ordered by size. A set stays in a
   list only where sizes and positions leave it a partner, or where the list is crowded.
2. *Heads.* Within a list and a size class the first set is the head, in crowded lists the set that is in
   most crowded lists, which is the least changed of a family of near copies. A set is verified against
   the head it meets most often, which also measures how it differs from it. Where that is no link, sets
   in crowded lists are verified against a few more heads, each the least set in another order of the ids.
   What links so forms groups; of a large family little is left.
3. *Skipping by blocks.* Lists whose sets are all of one group are done. The others are cut into blocks
   with the range of their sizes and the least position; pairs of blocks that cannot hold a link, or
   hold one group, are skipped as a whole.
4. *Derived answers.* For two sets with one head, the overlaps with the head bound their own overlap
   from both sides; only pairs that the bounds leave open are verified on their texts.

Before texts are fetched, for heads as for other pairs, a bitmap of two to four bits a member bounds the overlap: a bit
that only one of two sets has is a member that the other lacks. Sets that share a few n-grams by chance, of which there
are more for each set the larger the table, end there.

Skipped pairs are either in one group already or too different, so the groups are exact. N-grams are
64-bit fingerprints. The sketch has a fixed size and only decides the order, never what is found.
Sets are equal if size and two 64-bit sums are.

Null and empty texts have no n-grams and link with nothing; a text with fewer words than n is one
n-gram. Rows with one id are one document of the groups. Rows without an id get no group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.operators.keys import join_on_keys
from tallyfold.session import Scope, scratch_scope, settle

from .batches import bounded_batches, frugal, slices
from .components import components
from .fingerprints import Words, mix, prefix_sums, span, words_of
from .recompression import packed_texts, unpacked

N, PERCENT = 5, 80
#: The overlap with a head is also measured where it is no link but may reach this, for the bounds.
HEAD_PERCENT = 50
SKETCH_BITS = 17
SLICE = 1 << 20
BLOCK = 256
#: Lists with so many sets of a size class are crowded; their sets meet a head for each of these orders.
CROWD = 8
ORDERS = (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x7FFFFFFFFFFFFFFF)


def grams(words: Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Text and fingerprint of every n-gram, in order; a shorter text is one n-gram."""
    counts = words.counts()
    held = np.where(counts >= n, counts - n + 1, counts > 0)
    text = np.repeat(np.arange(len(counts)), held)
    at = words.first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(held) - held, held)
    return text, span(prefix_sums(words.hashes), at, np.minimum(at + n, words.first[1:][text]))


def gram_sets(words: Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats, by text and fingerprint."""
    text, gram = grams(words, n)
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
    return text[new], gram[new]


def needed(n1: Column, n2: Column, percent: int = PERCENT) -> Column:
    """Least overlap of two linked sets: 100 * overlap >= percent * union."""
    return F.ceil(percent * (n1 + n2) / F.lit(100.0 + percent) - 1e-9)


def bitmaps(text: np.ndarray, gram: np.ndarray, n: np.ndarray) -> pa.Array:
    """A bit for each member's hash, two to four times as many bits as members, a power of two."""
    size = np.where(n > 0, 1 << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64), 0)
    ends = np.cumsum(size)
    bits = np.zeros(size.sum(), bool)
    bits[(ends - size)[text] + (gram & (size[text] - 1).astype(np.uint64)).astype(np.int64)] = True
    offsets = np.concatenate([[0], ends // 8]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(bits))])


def most_shared(left: pa.Array, right: pa.Array, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Greatest overlap that the bitmaps of each two sets allow; the longer bitmap is folded to the shorter."""
    widths = [pc.binary_length(x).to_numpy().astype(np.int64) for x in (left, right)]
    maps = [x.to_pylist() for x in (left, right)]
    out = np.minimum(n1, n2)
    for w1, w2 in np.unique(np.stack(widths, 1), axis=0):
        at = np.flatnonzero((widths[0] == w1) & (widths[1] == w2))
        x, y = (np.frombuffer(b"".join([m[i] for i in at]), np.uint8).reshape(len(at), w) for m, w in zip(maps, (w1, w2)))
        while x.shape[1] != y.shape[1]:
            half = min(x.shape[1], y.shape[1])
            x, y = (z if z.shape[1] == half else z[:, : z.shape[1] // 2] | z[:, z.shape[1] // 2:] for z in (x, y))
        own, other, both = (np.bitwise_count(z).sum(1, dtype=np.int64) for z in (x, y, x & y))
        out[at] = np.minimum(n1[at] - (own - both), n2[at] - (other - both))
    return out


def rarity_levels(docs: DataFrame) -> np.ndarray:
    """Half powers of two of the count of each n-gram's bucket, over all documents."""
    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                gram = grams(words_of(part.column("text"), fold=True))[1]
                seen += np.bincount((gram >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some], pa.int64())], ["bucket", "seen"])

    totals = bounded_batches(docs.select("text")).mapInArrow(count, "bucket int, seen long").groupBy("bucket").agg(F.sum("seen").alias("seen"))
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    rows = totals.toArrow()  # at most 2^SKETCH_BITS rows
    levels[rows.column("bucket").to_numpy()] = 2 * np.log2(rows.column("seen").to_numpy()) + 1
    return levels


def described(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """``k``, ``t``, set size ``n``, sums ``d1`` and ``d2``, the rarest members as ``prefix``, and a bitmap of all as ``bits``."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    kind = dict(docs.dtypes)["k"]
    names = ["k", "t", "n", "d1", "d2", "prefix", "bits"]

    @frugal
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                text, gram = gram_sets(words_of(part.column("text"), fold=True))
                n = np.bincount(text, minlength=part.num_rows)
                first = np.cumsum(n) - n
                sums = []
                for salt in (0x51, 0xA7):
                    with np.errstate(over="ignore"):
                        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(gram + np.uint64(salt << 40)))])
                        sums.append((total[first + n] - total[first]).view(np.int64))
                rank = level[(gram >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(text * 256 + rank, kind="stable")
                kept = np.where(n > 0, n - (PERCENT * n + 99) // 100 + 1, 0)
                place = np.arange(len(text)) - first[text]
                prefix = gram[order][place < kept[text]]
                offsets = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("k"), part.column("t"), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]),
                    pa.ListArray.from_arrays(offsets, pa.array(prefix.view(np.int64))), bitmaps(text, gram, n)], names)

    return bounded_batches(docs.select("k", "t", "text")).mapInArrow(describe, f"k {kind}, t long, n long, d1 long, d2 long, prefix array<long>, bits binary")


def possible(pairs: DataFrame, bits: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (``a``, ``b``), each once, that may overlap by ``percent`` as far as the bitmaps tell."""
    kind = dict(pairs.dtypes)["a"]
    left = bits.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("bits").alias("za"))
    right = bits.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("zb"))
    both = join_on_keys(join_on_keys(pairs.select("a", "b"), left, ["a"]), right, ["b"])

    @frugal
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = (batch.column(c).to_numpy() for c in ("na", "nb"))
            o = most_shared(batch.column("za"), batch.column("zb"), n1, n2)
            some = pa.array(100 * o >= percent * (n1 + n2 - o))
            yield batch.select(["a", "b"]).filter(some)

    found = bounded_batches(both.select("a", "b", "na", "nb", "za", "zb")).mapInArrow(bound, f"a {kind}, b {kind}")
    return found.distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) with the size of both sets and of their overlap ``o``, counted on the texts."""
    kind = dict(pairs.dtypes)["a"]
    left = texts.select(F.col("k").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("k").alias("b"), F.col("z").alias("zb"))
    both = join_on_keys(join_on_keys(pairs.select("a", "b"), left, ["a"]), right, ["b"])

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                (ta, ga), (tb, gb) = (gram_sets(words_of(unpacked(part.column(c)), fold=True)) for c in ("za", "zb"))
                na, nb = (np.bincount(t, minlength=part.num_rows) for t in (ta, tb))
                # Members of both sets of a pair stand next to each other.
                text, gram = np.concatenate([ta, tb]), np.concatenate([ga, gb])
                order = np.lexsort((gram, text))
                text, gram = text[order], gram[order]
                twice = (text[1:] == text[:-1]) & (gram[1:] == gram[:-1])
                o = np.bincount(text[1:][twice], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), *(pa.array(x, pa.int64()) for x in (na, nb, o))], ["a", "b", "na", "nb", "o"])

    return bounded_batches(both.select("a", "b", "za", "zb")).mapInArrow(count, f"a {kind}, b {kind}, na long, nb long, o long")


def linked() -> Column:
    return 100 * F.col("o") >= PERCENT * (F.col("na") + F.col("nb") - F.col("o"))


def _classes(sets: DataFrame) -> DataFrame:
    """The least ``k`` of equal sets, their size and prefix."""
    return sets.groupBy("n", "d1", "d2").agg(F.min("k").alias("k"), F.first("prefix").alias("prefix")).select("k", "n", "prefix")


def _lists(classes: DataFrame) -> DataFrame:
    """Inverted lists, of sets that may link with another of the list, or crowd it: ``g``, set ``k``, its size and position, its ``head``, and
    ``m0``, ``m1``, ...: for crowded lists the least set in each of the orders, as its order value."""
    rows = classes.select("k", "n", F.posexplode("prefix").alias("pos", "g"))
    # Dealt by list here, so that what follows from a row's own values is not sent along.
    rows = rows.repartition("g")
    rows = rows.withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / np.log(100 / PERCENT)).cast("int"))
    by_list = W.partitionBy("g").orderBy("size_class", "n", "k")
    by_size = W.partitionBy("g", "size_class").orderBy("n", "k")
    crowd = W.partitionBy("g", "size_class")
    # The largest set that may link from this position on; a link's smaller set reaches the larger.
    rows = rows.withColumn("reach", F.floor((100 + PERCENT) * (F.col("n") - F.col("pos")) / F.lit(float(PERCENT))) - F.col("n"))
    earlier = F.max("reach").over(by_list.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"before": F.lag("n").over(by_list), "earlier": earlier, "after": F.lead("n").over(by_list)})
    rows = rows.withColumn("crowd", F.count(F.lit(1)).over(crowd))
    smaller = (100 * F.col("before") >= PERCENT * F.col("n")) & (F.col("earlier") >= F.col("n"))
    larger = (100 * F.col("n") >= PERCENT * F.col("after")) & (F.col("after") <= F.col("reach"))
    # Crowded lists stay whole: they tell which sets are the heads of a family.
    rows = rows.where(smaller | larger | (F.col("crowd") >= CROWD)).select("g", "k", "n", "pos", "size_class", "crowd")
    rows = rows.withColumn("head", F.first("k").over(by_size))
    rows = rows.withColumns({f"m{i}": F.min(F.col("k").bitwiseXOR(F.lit(o))).over(crowd) for i, o in enumerate(ORDERS)})
    least = [F.when(F.col("crowd") >= CROWD, F.col(f"m{i}")).alias(f"m{i}") for i in range(len(ORDERS))]
    return rows.select("g", "k", "n", "pos", "head", *least)


def _central(lists: DataFrame) -> DataFrame:
    """For each set in crowded lists (``a``) the set of those lists that is in most crowded lists (``b``)."""
    crowded = lists.where("m0 IS NOT NULL").select("g", "k")
    often = crowded.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    counted = join_on_keys(crowded, often, ["k"])
    centre = counted.groupBy("g").agg(F.max(F.struct("c", (-F.col("k")).alias("m"))).alias("x"))
    met = join_on_keys(crowded, centre, ["g"]).groupBy("k").agg(F.max("x").alias("x"))
    return met.select(F.col("k").alias("a"), (-F.col("x.m")).alias("b"))


def _bounds(side: str = "_") -> tuple[Column, Column]:
    """Least and greatest overlap of two sets that the overlaps with a common head allow."""
    c = lambda name, s: F.col(f"{name}{side}{s}")
    same = F.coalesce(c("head", "x") == c("head", "y"), F.lit(False))
    low = F.when(same, c("o", "x") + c("o", "y") - c("nh", "x")).otherwise(0)
    high = F.when(same, F.least(c("o", "x"), c("o", "y")) + F.least(c("n", "x") - c("o", "x"), c("n", "y") - c("o", "y")))
    return low, F.coalesce(high, F.least(c("n", "x"), c("n", "y")))


def _open_pairs(lists: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of sets of different groups that share a list and may link, and whether they surely do;
    ``known``: set, group, its head, their overlap and the size of the head."""
    rows = join_on_keys(lists.select("g", "k", "n", "pos"), known, ["k"])
    mixed = rows.groupBy("g").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("g")
    rows = join_on_keys(rows, mixed, ["g"])
    place = F.row_number().over(W.partitionBy("g").orderBy("n", "pos", "k")) - 1
    rows = settle(rows.withColumn("block", F.floor(place / BLOCK).cast("int")), "mixed-lists")
    blocks = rows.groupBy("g", "block").agg(
        F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.min("pos").alias("pos_lo"), F.min("group").alias("g_lo"), F.max("group").alias("g_hi"))
    x, y = (blocks.select("g", *[F.col(c).alias(f"{c}_{s}") for c in blocks.columns[1:]]) for s in "xy")
    pairs = join_on_keys(x, y, ["g"]).where("block_x <= block_y")
    # Sizes too far apart, too little left after the positions, or one group: no link to find.
    rest = 1 + F.least(F.col("n_hi_x") - 1 - F.col("pos_lo_x"), F.col("n_hi_y") - 1 - F.col("pos_lo_y"))
    pairs = pairs.where(
        (100 * F.col("n_hi_x") >= PERCENT * F.col("n_lo_y")) & (rest >= needed(F.col("n_lo_x"), F.col("n_lo_y")))
        & ~((F.col("g_lo_x") == F.col("g_hi_x")) & (F.col("g_lo_x") == F.col("g_lo_y")) & (F.col("g_lo_y") == F.col("g_hi_y"))))
    pairs = pairs.select("g", "block_x", "block_y")
    left, right = (rows.select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "k", "n", "pos", "group", "head", "o", "nh")]) for s in "xy")
    pairs = join_on_keys(join_on_keys(pairs, left, ["g", "block_x"]), right, ["g", "block_y"])
    least = needed(F.col("n_x"), F.col("n_y"))
    rest = 1 + F.least(F.col("n_x") - 1 - F.col("pos_x"), F.col("n_y") - 1 - F.col("pos_y"))
    low, high = _bounds()
    pairs = pairs.where(
        (high >= least) & (F.col("group_x") != F.col("group_y")) & (100 * F.least("n_x", "n_y") >= PERCENT * F.greatest("n_x", "n_y")) & (rest >= least)
        & ((F.col("block_x") < F.col("block_y")) | (F.col("k_x") < F.col("k_y"))))
    # A pair verified with its head is known.
    pairs = pairs.where("NOT (head_x <=> k_y) AND NOT (head_y <=> k_x)")
    ends = (F.least("k_x", "k_y").alias("a"), F.greatest("k_x", "k_y").alias("b"))
    return pairs.groupBy(*ends).agg(F.max(low >= least).alias("sure"))


def ngram_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``n_shingles`` and ``component_id`` of every document."""
    docs = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))
    with scratch_scope() as scope:
        with scratch_scope() as early:
            with scratch_scope() as listed:
                with scratch_scope():
                    whole = settle(described(docs, rarity_levels(docs)), "gram-sets")
                    sets = scope.keep(whole.drop("prefix", "bits"), "gram-ids")
                    sound = whole.where("n > 0 AND k IS NOT NULL")
                    bits = early.keep(sound.select("k", "n", "bits"), "gram-bits")
                    # The prefixes are read once, for the lists; their copies and shuffle files go before those are made.
                    classes = listed.keep(_classes(sound), "gram-classes")
                lists = early.keep(_lists(classes), "gram-lists")
            some = sets.where("n > 0 AND k IS NOT NULL")
            first, sure, unsure, texts = _candidates(docs, some, lists, bits, scope)
        # The lists are gone; only the pairs that the bounds left open and the texts are there.
        with scratch_scope():
            more = verified(unsure, texts).where(linked()).select("a", "b")
            links = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
            links = scope.keep(links.union(sure).union(more), "gram-links")
        groups = components(links)
        classes = some.groupBy("n", "d1", "d2").agg(F.min("k").alias("rep"))
        classes = join_on_keys(classes, groups.select(F.col("node").alias("rep"), "component"), ["rep"], how="left")
        classes = classes.select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
        out = join_on_keys(sets.select("k", "n", "d1", "d2"), classes, ["n", "d1", "d2"], how="left")
        component = F.when(F.col("k").isNotNull(), F.coalesce("component", "k"))
        out = out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
        return scope.result(out, "gram-groups")


def _candidates(
    docs: DataFrame, some: DataFrame, lists: DataFrame, bits: DataFrame, scope: Scope,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Groups by links to heads, pairs of different groups that surely link, pairs that may, and the texts to verify those
    on; the four tables belong to ``scope``."""
    met = lists.where("head != k").groupBy("k", "head").agg(F.count(F.lit(1)).alias("c"))
    best = met.groupBy("k").agg(F.max(F.struct("c", (-F.col("head")).alias("m"))).alias("x"))
    best = best.select(F.col("k").alias("a"), (-F.col("x.m")).alias("b"))
    central = settle(_central(lists), "gram-central")
    stars = join_on_keys(best, central.select("a"), ["a"], how="left_anti").union(central.where("a != b"))
    stars = settle(possible(settle(stars, "gram-heads"), bits, HEAD_PERCENT), "gram-near-heads")
    members = settle(lists.select("k").distinct(), "gram-members")
    wanted = join_on_keys(some.select("k", "t").distinct(), members, ["k"])
    # Each key is there once and none is null, so the join may read the texts as they lie.
    packed = packed_texts(docs).dropDuplicates(["k", "t"])
    texts = scope.keep(join_on_keys(packed, wanted, [], never_null=["k", "t"]).select("k", "z"), "gram-texts")
    answers = settle(verified(stars, texts), "gram-answers")
    # The further heads of sets that are not linked to their first one.
    orders = range(len(ORDERS))
    other = lists.groupBy("k").agg(*[F.min(f"m{i}").alias(f"m{i}") for i in orders])
    other = other.select(F.col("k").alias("a"), F.explode(F.array(*[F.col(f"m{i}").bitwiseXOR(F.lit(o)) for i, o in enumerate(ORDERS)])).alias("b"))
    other = other.where("b IS NOT NULL AND a != b").distinct()
    other = join_on_keys(other, answers.where(linked()).select("a"), ["a"], how="left_anti")
    further = verified(settle(possible(settle(other, "gram-further"), bits), "gram-near-further"), texts)
    links = answers.union(settle(further, "gram-further-answers")).where(linked()).select("a", "b")
    first = scope.keep(components(links), "gram-first")

    # An id with several texts has several answers, and none that would bound others.
    head = answers.groupBy(F.col("a").alias("k")).agg(
        F.max("b").alias("head"), F.max("o").alias("o"), F.max("nb").alias("nh"), F.count(F.lit(1)).alias("c"))
    head = head.where("c = 1").drop("c")
    known = join_on_keys(members, head, ["k"], how="left")
    known = join_on_keys(known, first.select(F.col("node").alias("k"), "component"), ["k"], how="left")
    known = settle(known.select("k", F.coalesce("component", "k").alias("group"), "head", "o", "nh"), "gram-known")
    # With one head h: |x & y| >= |x & h| + |y & h| - |h|, and <= least overlap + least rest outside h.
    derived = settle(_open_pairs(lists, known), "gram-derived")
    sure = scope.keep(derived.where("sure").select("a", "b"), "gram-sure")
    unsure = scope.keep(possible(derived.where("NOT sure"), bits), "gram-open")
    return first, sure, unsure, texts
