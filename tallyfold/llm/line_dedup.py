"""Line dedup by an exact set-similarity join. Native.

A line's set is its distinct words, hashed and written once for all that follows up to the lists. Lines with equal sets are one class,
whose first line (by document id, then place) stands for it; the others go. The words of a set are ordered by rarity and its
prefix, of which two matching sets must share a word, goes into inverted lists with size and position. By the length and positional
filters a row has a largest size that it can match; rows that no other row of their list can match by that are dropped. Within a
list, sets are paired under these filters, and a 64-bit parity of each set bounds the
difference of two sets from below. What is left is verified by Jaccard on the words themselves, which are cut again
from the documents that hold them: a bitmap of fixed size keeps the other documents from being shuffled.

A line is removed when an earlier line matches it, whether or not that one is removed too. So each set
first meets only the earliest set of its size class that it shares most lists with; sets removed by
that need no other pair. This keeps large groups of near copies from being paired among themselves. Sets that are
not let through to that one by the filters meet all earlier sets of the list.

Rarity is the number of lines with a word of the word's bucket, in a sketch of fixed size over all lines; it decides only the
order. Sets of up to eight words match only equal sets, at 0.9, so they are in no list: their class says all.
Every line with a word can be removed; blank lines have an empty set, which has no similarity, and stay. Null
and empty texts have no lines to remove. Documents without an id keep all lines and remove none. Rows of one id
and one text are one document; other texts of an id follow in the order of a hash of the text, and each row loses only
lines of its own text.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.operators.keys import join_on_keys
from tallyfold.session import scratch_scope, settle

PERCENT = 90
LEAST_WORDS = 1
SKETCH_BITS = 18
SPACES = " \t\n\x0b\x0c\r"
#: Bits of the bitmap of documents whose lines are verified.
BITMAP_BITS = 24
#: A line: its document's id, and one number for the document's text and the line's place in it.
LINE = ["k", "line"]
#: Lists of at most so many rows are paired where they are made.
SHORT = 32


def line_words(text: Column) -> Column:
    """The words of a line; repeated ones stay. Lines with more than single blanks between their words are brought to
    that first; the others, most of them, are spared the pattern."""
    odd = F.contains(text, F.lit("  ")) | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" ")) | F.rlike(text, F.lit(r"[\x09-\x0D]"))
    return F.split(F.when(odd, F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))).otherwise(text), " ")


def text_number(text: Column) -> Column:
    """31 bits that tell the texts of one id apart, placed above a line's place."""
    return F.shiftleft(F.xxhash64(text).bitwiseAND((1 << 31) - 1), 31)


def lines_of(docs: DataFrame) -> DataFrame:
    """``k``, ``line`` and ``words`` of the lines that can be removed."""
    cut = docs.where(F.col("k").isNotNull() & F.col("text").isNotNull()).select("k", text_number(F.col("text")).alias("t"), F.split("text", "\n").alias("lines"))
    lines = cut.select("k", "t", F.posexplode("lines").alias("at", "s"))
    # A test on the words would be moved before them and cut every line twice.
    lines = lines.where(F.btrim("s", F.lit(SPACES)) != "")
    return lines.select("k", (F.col("t") + F.col("at")).alias("line"), line_words(F.col("s")).alias("words"))


def members(words: Column) -> Column:
    """The distinct words as sorted 64-bit hashes."""
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def line_sets(docs: DataFrame) -> DataFrame:
    """``k``, ``line``, and the set of every line that can be removed: ``m``, its size and two digests of it."""
    sets = lines_of(docs).select(*LINE, members(F.col("words")).alias("m"))
    return sets.select(*LINE, F.size("m").alias("n"), F.xxhash64("m").alias("d1"), F.xxhash64(F.lit(1), "m").alias("d2"), "m")


def word_levels(sets: DataFrame) -> Column:
    """A constant array: for each bucket of word hashes, half powers of two of the number of lines it occurs in."""
    words = sets.select(F.explode("m").alias("w"))
    bucket = F.shiftrightunsigned("w", 64 - SKETCH_BITS).cast("int")
    counts = words.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c")).toArrow()  # at most 2^SKETCH_BITS rows
    levels = ["0"] * (1 << SKETCH_BITS)
    for b, c in zip(counts.column("b").to_pylist(), counts.column("c").to_pylist()):
        levels[b] = str(int(2 * math.log2(c)) + 1)
    return F.split(F.lit(",".join(levels)), ",").cast("array<bigint>")


def described(sets: DataFrame, levels: Column) -> DataFrame:
    """Sets with parity and prefix; members of the prefix are hashes led by their level."""
    def member(h: Column) -> Column:
        level = F.get(levels, F.shiftrightunsigned(h, 64 - SKETCH_BITS))
        # Members that cannot be null are sorted as plain numbers.
        return F.coalesce(F.shiftleft(level, 56).bitwiseOR(h.bitwiseAND((1 << 56) - 1)), F.lit(0).cast("long"))

    n = F.col("n")
    parity = F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))))
    # The nearest to a set that is not equal is the set with one word more.
    kept = F.when(100 * n >= PERCENT * (n + 1), n - F.ceil(n * PERCENT / 100.0 - 1e-9).cast("int") + 1).otherwise(0)
    prefix = F.when(kept > 0, F.slice(F.sort_array(F.transform("m", member)), F.lit(1), kept))
    return sets.select(*LINE, "n", "d1", "d2", F.when(kept > 0, parity).otherwise(0).alias("p"), prefix.alias("prefix"))


def least_overlap(n1: Column, n2: Column) -> Column:
    return F.ceil(PERCENT * (n1 + n2) / (100.0 + PERCENT) - 1e-9)


def filters(n1: Column, pos1: Column, p1: Column, n2: Column, pos2: Column, p2: Column) -> Column:
    """Length, positional and parity filters on two rows of a list."""
    least = least_overlap(n1, n2)
    rest = 1 + F.least(n1 - 1 - pos1, n2 - 1 - pos2)
    apart = F.bit_count(p1.bitwiseXOR(p2))
    return (100 * F.least(n1, n2) >= PERCENT * F.greatest(n1, n2)) & (rest >= least) & (apart <= n1 + n2 - 2 * least)


def may_match(a: str, b: str) -> Column:
    """The filters on the columns ``n``, ``pos`` and ``p`` with two suffixes."""
    return filters(*[F.col(f"{c}{v}") for v in (a, b) for c in ("n", "pos", "p")])


def classes_of(sets: DataFrame) -> DataFrame:
    """The first line of every class of equal sets, with the set's size, parity and prefix."""
    classes = sets.groupBy("d1", "d2", "n", "p").agg(F.min(F.struct(*LINE)).alias("c"), F.first("prefix").alias("prefix"))
    return classes.select("c.k", "c.line", "n", "p", "prefix")


def _with_partners(rows: DataFrame) -> DataFrame:
    """Rows that the length and positional filters may let match another row of their list; ``reach`` is the size
    of the largest set that a row can match."""
    positional = F.expr(f"cast(n - pos as bigint) * {100 + PERCENT} div {PERCENT} - n")
    rows = rows.withColumn("reach", F.least(positional, F.expr(f"cast(n as bigint) * 100 div {PERCENT}")))
    by_size = W.partitionBy("g").orderBy("size_class", "n", F.desc("pos"))
    # Of the larger sets of a list the next one is the nearest; of the smaller ones any may reach this one.
    rows = rows.withColumn("next", F.lead("n").over(by_size))
    rows = rows.withColumn("reached", F.max("reach").over(by_size.rowsBetween(W.unboundedPreceding, -1)))
    return rows.where((F.col("next") <= F.col("reach")) | (F.col("reached") >= F.col("n"))).drop("reach", "next", "reached")


def _lists(classes: DataFrame) -> DataFrame:
    """Rows of long lists and pairs of short ones.

    A row for each class and member of its prefix (``g``) that may have a partner in a list of more than ``SHORT`` such rows, with
    ``h``, the earliest class of the list and size class where the filters let it match; ``near`` is null. From the other lists
    the rows with ``near``, the classes before them in the order of size that the filters let them match.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT)).cast("int")
    rows = classes.where(F.size("prefix") > 0).select(*LINE, "n", "p", size_class.alias("size_class"), F.posexplode("prefix").alias("pos", "g"))
    by_size = W.partitionBy("g").orderBy("size_class", "n", F.desc("pos"))
    rows = _with_partners(rows).withColumn("many", F.count(F.lit(1)).over(by_size.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    row, is_long = F.struct(*LINE, "n", "pos", "p"), F.col("many") > SHORT
    rows = rows.withColumn("before", F.collect_list(F.when(~is_long, row)).over(by_size.rowsBetween(1 - SHORT, -1)))
    rows = rows.withColumn("h", F.min(F.when(is_long, row)).over(W.partitionBy("g", "size_class")))
    here = [F.col(c) for c in ("n", "pos", "p")]
    near = F.filter("before", lambda x: filters(*here, x["n"], x["pos"], x["p"]))
    near = F.when(~is_long, F.transform(near, lambda x: F.struct(x["k"].alias("k"), x["line"].alias("line"))))
    rows = rows.select("g", *LINE, *here, near.alias("near"), *[F.col(f"h.{c}").alias(f"{c}_h") for c in (*LINE, "n", "pos", "p")])
    rows = rows.where(F.col("near").isNull() | (F.size("near") > 0))
    other = (F.col("k_h") != F.col("k")) | (F.col("line_h") != F.col("line"))
    head = F.when(other & may_match("", "_h"), F.struct(F.col("k_h").alias("k"), F.col("line_h").alias("line")))
    return rows.select("g", *LINE, *here, head.alias("h"), "near")


def _earlier(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of a class of ``asked`` (``k``, ``line``) and an earlier one of ``rows`` (``hk``, ``hline``) in one list that the
    filters pass; the join can be split."""
    others = rows.select("g", *[F.col(c).alias(f"{c}_x") for c in (*LINE, "n", "pos", "p")])
    before = (F.col("k_x") < F.col("k")) | ((F.col("k_x") == F.col("k")) & (F.col("line_x") < F.col("line")))
    met = join_on_keys(asked.select("g", *LINE, "n", "pos", "p"), others, ["g"]).where(before & may_match("", "_x"))
    return met.select(*LINE, F.col("k_x").alias("hk"), F.col("line_x").alias("hline")).distinct()


def _of_wanted_documents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents whose bit is set in a bitmap of the documents of ``wanted`` (``k``, ``t``).

    The bitmap has at most 2^(BITMAP_BITS - 6) rows of 64 bits, whatever the number of documents.
    """
    bit = lambda: F.shiftrightunsigned(F.xxhash64("k", "t"), 64 - BITMAP_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit().bitwiseAND(63).cast("int"))
    bits = wanted.groupBy(F.shiftrightunsigned(bit(), 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    met = docs.join(F.broadcast(settle(bits, "line-bitmap")), F.shiftrightunsigned(bit(), 6) == F.col("word"))
    return met.where(F.col("bits").bitwiseAND(one) != 0).select("k", "t", "text")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Later lines (``k``, ``line``) of pairs with an earlier one (``hk``, ``hline``) that match on their words; ``pairs`` is written."""
    ids = pairs.select(*LINE).union(pairs.select("hk", "hline")).distinct()
    place = F.col("line").bitwiseAND((1 << 31) - 1)
    ids = ids.select("k", (F.col("line") - place).alias("t"), place.cast("int").alias("at"))
    ids = settle(ids.groupBy("k", "t").agg(F.collect_set("at").alias("wanted")), "line-ids")
    some = docs.where("k IS NOT NULL AND text IS NOT NULL").select("k", text_number(F.col("text")).alias("t"), "text")
    held = join_on_keys(_of_wanted_documents(some, ids.select("k", "t")), ids, ["k", "t"])
    held = held.select("k", "t", F.explode("wanted").alias("at"), F.split("text", "\n").alias("lines"))
    words = held.select("k", (F.col("t") + F.col("at")).alias("line"), members(line_words(F.get("lines", "at"))).alias("m"))
    # Rows that occur twice have their lines once.
    words = settle(words.dropDuplicates(LINE), "line-words")
    other = words.select(F.col("k").alias("hk"), F.col("line").alias("hline"), F.col("m").alias("hm"))
    both = join_on_keys(join_on_keys(pairs, words, LINE), other, ["hk", "hline"])
    common = F.size(F.array_intersect("m", "hm"))
    return both.where(100 * common >= PERCENT * (F.size("m") + F.size("hm") - common)).select(*LINE).distinct()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``k``, ``t`` (of the text) and ``removed`` (places from 0) of the documents that hold a line which an earlier
    line matches; ``docs``: ``k``, ``text``. The table is written, all others are deleted."""
    with scratch_scope() as scope:
        with scratch_scope():
            # Hashes hardly repeat within a file, so a dictionary of them is only built to be given up.
            sets = settle(line_sets(docs), "line-sets", **{"parquet.enable.dictionary": "false"})
            classes = scope.keep(classes_of(described(sets, word_levels(sets))), "line-classes")
            # Of equal sets all but the first go.
            copies = scope.keep(join_on_keys(sets.select(*LINE), classes.select(*LINE), LINE, how="left_anti"), "line-copies")
        found = settle(_lists(classes), "line-lists")
        near = found.where("near IS NOT NULL").select(F.struct(*LINE).alias("one"), F.explode("near").alias("two"))
        near = near.select(F.greatest("one", "two").alias("a"), F.least("one", "two").alias("b"))
        near = near.select("a.k", "a.line", F.col("b.k").alias("hk"), F.col("b.line").alias("hline"))
        lists = found.where("near IS NULL")
        # Of the heads in all its lists a set takes the one it meets most often.
        met = lists.where("h IS NOT NULL").groupBy(*LINE, F.col("h.k").alias("hk"), F.col("h.line").alias("hline")).agg(F.count(F.lit(1)).alias("c"))
        stars = met.groupBy(*LINE).agg(F.min(F.struct((-F.col("c")).alias("c"), F.col("hk"), F.col("hline"))).alias("h"))
        stars = settle(stars.select(*LINE, "h.hk", "h.hline"), "line-heads")
        direct = _earlier(lists.where("h IS NULL"), lists)
        pairs = settle(stars.union(direct).union(near).distinct(), "line-pairs")
        gone = settle(_verified(pairs, docs), "line-matches")
        # Sets whose head failed meet all earlier sets of their lists.
        failed = settle(join_on_keys(stars.select(*LINE), gone, LINE, how="left_anti"), "line-open")
        again = _earlier(join_on_keys(lists.where("h IS NOT NULL"), failed, LINE, how="left_semi"), lists)
        again = settle(join_on_keys(again, pairs, [*LINE, "hk", "hline"], how="left_anti"), "line-more-pairs")
        gone = settle(gone.union(_verified(again, docs)).distinct(), "line-gone")
        lost = gone.union(copies)
        at = F.col("line").bitwiseAND((1 << 31) - 1)
        lost = lost.groupBy("k", (F.col("line") - at).alias("t")).agg(F.sort_array(F.collect_set(at.cast("int"))).alias("removed"))
        return scope.result(lost, "line-lost")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``n_lines``, ``n_removed`` and ``removed`` (places from 0) of every document."""
    docs = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    lost = repeated_lines(docs)
    counts = docs.select("k", text_number(F.col("text")).alias("t"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = join_on_keys(counts, lost, ["k", "t"], how="left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select(F.col("k").alias(key), F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, columns unchanged, with their repeated lines taken out of the text."""
    plain = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    lost = repeated_lines(plain)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("k"), text_number(F.col(text).cast("string")).alias("t"))
    joined = join_on_keys(rows, lost, ["k", "t"], how="left")
    held = F.col("row")[text]
    kept = F.filter(F.split(held, "\n"), lambda s, i: ~F.array_contains("removed", i))
    new = F.when(F.col("removed").isNull(), held).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
