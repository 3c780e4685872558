"""Repeated passages across documents, found by recompression.

Round by round, runs of one symbol and then pairs of neighbours become new symbols. A symbol's name is
a fingerprint of what it was made of and the round, and the side of a pair that a symbol can stand
on is a bit of its name, so all tasks name alike without a shared dictionary, and equal passages
get equal symbols but for their edges. For each symbol the words are tracked that decided its making:
a symbol whose deciding words lie inside a window appears in every document that holds the window.

1. Each window of ``WINDOW`` words takes the least name among the longer symbols decided inside it; windows
   in a row with one name form a segment. Windows without a decided symbol (long repetitions, for
   example) take a fingerprint of their words instead.
2. Names are counted; only names in two documents go on. Segments of a name that are equal as a
   whole need no more than the least document that holds them.
3. Segments that share a name but differ (the edges of a shared passage) are verified window by
   window, one representative for equal segments.

A window is removed when its words also start in a document with a smaller id; a word when a removed
window covers it. Windows are judged on the input. Null and empty texts have no words. Documents
without an id neither lose words nor cause loss; rows with one id never cause loss to each other.
Equality is that of pairs of 64-bit fingerprints (a name and a segment or window), over 2^100 to one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.keys import join_on_keys
from tallyfold.session import settle

from .batches import bounded_batches, frugal, slices
from .fingerprints import Words, mix, prefix_sums, span, words_of

WINDOW = 50
#: Rounds, and the most words of a symbol.
ROUNDS, MOST_WORDS = 5, 10
#: Symbols of fewer words name a segment only where there is no longer one.
TELLING_WORDS = 4
SLICE = 1 << 20
#: Stands for words out of reach: what depends on them is decided inside no window.
FAR = np.int64(1) << 40


class Symbols:
    """Symbols of some texts: name, first word, end, and the words ``low`` to ``high`` that decided them."""

    def __init__(self, words: Words):
        n = len(words.hashes)
        self.words = self.name = words.hashes
        self.start = np.arange(n, dtype=np.int64)
        self.end = self.start + 1
        self.low, self.high = self.start.copy(), self.end.copy()
        self.text = np.repeat(np.arange(len(words.first) - 1), words.counts())
        self.first = words.first

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Deciding words of the symbols before and after; the edge of a text lies outside all its windows."""
        joined = self.text[1:] == self.text[:-1]
        low_before, high_before = self.first[self.text] - 1, self.high.copy()
        low_before[1:] = np.where(joined, self.low[:-1], low_before[1:])
        high_before[1:] = np.where(joined, self.high[:-1], high_before[1:])
        low_after, high_after = self.low.copy(), self.first[self.text + 1] + 1
        low_after[:-1] = np.where(joined, self.low[1:], low_after[:-1])
        high_after[:-1] = np.where(joined, self.high[1:], high_after[:-1])
        return low_before, high_before, low_after, high_after

    def apart(self) -> tuple[np.ndarray, np.ndarray]:
        """Words that show that the symbol before and the symbol after are another one.

        One word is enough where the word before differs from the symbol's last word, or the word after
        from its first; else it takes all that decided the neighbour.
        """
        low_before, _, _, high_after = self.neighbours()
        before, after = np.maximum(self.start - 1, 0), np.minimum(self.end, len(self.words) - 1)
        joined = self.text[1:] == self.text[:-1]
        follows, leads = np.concatenate([[False], joined]), np.concatenate([joined, [False]])
        low = np.where((self.words[before] != self.words[self.end - 1]) & follows, self.start - 1, low_before)
        high = np.where((self.words[after] != self.words[self.start]) & leads, self.end + 1, high_after)
        return low, high

    def take(self, keep: np.ndarray, name, end, low, high) -> None:
        """Keeps the symbols at ``keep`` with new values."""
        self.start, self.text = self.start[keep], self.text[keep]
        self.name, self.end, self.low, self.high = name, end, low, high

    def merge_runs(self, level: int) -> None:
        """Runs of one symbol become one, unless that would have more than MOST_WORDS words."""
        n = len(self.name)
        if n < 2:
            return
        same = (self.name[1:] == self.name[:-1]) & (self.text[1:] == self.text[:-1])
        low_before, high_after = self.apart()
        if not same.any():
            # That no run begins or ends here was decided by both neighbours.
            self.low, self.high = np.minimum(self.low, low_before), np.maximum(self.high, high_after)
            return
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        last = np.concatenate([first[1:], [n]]) - 1
        count = last - first + 1
        words = (self.end[first] - self.start[first]) * count
        merge = (count > 1) & (words <= MOST_WORDS)
        low = np.minimum(low_before[first], self.low[first])
        high = np.maximum(high_after[last], self.high[last])
        run = np.repeat(np.arange(len(first)), count)
        long = (count > 1) & ~merge
        # How much of a long run decides for a member depends on where the run begins: never settled.
        at = np.arange(n)
        low_all = np.where(long, -FAR, low)[run]
        high_all = np.where(long, FAR, high)[run]
        with np.errstate(over="ignore"):
            made = mix(self.name[first] * np.uint64(0xA0761D6478BD642F) + count.astype(np.uint64) * np.uint64(2 * level + 1))
        name = np.where(merge[run], made[run], self.name)
        end = np.where(merge[run], self.end[last][run], self.end)
        keep = np.flatnonzero(~merge[run] | (at == first[run]))
        self.take(keep, name[keep], end[keep], low_all[keep], high_all[keep])

    def merge_pairs(self, level: int) -> None:
        """A left symbol and the right symbol after it become one, up to MOST_WORDS words."""
        n = len(self.name)
        if n < 2:
            return
        with np.errstate(over="ignore"):
            left = (mix(self.name + np.uint64(level + 1) * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(17)) & np.uint64(1) == 1
        joined = self.text[1:] == self.text[:-1]
        pair = np.zeros(n, bool)
        pair[:-1] = left[:-1] & ~left[1:] & joined & (self.end[1:] - self.start[:-1] <= MOST_WORDS)
        second = np.concatenate([[False], pair[:-1]])
        low_before, high_before, low_after, high_after = self.neighbours()
        # A left symbol was judged with the one after it, a right symbol with the one before it.
        low = np.minimum(self.low, np.where(left, low_after, low_before))
        high = np.maximum(self.high, np.where(left, high_after, high_before))
        after = np.minimum(np.arange(n) + 1, n - 1)
        with np.errstate(over="ignore"):
            made = mix(self.name * np.uint64(0x8EBC6AF09C88C6E3) + mix(self.name[after]) + np.uint64(level))
        name = np.where(pair, made, self.name)
        end = np.where(pair, self.end[after], self.end)
        keep = np.flatnonzero(~second)
        self.take(keep, name[keep], end[keep], low[keep], high[keep])


def recompress(words: Words) -> Symbols:
    symbols = Symbols(words)
    for level in range(ROUNDS):
        symbols.merge_runs(level)
        symbols.merge_pairs(level)
    return symbols


def segments(words: Words, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Text, name, fingerprint, first and last window start (in words of the text) of each segment."""
    counts = words.counts()
    starts_in = np.maximum(counts - window + 1, 0)
    total = int(starts_in.sum())
    if not total:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, nothing, nothing
    text = np.repeat(np.arange(len(counts)), starts_in)
    place = np.arange(total) - np.repeat(np.cumsum(starts_in) - starts_in, starts_in)
    at = words.first[:-1][text] + place
    symbols = recompress(words)
    settled = np.flatnonzero((symbols.low > -FAR) & (symbols.high < FAR))
    rank = symbols.name[settled] >> np.uint64(1)
    rank |= ((symbols.end - symbols.start)[settled] < TELLING_WORDS).astype(np.uint64) << np.uint64(63)
    # Deciding words grow with the symbols, so the symbols decided inside a window are neighbours.
    low, high = symbols.low[settled], symbols.high[settled]
    begin = np.searchsorted(low, at, "left")
    end = np.searchsorted(high, at + window, "right")
    sums = prefix_sums(words.hashes)
    name = np.empty(total, np.uint64)
    some = begin < end
    if some.any():
        bounds = np.stack([begin[some], end[some]], 1).ravel()
        padded = np.concatenate([rank, [np.uint64(2**64 - 1)]])
        name[some] = np.minimum.reduceat(padded, bounds)[::2]
    if not some.all():
        name[~some] = mix(span(sums, at[~some], at[~some] + window))
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [total]]) - 1
    digest = span(sums, at[first], at[last] + window)
    return text[first], name[first].view(np.int64), digest.view(np.int64), place[first], place[last]


def packed_texts(docs: DataFrame) -> DataFrame:
    """Id, fingerprint and compressed text of every document; rows alike in the first two are alike."""
    fields = f"k {dict(docs.dtypes)['k']}, t long, z binary"

    @frugal
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch):
                packed = [squeeze((t or "").encode()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("t"), pa.array(packed, pa.binary())], ["k", "t", "z"])

    return bounded_batches(docs.select("k", "t", "text")).mapInArrow(pack, fields)


def unpacked(z: pa.Array) -> pa.Array:
    open_up = zstandard.ZstdDecompressor().decompress
    return pa.array([open_up(b) for b in z.to_pylist()], pa.binary())


def _find_segments(docs: DataFrame) -> DataFrame:
    """``name``, ``digest``, ``k``, ``t``, ``first`` and ``last`` of the segments of every document with an id."""
    kind = dict(docs.dtypes)["k"]
    names = ["name", "digest", "k", "t", "first", "last"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                text, name, digest, first, last = segments(words_of(part.column("text")))
                at = pa.array(text, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(name, pa.int64()), pa.array(digest, pa.int64()), part.column("k").take(at), part.column("t").take(at),
                    pa.array(first, pa.int32()), pa.array(last, pa.int32())], names)

    return docs.where("k IS NOT NULL").mapInArrow(find, f"name long, digest long, k {kind}, t long, first int, last int")


def _window_rows(held: DataFrame) -> DataFrame:
    """``name``, ``window``, ``digest``, ``place`` and ``k`` of every window of the segments in ``parts``."""
    kind = dict(held.dtypes)["k"]
    names = ["name", "window", "digest", "place", "k"]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                sums = prefix_sums(words_of(unpacked(one.column("z"))).hashes)
                parts = one.column("parts")[0].as_py()
                first = np.array([p["first"] for p in parts])
                count = np.array([p["last"] for p in parts]) - first + 1
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = np.repeat(first, count) + place
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([p["name"] for p in parts], count), pa.int64()),
                    pa.array(span(sums, at, at + WINDOW).view(np.int64), pa.int64()),
                    pa.array(np.repeat([p["digest"] for p in parts], count), pa.int64()), pa.array(place, pa.int32()),
                    pa.array(one.column("k").to_pylist() * len(place), one.schema.field("k").type)], names)

    return held.select("k", "z", "parts").mapInArrow(spell, f"name long, window long, digest long, place int, k {kind}")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``k``, ``t``, ``first``, ``last``: starts of windows that also start in a document with a smaller id."""
    found = settle(_find_segments(docs), "segments")
    names = found.groupBy("name").agg(
        F.min("k").alias("least"), F.max("k").alias("most"), F.min("digest").alias("d0"), F.max("digest").alias("d1"))
    names = settle(names.where("least < most").select("name", "least", (F.col("d0") == F.col("d1")).alias("alike")), "names")
    shared = settle(join_on_keys(found, names, ["name"], never_null=()), "shared-segments")
    # One text for all segments of the name: all but the least document lose it.
    alike = shared.where("alike AND k > least").select("k", "t", "first", "last")
    mixed = shared.where("NOT alike")
    reps = mixed.groupBy("name", "digest").agg(F.min(F.struct("k", "t", "first", "last")).alias("r"))
    reps = settle(reps.select("name", "digest", "r.*"), "segment-representatives")
    parts = reps.groupBy("k", "t").agg(F.collect_list(F.struct("name", "digest", "first", "last")).alias("parts"))
    held = join_on_keys(packed_texts(docs).dropDuplicates(["k", "t"]), parts, ["k", "t"])
    spelled = settle(_window_rows(held), "windows")
    least = spelled.groupBy("name", "window").agg(F.min("k").alias("least"))
    earlier = join_on_keys(spelled, least, ["name", "window"]).where("least < k").select("name", "digest", "place")
    earlier = settle(earlier.groupBy("name", "digest").agg(F.collect_set("place").alias("places")), "earlier-windows")
    owners = reps.select("name", "digest", F.col("k").alias("owner"))
    placed = join_on_keys(mixed, owners, ["name", "digest"])
    copies = placed.where("k > owner").select("k", "t", "first", "last")
    own = join_on_keys(placed.where("k = owner"), earlier, ["name", "digest"]).select("k", "t", "first", F.explode("places").alias("place"))
    own = own.select("k", "t", (F.col("first") + F.col("place")).alias("first"), (F.col("first") + F.col("place")).alias("last"))
    return alike.unionByName(copies).unionByName(own)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Key, ``n_words``, ``n_removed`` and ``kept_sha256`` of every document.

    ``with_text`` adds ``kept_text``, the kept words with one space between.
    """
    docs = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))
    cuts = repeated_windows(docs).groupBy("k", "t").agg(F.collect_list(F.struct("first", "last")).alias("cuts"))
    joined = join_on_keys(packed_texts(docs), cuts, ["k", "t"], how="left")
    kind = dict(docs.dtypes)["k"]
    names = ["k", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                counts, gone, digests, kept_texts = [], [], [], []
                for packed, lost in zip(part.column("z").to_pylist(), part.column("cuts").to_pylist()):
                    words = zstandard.ZstdDecompressor().decompress(packed).split()  # at space and 0x09 to 0x0D
                    keep = words
                    if lost:
                        cover = np.zeros(len(words) + 1, np.int64)
                        np.add.at(cover, [c["first"] for c in lost], 1)
                        np.add.at(cover, [c["last"] + WINDOW for c in lost], -1)
                        stays = np.cumsum(cover)[:-1] == 0
                        keep = [words[i] for i in np.flatnonzero(stays)]
                    kept = b" ".join(keep)
                    counts.append(len(words))
                    gone.append(len(words) - len(keep))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept)
                out = [part.column("k"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(kept_texts, pa.binary()).cast(pa.string())] * with_text, names)

    schema = f"k {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.select("k", "z", "cuts").mapInArrow(cut, schema).withColumnRenamed("k", key)
