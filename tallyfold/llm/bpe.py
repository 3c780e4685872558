"""BPE encoding by backtracking, and decoding through an offset table.

The merges of BPE need not be replayed. A sequence of tokens is the encoding of its text exactly
when each token encodes to itself and each neighbouring pair is compatible, that is, when encoding
the two together gives the two again. So the encoder walks a word from the left with the longest
token that an Aho-Corasick automaton finds there, steps back where a pair is incompatible, and marks
positions at which no encoding can end. Each position is left at most once per token that starts
there, so time is linear in the word. Compatibility is read off the merge table: undo the later
of the two merges at the seam until either a merge across the seam would have come first
(incompatible) or nothing is left to undo.

Empty and null texts give no ids. A literal special token in a text is that token, as in the
library. Only the id and the text column are read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import bounded_batches, frugal, slices, texts

END = "￿"
WORD_END = "</w>"
#: Bytes of remembered chunks and letter runs of a worker; when full they are forgotten at once. Longer ones are
#: not remembered. An entry counts with what the two objects and their place in the table take besides.
CHUNK_BYTES, PIECE_BYTES, LONGEST, ENTRY = 64 << 20, 40 << 20, 64, 190
PAIR_CACHE = 400_000


class Remembered(dict):
    """Packed ids by text, of bounded size in bytes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.held = limit, 0

    def keep(self, text: str, ids: bytes) -> bytes:
        if len(text) <= LONGEST:
            if self.held > self.limit:
                self.forget()
            self.held += ENTRY + 2 * len(text) + len(ids)
            self[text] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.held = 0


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """A word-end BPE vocabulary file of the tokenizers library.

    Its normalizer (NFC, white space to one space, lower case) and splitter are those of the file.
    """

    def __init__(self, source: bytes):
        import ahocorasick
        import regex

        file = json.loads(source)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        pattern = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.split = regex.compile(pattern).findall
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.letters = byte_letters()

        # Tokens are numbered by the order of their merges: single letters first.
        left, right, rank = {}, {}, {}
        for i, (a, b) in enumerate(pairs):
            token = vocab[a + b]
            rank[vocab[a], vocab[b]] = i
            left[token], right[token] = vocab[a], vocab[b]
        self.left, self.right, self.rank = left, right, rank
        self.merged = {vocab[a + b]: i for i, (a, b) in enumerate(pairs)}
        self.compatible: dict[tuple[int, int], bool] = {}

        automaton = ahocorasick.Automaton()
        for text, token in vocab.items():
            marked = text[: -len(WORD_END)] + END if text.endswith(WORD_END) else text
            # A token whose own merges are not compatible is never the result of encoding.
            if self._whole(token):
                automaton.add_word(marked, (len(marked), token))
        automaton.make_automaton()
        self.matches = automaton.iter
        self.chunks, self.pieces = Remembered(CHUNK_BYTES), Remembered(PIECE_BYTES)

        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pieces = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def _whole(self, token: int) -> bool:
        """Whether the two parts of a token are encodings that its own merge joins first."""
        if token not in self.left:
            return True
        if not (self._whole(self.left[token]) and self._whole(self.right[token])):
            return False
        return self._fits(self.left[token], self.right[token], self.merged[token])

    def _fits(self, a: int, b: int, limit: float) -> bool:
        """Whether no merge across the seam of ``a`` and ``b`` comes before ``limit``.

        Undoing the later merge on either side shows the symbols that stood at the seam earlier;
        a merge of those across the seam must not come before the merge that was undone.
        """
        merged, rank = self.merged, self.rank
        while True:
            across = rank.get((a, b))
            if across is not None and across < limit:
                return False
            at_a, at_b = merged.get(a, -1), merged.get(b, -1)
            if at_a < 0 and at_b < 0:
                return True
            # Of equal symbols the left one is merged first, so the right one is undone first.
            if at_a > at_b:
                limit, a = at_a, self.right[a]
            else:
                limit, b = at_b + 1, self.left[b]

    def _pair(self, a: int, b: int) -> bool:
        found = self.compatible.get((a, b))
        if found is None:
            if len(self.compatible) >= PAIR_CACHE:
                self.compatible.clear()
            found = self.compatible[a, b] = self._fits(a, b, float("inf"))
        return found

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in byte letters with the end mark."""
        n = len(word)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.matches(word):
            starts[end + 1 - match[0]].append(match)  # the longest comes last
        pair, closed = self._pair, bytearray(n + 1)
        ids: list[int] = []
        path: list[tuple[int, int]] = []  # length and choice of each token
        at, choice = 0, len(starts[0]) - 1
        while at < n:
            if choice < 0:
                closed[at] = 1
                length, choice = path.pop()
                ids.pop()
                at -= length
                choice -= 1
                continue
            length, token = starts[at][choice]
            if closed[at + length] or (ids and not pair(ids[-1], token)):
                choice -= 1
                continue
            ids.append(token)
            path.append((length, choice))
            at += length
            choice = len(starts[at]) - 1 if at < n else 0
        return ids

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if piece.isascii() and piece.isprintable():
                word = piece
            else:
                letters = self.letters
                word = "".join([letters[b] for b in piece.encode()])
            found = self.pieces.keep(piece, np.array(self.encode_word(word + END), "<u4").tobytes())
        return found

    def _chunk(self, chunk: str) -> bytes:
        """Packed ids of a text without spaces and line feeds."""
        out = []
        for part in self.special_split(chunk) if "<|" in chunk else (chunk,):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            if not part.isascii():
                # Letter by letter: the library has no special case for a sigma that ends a word.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            out += map(self._piece, self.split(part.lower()))
        return self.chunks.keep(chunk, b"".join(out))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        Spaces and line feeds end a word in every rule of the file and compose with nothing, so
        the chunks between them can be encoded, and remembered, one by one.
        """
        known, out = self.chunks.get, []
        for chunk in text.replace("\n", " ").split(" "):
            if chunk:
                ids = known(chunk)
                out.append(self._chunk(chunk) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text: the tokens with one space between, gathered by their offsets."""
        if not len(ids):
            return b""
        begin = self.offsets[ids]
        length = self.offsets[ids + 1] - begin
        ends = np.cumsum(length)
        index = np.arange(ends[-1]) + np.repeat(begin - (ends - length), length)
        return self.bytes[index].tobytes()[:-1]


_LOADED: dict[str, WordBpe] = {}


def loaded(key: str, source: bytes) -> WordBpe:
    """The vocabulary, built once in each Python worker."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(source)
    return _LOADED[key]


def encode_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every text: key, ``n_tokens``, ``ids`` (array of int).

    ``vocabulary`` is a path on the driver; the file, whose size does not depend on the data, is
    sent to the executors once. Rows are handled one by one, without a shuffle.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        source = f.read()
    name, sent = hashlib.sha256(source).hexdigest(), spark.sparkContext.broadcast(source)
    docs = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    schema = f"k {dict(docs.dtypes)['k']}, n_tokens long, ids array<int>"

    @frugal
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(name, sent.value)
        for batch in batches:
            for part in slices(batch):
                packed = [bpe.encode(t) for t in texts(part)]
                counts = [len(p) // 4 for p in packed]
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(packed), "<i4"))
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(counts, pa.int64()), ids], ["k", "n_tokens", "ids"])

    return bounded_batches(docs).mapInArrow(encode, schema).withColumnRenamed("k", key)


def token_digests(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Encodes and decodes every text: key, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded text
    in UTF-8; ``with_ids`` adds the ids themselves. Encoding and decoding share one pass.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        source = f.read()
    name, sent = hashlib.sha256(source).hexdigest(), spark.sparkContext.broadcast(source)
    docs = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    fields = f"k {dict(docs.dtypes)['k']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = ["k", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    @frugal
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(name, sent.value)
        sha = hashlib.sha256
        for batch in batches:
            for part in slices(batch):
                packed = [bpe.encode(t) for t in texts(part)]
                counts = [len(p) // 4 for p in packed]
                columns = [
                    part.column("k"), pa.array(counts, pa.int64()),
                    pa.array([sha(p).hexdigest() for p in packed], pa.string()),
                    pa.array([sha(bpe.decode(np.frombuffer(p, "<u4"))).hexdigest() for p in packed], pa.string()),
                ]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays(columns, names)

    return bounded_batches(docs).mapInArrow(digest, fields + ", ids array<int>" * with_ids).withColumnRenamed("k", key)


def decode_ids(ids: Column, vocabulary: str) -> Column:
    """Text of an array of ids, special tokens included; null stays null."""
    with open(vocabulary, "rb") as f:
        source = f.read()
    name = hashlib.sha256(source).hexdigest()
    sent = SparkSession.active().sparkContext.broadcast(source)

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        bpe = loaded(name, sent.value)
        return values.map(lambda v: None if v is None else bpe.decode(np.asarray(v, np.int64)).decode())

    return decode(ids)
