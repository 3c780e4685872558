"""Fingerprints of the words of many texts at once.

A word is a run of bytes other than space and 0x09 to 0x0D. Its fingerprint is a 64-bit polynomial
over random byte values, mixed; different words meet with probability about 2^-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEED = np.random.default_rng(20240607)
_VALUES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUES.copy()
_FOLDED[ord("A"): ord("Z") + 1] = _VALUES[ord("a"): ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1); up to a million are kept."""
    known = _POWERS.get(int(base))
    if known is not None and len(known) >= n:
        return known[:n]
    with np.errstate(over="ignore"):
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        made = np.multiply.accumulate(steps)
    if len(made) <= 2 << 20:
        _POWERS[int(base)] = made
    return made[:n]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values times powers of the base; ``span`` takes the polynomial of a part from them."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed fingerprints of the parts from ``start`` to ``end``."""
    with np.errstate(over="ignore"):
        part = (sums[end] - sums[start]) * powers(INVERSE, len(sums))[start]
        return mix(part + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def string_names(strings: list[str]) -> np.ndarray:
    """Fingerprints of whole strings."""
    held = pa.array(strings, pa.large_string())
    bounds = np.frombuffer(held.buffers()[1], np.int64)[: len(held) + 1] if len(held) else np.zeros(1, np.int64)
    data = held.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[: bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return span(prefix_sums(_VALUES[raw]), bounds[:-1], bounds[1:])


@dataclass
class Words:
    """Fingerprints of all words of some texts; those of text i are ``first[i]:first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray
    #: Byte spans of the words in ``raw``.
    starts: np.ndarray
    ends: np.ndarray
    raw: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: pa.Array, fold: bool = False) -> Words:
    """Words of an Arrow array of strings, null as empty; ``fold`` lower-cases A to Z."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0]: bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    n = len(raw)
    if not n:
        nothing = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), nothing, nothing, raw)
    letter = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], letter[:-1]]) & ~edge[:n]
    after = np.concatenate([letter[1:], [False]]) & ~edge[1:]
    starts = np.flatnonzero(letter & ~before)
    ends = np.flatnonzero(letter & ~after) + 1
    hashes = span(prefix_sums((_FOLDED if fold else _VALUES)[raw]), starts, ends)
    return Words(hashes, np.searchsorted(starts, bounds), starts, ends, raw)
