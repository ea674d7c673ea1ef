"""Whole batches of text as numpy arrays: words, word hashes and shingles without a loop over words.

A word set is given as a table of 256 booleans over UTF-8 bytes, which is exact
for classes that hold either all or none of the non-ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 2 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table, true inside the given inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Everything but blank and tab to carriage return.
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Digits, letters a-z (after lower-casing A-Z) and all non-ASCII bytes.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of at most ``most`` text bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start bytes, end bytes, index of each row's first word plus the total) of all maximal runs of ``kind``."""
    inside = kind[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[first[first > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        n = max(n, 64)
        out = np.full(n, _BASE, np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; A-Z are lower-cased first if ``lower``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    within = np.arange(lengths.sum()) - np.repeat(firsts, lengths)
    taken = data[np.repeat(starts, lengths) + within]
    if lower:
        taken = _LOWER[taken]
    value = (taken.astype(np.uint64) + np.uint64(1)) * _power_table(int(lengths.max()))[within]
    return mix(np.add.reduceat(value, firsts) + lengths.astype(np.uint64) * _MULT)


def shingles(hashes: np.ndarray, firsts: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row, the sorted distinct hashes of its ``k``-word runs; the whole sequence if it has fewer words."""
    n = len(hashes)
    odd = mix(np.arange(1, k + 1, dtype=np.uint64) * _MULT) | np.uint64(1)
    if n >= k:
        total = hashes[: n - k + 1] * odd[0]
        for j in range(1, k):
            total = total + hashes[j : n - k + 1 + j] * odd[j]
        total = mix(total)
    else:
        total = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= k:
            one = np.sort(total[a : b - k + 1])
            out.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
        elif b > a:
            out.append(mix(np.array([(hashes[a:b] * odd[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class PairMap:
    """An open-addressed map from pairs of numbers below 2^31 to a number, looked up for whole arrays; -1: none."""

    def __init__(self, first: np.ndarray, second: np.ndarray, to: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(to)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        key = (first.astype(np.int64) << 32) | second
        slot = self._slot(key)
        left = np.arange(len(key))
        while len(left):
            at = slot[left]
            free = self.key[at] < 0
            won, where = np.unique(at[free], return_index=True)
            chosen = left[free][where]
            self.key[won], self.to[won] = key[chosen], to[chosen]
            left = np.setdiff1d(left, chosen, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (((key.astype(np.uint64) * _M1) ^ (key.astype(np.uint64) >> np.uint64(32)) * _M2) >> self.shift).astype(np.int64)

    def get(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = (first.astype(np.int64) << 32) | second
        slot = self._slot(key)
        found = self.key[slot]
        out = np.where(found == key, self.to[slot], -1)
        on = np.flatnonzero((found != key) & (found >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & self.mask
            found = self.key[slot[on]]
            hit = found == key[on]
            out[on[hit]] = self.to[slot[on[hit]]]
            on = on[~hit & (found >= 0)]
        return out
