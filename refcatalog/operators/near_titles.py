"""Pairs of similar titles, by blocks: a task compares two blocks of titles as arrays, and every two blocks whose lengths allow a pair meet in one.

Two titles of m and n characters are similar if their edits, m + n - 2 * LCS
single-character insertions and deletions, are at most a share of m + n. Each edit
flips at most one bit of a title's characters, and three of its pairs of
characters, so counting bits that differ rules most pairs out, and the longest
common subsequence decides the rest. No pair is lost and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written

#: Characters of a block at most, about; smaller blocks, down to ``FEW`` characters, are cut as long as there are fewer than ``BLOCKS``.
MOST, FEW, BLOCKS = 1 << 22, 1 << 18, 12
#: Rows and columns that are compared at once, and pairs whose subsequences are counted at once.
ROWS, COLUMNS, PAIRS = 16, 1 << 14, 1 << 15
#: Cells of a table of character masks at most.
CELLS = 1 << 21
#: Words of 64 bits for characters and for pairs of characters.
SINGLES, DOUBLES = 2, 4


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _codes(titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all titles, and how many each has."""
    return np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, titles), np.int64, len(titles))


def _bits(items: np.ndarray, row: np.ndarray, rows: int, words: int) -> np.ndarray:
    """(rows, words): a bit for each item of a row and its how-manieth occurrence there, by turns on and off where several share one."""
    order = np.lexsort((items, row))
    items, row = items[order], row[order]
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (row[1:] != row[:-1])
    nth = np.arange(len(items)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    bit = _mix(_mix(items) + nth.astype(np.uint64)) % np.uint64(64 * words)
    out = np.zeros((rows, words), np.uint64)
    np.bitwise_xor.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def signatures(titles: list[str]) -> list[bytes]:
    codes, n = _codes(titles)
    codes, row = codes.astype(np.uint64), np.repeat(np.arange(len(n)), n)
    inside = row[1:] == row[:-1]
    both = (codes[:-1] << np.uint64(32) | codes[1:])[inside]
    out = np.concatenate([_bits(codes, row, len(n), SINGLES), _bits(both, row[1:][inside], len(n), DOUBLES)], axis=1)
    return [x.tobytes() for x in out]


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        yield p.assign(s=signatures(p.t.tolist()))


@dataclass
class Block:
    """Titles sorted by length."""

    k: np.ndarray
    t: list[str]
    n: np.ndarray
    singles: list[np.ndarray]
    doubles: list[np.ndarray]


def _block(p: pd.DataFrame) -> Block:
    p = p.sort_values("n", kind="stable")
    words = np.frombuffer(b"".join(p.s), np.uint64).reshape(len(p), SINGLES + DOUBLES)
    each = [np.ascontiguousarray(words[:, i]) for i in range(SINGLES + DOUBLES)]
    return Block(p.k.to_numpy(), p.t.tolist(), p.n.to_numpy(np.int64), each[:SINGLES], each[SINGLES:])


def _within_reach(a: Block, b: Block, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) whose lengths and bits allow them to be similar; of one block with itself each pair once."""
    far = 100 - percent
    x, y = np.empty((ROWS, COLUMNS), np.uint64), np.empty((ROWS, COLUMNS), np.uint8)
    z = np.empty((ROWS, COLUMNS), np.uint8)
    for i in range(0, len(a.n), ROWS):
        j = min(i + ROWS, len(a.n))
        first = np.searchsorted(b.n, a.n[i] * percent // (100 + far))
        last = np.searchsorted(b.n, -(-a.n[j - 1] * (100 + far) // percent), "right")
        if a is b:
            first = max(first, i)
        for c in range(first, last, COLUMNS):
            d = min(c + COLUMNS, last)
            at = (slice(0, j - i), slice(0, d - c))
            xs, ys, zs = x[at], y[at], z[at]
            for w in range(SINGLES):
                np.bitwise_xor(a.singles[w][i:j, None], b.singles[w][None, c:d], out=xs)
                np.bitwise_count(xs, out=ys if w == 0 else zs)
                if w:
                    np.add(ys, zs, out=ys)
            most = min((a.n[j - 1] + b.n[d - 1]) * far // 100, 255)
            p, q = np.nonzero(ys <= most)
            if not len(p):
                continue
            own = ys[p, q]
            p, q = p + i, q + c
            most = (a.n[p] + b.n[q]) * far // 100
            keep = own <= most
            if a is b:
                keep &= p < q
            p, q, most = p[keep], q[keep], most[keep]
            differ = sum(np.bitwise_count(u[p] ^ v[q]).astype(np.int64) for u, v in zip(a.doubles, b.doubles, strict=True))
            keep = differ <= 3 * most
            yield p[keep], q[keep]


class _Common:
    """Lengths of longest common subsequences of rows of two blocks, bit-parallel over many pairs at a time."""

    def __init__(self, a: Block, b: Block):
        self.a, self.b = a, b
        own, other = _codes(a.t)[0], _codes(b.t)[0]
        known = np.zeros(max(own.max(initial=0), other.max(initial=0)) + 1, bool)
        known[own] = known[other] = True
        place = np.cumsum(known, dtype=np.int64) - 1
        self.kinds = int(known.sum()) + 1
        self.own, self.starts = place[own], np.concatenate([[0], np.cumsum(a.n)])
        self.other = np.full((len(b.n), b.n.max(initial=0)), self.kinds - 1, np.int32)
        self.other[np.arange(self.other.shape[1]) < b.n[:, None]] = place[other]

    def __call__(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of each pair, sorted by ``p``."""
        out = np.zeros(len(p), np.int64)
        words = int(self.a.n[p].max(initial=1) + 63) // 64
        rows, nth = np.unique(p, return_inverse=True)
        step = max(1, CELLS // (self.kinds * words))
        for r in range(0, len(rows), step):
            some = rows[r : r + step]
            lo, hi = np.searchsorted(nth, [r, r + len(some)])
            masks = np.zeros((len(some) * self.kinds, words), np.uint64)
            size = self.a.n[some]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            code = self.own[np.repeat(self.starts[some], size) + at]
            np.bitwise_or.at(masks, (np.repeat(np.arange(len(some)), size) * self.kinds + code, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
            for s in range(lo, hi, PAIRS):
                e = min(s + PAIRS, hi)
                out[s:e] = self._count(masks, (nth[s:e] - r) * self.kinds, q[s:e], self.a.n[p[s:e]], words)
        return out

    def _count(self, masks: np.ndarray, base: np.ndarray, q: np.ndarray, size: np.ndarray, words: int) -> np.ndarray:
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        v = [np.full(len(q), full) for _ in range(words)]
        text = np.ascontiguousarray(self.other[q, : self.b.n[q].max(initial=0)].T)
        for codes in text:
            at, carry = base + codes, None
            for w in range(words):
                m = masks[at, w]
                u = v[w] & m
                total = v[w] + u
                if words > 1:
                    over = total < u
                    if carry is not None:
                        total = total + carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                v[w] = total | (v[w] & ~m)
        common = size.copy()
        for w in range(words):
            left = np.clip(size - 64 * w, 0, 64)
            mask = np.where(left == 64, full, (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1))
            common -= np.bitwise_count(v[w] & mask)
        return common


def _similar(a: Block, b: Block, percent: int) -> Iterator[pd.DataFrame]:
    """(a, b, score) of the similar pairs of two blocks, in bounded pieces."""
    if not len(a.n) or not len(b.n):
        return
    common, held, count = _Common(a, b), [], 0

    def settled() -> pd.DataFrame:
        p, q = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        order = np.argsort(p, kind="stable")
        p, q = p[order], q[order]
        n, total = common(p, q), a.n[p] + b.n[q]
        fit = 200 * n >= percent * total
        return pd.DataFrame({"a": a.k[p[fit]], "b": b.k[q[fit]], "score": 200.0 * n[fit] / total[fit]})

    for pair in _within_reach(a, b, percent):
        held.append(pair)
        count += len(pair[0])
        if count >= 4 * PAIRS:
            yield settled()
            held, count = [], 0
    if count:
        yield settled()


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Block, Block]]:
    """The two blocks of each cell, from rows sorted by cell; the same block twice where a block meets itself."""
    cell, held = None, []

    def both() -> tuple[Block, Block]:
        p = pd.concat(held)
        left = _block(p[p.side == 0])
        return left, left if cell[4] else _block(p[p.side == 1])

    for batch in batches:
        for key, part in batch.groupby(["g", "i", "h", "j", "own"], sort=True):
            if key != cell and held:
                yield both()
                held = []
            cell = key
            held.append(part)
    if held:
        yield both()


def near(left: DataFrame, right: DataFrame | None = None, percent: int = 90, best: str | None = None) -> DataFrame:
    """(a, b, score) of the similar titles of ``left`` and ``right`` (k, t: whole numbers and distinct titles that aren't empty); without ``right`` the pairs within ``left``, a > b, each once.

    ``best`` keeps one row of each b: of its smallest a (``first``), or of its highest score, of equals the smallest a (``closest``).
    """
    ratio = log(1.01 * (200 - percent) / percent)  # titles that may be similar lie in one band of lengths or in neighbouring ones
    sided = left.select(F.lit(0).alias("side"), "k", "t")
    if right is not None:
        sided = sided.unionByName(right.select(F.lit(1).alias("side"), "k", "t"))
    sized = sided.select("side", "k", "t", F.length("t").alias("n"))
    rows = written(sized.mapInPandas(_signed, "side int, k long, t string, n int, s binary").withColumn("g", F.floor(F.log("n") / ratio).cast("int")))
    alone = right is None
    known: dict[int, dict[int, int]] = {0: {}, 1: {}}
    for r in rows.groupBy("side", "g").agg(F.sum("n").alias("n")).collect():  # a row a band
        known[r["side"]][r["g"]] = max(-(-r["n"] // MOST), min(BLOCKS, -(-r["n"] // FEW)))
    if right is None:
        known[1] = known[0]

    def blocks(side: int, band: str) -> str:
        told = ", ".join(f"{g}, {n}" for g, n in known[side].items())
        return f"coalesce(try_element_at(map({told}), {band}), 0)" if told else "0"

    def meets(side: int, step: int, own: str = "true") -> str:
        """The cells of a row of ``side`` with the blocks of the other side's band ``step`` on."""
        n = blocks(1 - side, f"g + {step}")
        ends = ("g", "at", f"g + {step}", "x") if side == 0 else (f"g + {step}", "x", "g", "at")
        cell = f"struct({side} as side, {ends[0]} as g, {ends[1]} as i, {ends[2]} as h, {ends[3]} as j, false as own)"
        return f"transform(filter(if({n} > 0, sequence(0, {n} - 1), cast(array() as array<int>)), x -> {own}), x -> {cell})"

    if right is None:
        first = f"array(struct(0 as side, g, at as i, g as h, at as j, true as own)), {meets(0, 0, 'x > at')}, {meets(0, 1)}, {meets(1, 0, 'x < at')}, {meets(1, -1)}"
        dealt = rows.withColumn("at", F.expr(f"cast(pmod(xxhash64(t), {blocks(0, 'g')}) as int)")).selectExpr("k", "t", "n", "s", f"inline(concat({first}))")
    else:
        cut = rows.withColumn("at", F.expr(f"cast(pmod(xxhash64(t), if(side = 0, {blocks(0, 'g')}, {blocks(1, 'g')})) as int)"))
        each = [", ".join(meets(side, step) for step in (-1, 0, 1)) for side in (0, 1)]
        dealt = cut.selectExpr("k", "t", "n", "s", f"inline(if(side = 0, concat({each[0]}), concat({each[1]})))")
    width = sum(n * sum(known[1].get(g + d, 0) for d in (-1, 0, 1)) for g, n in known[0].items())
    width = max(1, min(width, 4096))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, b in _cells(batches):
            for p in _similar(a, b, percent):
                if best is not None:  # one row of each b and piece
                    p = p.sort_values(["a"] if best == "first" else ["score", "a"], ascending=[True] if best == "first" else [False, True]).drop_duplicates("b")
                elif alone:
                    p = p.assign(a=np.maximum(p.a, p.b), b=np.minimum(p.a, p.b))
                yield p

    cell = ["g", "i", "h", "j"]
    met = dealt.repartition(width, *cell).sortWithinPartitions(*cell).mapInPandas(run, "a long, b long, score double")
    if best is None:
        return met
    order = F.struct("a") if best == "first" else F.struct(-F.col("score"), F.col("a"))
    return met.groupBy("b").agg(F.min_by(F.struct("a", "score"), order).alias("x")).select("x.a", "b", "x.score")
