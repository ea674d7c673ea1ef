"""Token counts of a BPE vocabulary by rank-synchronous merging of ragged arrays.

All distinct pre-tokens of a batch lie in one array of symbols. In each round
every pre-token merges all occurrences of its best-ranked pair at once; the
symbols that survive are its tokens. Where merging them all at once could differ
from the library's order (a merge would make a better-ranked pair, or ranks are
tied), only the leftmost one is merged in that round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import PairMap, slices

#: Bytes of distinct pre-tokens that a worker remembers, with 100 for the entry of each.
REMEMBERED = 60 << 20
_SPACE = "▁"


class PieceRanks:
    """Symbols, merge ranks and token costs of a sentencepiece BPE model with byte fallback."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if sp.normalize("a b  c\n") not in (f"{_SPACE}a{_SPACE}b{_SPACE}{_SPACE}c\n",):
            raise ValueError("only models without normalisation, with a leading space added, are handled")
        size = sp.vocab_size()
        if any(sp.is_unused(i) for i in range(size)) or not any(sp.is_byte(i) for i in range(size)):
            raise ValueError("only models with byte fallback and without unused pieces are handled")
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        symbols = list(dict.fromkeys([*pieces, *(c for p in pieces for c in p)]))
        number = {s: i for i, s in enumerate(symbols)}
        #: The four last symbols are unknown characters of 1 to 4 bytes.
        self.cost = np.array([1 if s in pieces else len(s.encode()) for s in symbols] + [1, 2, 3, 4], np.int64)
        n = len(symbols)
        self.char = np.full(0x110000, n + 3, np.int64)
        self.char[:0x10000], self.char[:0x800], self.char[:0x80] = n + 2, n + 1, n
        for c, i in number.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        levels = sorted({-v for v in pieces.values()})
        rank = {v: i for i, v in enumerate(levels)}
        counts = np.bincount([rank[-v] for p, v in pieces.items() if len(p) > 1], minlength=len(levels))
        self.tied = counts > 1
        pairs = [(number[p[:i]], number[p[i:]], number[p]) for p in pieces for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        first, second, to = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.merge = PairMap(first, second, to)
        self.none = len(levels)
        self.rank = np.full(n + 4, self.none, np.int64)
        for p, v in pieces.items():
            self.rank[number[p]] = rank[-v]
        longer = "".join(p for p in pieces if len(p) > 1)
        #: Merges never cross from another character to a space, nor any character that no longer piece holds.
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("pieces with an inner space are not handled")
        self.split = re.compile(" *[^ \n]+| +|\n" if "\n" not in longer else " *[^ ]+| +")

    def units(self, text: str) -> list[str]:
        """Pre-tokens of a text; they are independent of one another."""
        return self.split.findall(" " + text.replace(_SPACE, " ")) if text else []

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.merge.get(a, b).astype(np.int64)
        return to, np.where(to >= 0, self.rank[to], self.none)

    def count(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        code = np.frombuffer("".join(units).replace(" ", _SPACE).encode("utf-32-le"), np.uint32)
        sym = self.char[code]
        seq = np.repeat(np.arange(len(units)), lengths)
        total = np.zeros(len(units), np.int64)
        while len(sym):
            to, rank = self._ranks(sym[:-1], sym[1:])
            rank[seq[:-1] != seq[1:]] = self.none
            starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(sym)]]))
            best = np.minimum.reduceat(np.concatenate([rank, [self.none]]), starts)
            live = best < self.none
            if not live.all():  # these are done
                off = np.repeat(~live, sizes)
                total += np.bincount(seq[off], self.cost[sym[off]], len(units)).astype(np.int64)
                keep = ~off
                alone = np.flatnonzero(keep)
                if not len(alone):
                    break
                to = np.concatenate([to, [-1]])[keep][:-1]
                rank = np.concatenate([rank, [self.none]])[keep][:-1]
                sym, seq = sym[keep], seq[keep]
                best, sizes = best[live], sizes[live]
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            own = np.repeat(best, sizes)[:-1]
            chosen = np.flatnonzero(rank == own)
            new_run = np.concatenate([[True], chosen[1:] != chosen[:-1] + 1])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - run_start) % 2 == 0]
            made, s = to[chosen], seq[chosen]
            # What the merges, from left to right, put beside each new symbol.
            left = np.where((chosen > 0) & (seq[chosen - 1] == s), sym[chosen - 1], -1)
            touching = np.flatnonzero(chosen[1:] == chosen[:-1] + 2) + 1
            touching = touching[s[touching] == s[touching - 1]]
            left[touching] = made[touching - 1]
            after = np.minimum(chosen + 2, len(sym) - 1)
            right = np.where((chosen + 2 < len(sym)) & (seq[after] == s), sym[after], -1)
            bound = rank[chosen]
            risky = self.tied[bound]
            for a, b, there in ((left, made, left >= 0), (made, right, right >= 0)):
                at = np.flatnonzero(there)
                risky[at] |= self._ranks(a[at], b[at])[1] <= bound[at]
            if risky.any():
                leftmost = np.concatenate([[True], s[1:] != s[:-1]])
                chosen = chosen[leftmost | ~np.isin(s, s[risky])]
                made = to[chosen]
            sym[chosen] = made
            stay = np.ones(len(sym), bool)
            stay[chosen + 1] = False
            sym, seq = sym[stay], seq[stay]
        return total


_models: dict[str, PieceRanks] = {}
_known: dict[str, tuple[dict[str, int], list[int]]] = {}


def _model(path: str) -> tuple[PieceRanks, dict[str, int], list[int]]:
    """The model, the counts remembered, and the bytes that they take (one number in a list)."""
    if path not in _models:
        _models[path], _known[path] = PieceRanks(path), ({}, [0])
    return _models[path], *_known[path]


def count_texts(texts: list[str | None], model_path: str) -> list[int]:
    """Tokens of each whole text (null: 0)."""
    model, known, held = _model(model_path)
    split = [model.units(t or "") for t in texts]
    new = list(set().union(*split).difference(known))
    fresh = dict(zip(new, model.count(new).tolist(), strict=True)) if new else {}
    cost = sum(map(len, fresh)) + 100 * len(fresh)
    if held[0] + cost <= REMEMBERED:
        known.update(fresh)
        held[0] += cost
        return [sum(map(known.__getitem__, u)) for u in split]
    both = known | fresh if len(fresh) > len(known) else None
    if both is None:
        return [sum(known[x] if x in known else fresh[x] for x in u) for u in split]
    return [sum(map(both.__getitem__, u)) for u in split]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``, without any shuffle.

    Counts equal the library's own for whole texts, without begin or end tokens;
    special strings inside a text are ordinary characters. Null and empty texts
    have no bytes and no tokens; a very long text is counted whole, by its distinct
    pre-tokens. Repeated rows give repeated results, extra
    columns are left out, and an empty table gives an empty one.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n = count_texts(part.column("text").to_pylist(), model_path)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
