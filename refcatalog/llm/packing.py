"""Best-fit packing of token pieces into sequences of a fixed length.

Pieces are ranked within their length across the whole table, so that pieces of
one length are interchangeable. Documents and gaps are then range-sorted runs
(size, count): never more of them than a sequence has tokens, times a small
factor. In each bulk-synchronous round every range sweeps its runs in order of
size, and each gap takes its nearest, that is its largest fitting, documents;
where several runs want the same gaps, rank decides (the larger documents first,
the k-th of a run to the k-th place). What is left of the gaps goes into the next
round. A range that placed nothing is merged with others; when no document fits
any gap, new sequences are opened for a share of what is left. Every piece then
finds its own place from its length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .arrays import slices
from .shared import cut

#: Bytes of words and their ids that a worker remembers.
REMEMBERED = 96 << 20
#: Text bytes whose words are looked up together.
LOOKUP = 4 << 20
#: Runs of documents and gaps that one range sweeps, about.
RANGE_ROWS = 20_000
#: New sequences are opened for this share of the tokens that fit no gap.
OPENED = 0.9

#: A character that marks the end of a part, and those that are set apart after a word of letters.
_SPLIT, _AFTER = "\x00", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Texts whose letters have other ways to lower case, or that may hold special strings.
_UNUSUAL = r"[^\x{0}-\x{24F}]|\x{130}|<\|"


def _plain(word: str) -> bool:
    """Lower-case Latin letters only: neither normalising nor splitting changes such a word."""
    return word.isalpha() and word.islower() and (word.isascii() or max(word) <= "\u024f")


class WordIds:
    """Ids of whole texts by the tokenizers library, looked up word by word as arrays.

    The vocabulary's pre-tokenizer drops white space and lets no token cross it,
    so that a text's ids are those of its parts between ASCII white space. Each
    distinct part is encoded once and then found by its number; words of plain
    letters skip the normaliser, which leaves them as they are, and punctuation
    after one is a token sequence of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.model._resize_cache(0)  # words come once
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        one = self._ids(self.tokenizer, [_SPLIT])[0]
        self.mark = one[0]
        self.number: dict[str, int] = {}
        self.first, self.size, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.used, self.held = 0, 0
        probe = ["ab c", "ab\nc\td\x0be\x0cf\rg", "Ab'c c's, 12\n\u00c9t\u00e9: \u00dfa."]
        whole = self._ids(self.tokenizer, probe)
        if len(one) != 1 or [x[:-1].tolist() for x in self.batch(pa.array(probe, pa.large_string()), 0)] != whole:
            raise ValueError("tokens of this vocabulary cross white space, or its words are not made lower-case")

    def _ids(self, by, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in by.encode_batch_fast(parts, add_special_tokens=False)]

    def _encoded(self, by, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, number of ids of each). Many parts are encoded as one text, with a mark between them that none of them holds."""
        blocks = [f" {_SPLIT} ".join([*parts[i : i + 2000], ""]) for i in range(0, len(parts), 2000)]
        joined = np.concatenate([np.zeros(0, np.uint32), *(np.array(x, np.uint32) for x in self._ids(by, blocks))])
        ends = np.flatnonzero(joined == self.mark) if parts else np.zeros(0, np.int64)
        if len(ends) != len(parts):
            raise ValueError("parts of a text were not told apart")
        return np.delete(joined, ends), np.diff(np.concatenate([[-1], ends])) - 1

    def _room(self, ids: int, words: int) -> None:
        grown = lambda a, n: a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])
        self.flat = grown(self.flat, ids)
        self.first, self.size = grown(self.first, words), grown(self.size, words)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """A number of each distinct word; new ones are remembered while there is room, else only until the next call."""
        known = self.number
        out = np.array([known.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        bare: dict[str, int] = {}  # new words of plain letters, alone or before a mark
        others: dict[str, int] = {}
        odd: list[str] = []
        pairs: list[tuple[str, str]] = []
        for i in new.tolist():
            w = words[i]
            if _plain(w):
                bare[w] = 0
                continue
            stem = w.rstrip(_AFTER)
            if len(stem) < len(w) and _plain(stem):
                rest = w[len(stem) :]
                pairs.append((stem, rest))
                if stem not in known:
                    bare[stem] = 0
                if rest not in known:
                    others[rest] = 0
            elif _SPLIT in w:
                odd.append(w)
            else:
                others[w] = 0
        fresh = [*bare, *others, *odd]
        ids, sizes = [], []
        for by, part in ((self.bare, list(bare)), (self.tokenizer, list(others))):
            one, size = self._encoded(by, part)
            ids.append(one)
            sizes.append(size)
        for x in self._ids(self.tokenizer, odd):
            ids.append(np.array(x, np.uint32))
            sizes.append(np.array([len(x)], np.int64))
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        at, n = self.used, len(known)
        self._room(at + len(flat), n + len(size))
        self.flat[at : at + len(flat)] = flat
        self.first[n : n + len(size)] = at + np.cumsum(size) - size
        self.size[n : n + len(size)] = size
        here = dict(zip(fresh, range(n, n + len(fresh)), strict=True))
        at, end = at + len(flat), n + len(fresh)
        if pairs:
            a = np.array([here[x] if x in here else known[x] for x, _ in pairs], np.int64)
            b = np.array([here[y] if y in here else known[y] for _, y in pairs], np.int64)
            both = np.stack([a, b], axis=1).ravel()
            taken = self.gather(both)
            self._room(at + len(taken), end + len(pairs))
            self.flat[at : at + len(taken)] = taken
            size = self.size[a] + self.size[b]
            self.first[end : end + len(pairs)] = at + np.cumsum(size) - size
            self.size[end : end + len(pairs)] = size
            here.update(zip([x + y for x, y in pairs], range(end, end + len(pairs)), strict=True))
            at += len(taken)
        out[new] = [here[words[i]] for i in new.tolist()]
        cost = sum(map(len, here)) + 4 * (at - self.used) + 130 * len(here)
        if self.held + cost <= REMEMBERED:
            known.update(here)
            self.used, self.held = at, self.held + cost
        return out

    def gather(self, code: np.ndarray) -> np.ndarray:
        """Ids of the words of these numbers, one after the other."""
        size = self.size[code]
        before = np.cumsum(size) - size
        return self.flat[np.repeat(self.first[code] - before, size) + np.arange(size.sum())]

    def batch(self, column: pa.Array, end: int) -> list[np.ndarray]:
        """Ids of each text (null: empty), followed by ``end``."""
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        texts = pc.if_else(pc.match_substring_regex(texts, _UNUSUAL), texts, pc.utf8_lower(texts))
        parts = pc.ascii_split_whitespace(texts)
        flat = parts.flatten()
        flat = flat.filter(pc.not_equal(flat, "")).dictionary_encode() if len(flat) else flat.dictionary_encode()
        offsets = np.asarray(parts.offsets) - parts.offsets[0].as_py()
        blank = np.concatenate([[0], np.cumsum(np.asarray(pc.equal(parts.flatten(), ""), bool))])
        offsets = offsets - blank[offsets]
        code = self._numbers(flat.dictionary.to_pylist())[np.asarray(flat.indices)] if len(flat) else np.zeros(0, np.int64)
        ids = self.gather(code)
        cuts = np.concatenate([[0], np.cumsum(self.size[code])])[offsets]
        mark = np.array([end], np.uint32)
        return [np.concatenate([ids[a:b], mark]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def long(self, text: str, end: int) -> np.ndarray:
        """Ids of one long text, a stretch of words at a time, so that its words are never all held."""
        out, at = [], 0
        while at < len(text):
            to = at + LOOKUP
            while to < len(text) and text[to] not in " \t\n\x0b\x0c\r":
                to += 1
            out.append(self.batch(pa.array([text[at:to]], pa.large_string()), end)[0][:-1])
            at = to
        return np.concatenate([*out, np.array([end], np.uint32)])


_vocabularies: dict[str, WordIds] = {}


def _vocabulary(path: str) -> WordIds:
    if path not in _vocabularies:
        _vocabularies[path] = WordIds(path)
    return _vocabularies[path]


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's partition and rank among that partition's pieces of its length."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, here = _vocabulary(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, most=LOOKUP):
                texts = part.column("text")
                one = part.num_rows == 1 and texts[0].is_valid and len(texts[0].as_py()) > 2 * LOOKUP
                row, piece, length, crc, rank = [], [], [], [], []
                for r, ids in enumerate([words.long(texts[0].as_py(), end_id)] if one else words.batch(texts, end_id)):
                    raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        n = min(capacity, len(ids) - at)
                        row.append(r)
                        piece.append(k)
                        length.append(n)
                        crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                        rank.append(seen[n])
                        seen[n] += 1
                taken = part.column("doc_id").take(pa.array(row, pa.int64()))
                number = np.array(piece, np.int32)
                yield pa.RecordBatch.from_arrays([taken, pa.array(number), pa.array(number.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), here, np.int32)), pa.array(rank, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


DOCS, GAPS, PLACED = 0, 1, 2
_RUNS = "kind int, size long, n long, at long, each long, sequence long, offset long"


def sweep(runs: list[tuple[int, int, int, int]], capacity: int) -> tuple[list[tuple], list[tuple]]:
    """One sweep over runs (kind, size, n, at) of documents (at: rank) and gaps (at: sequence): (runs left, runs placed).

    In order of size, documents wait on a stack and each gap takes from its top,
    as many equal ones as it holds. A placed run is (PLACED, size, n, first rank,
    documents a sequence, first sequence, offset).
    """
    waiting: list[list[int]] = []
    left, placed = [], []
    for kind, size, n, at in sorted(runs, key=lambda r: (r[1], r[0], r[3])):
        if kind == DOCS:
            waiting.append([size, n, at])
            continue
        while n and waiting:
            own, count, rank = waiting[-1]
            each = size // own
            got = min(n, -(-count // each))
            put = min(count, got * each)
            placed.append((PLACED, own, put, rank, each, at, capacity - size))
            full, rest = divmod(put, each)
            if full and size > each * own:
                left.append((GAPS, size - each * own, full, at))
            if rest:
                left.append((GAPS, size - rest * own, 1, at + full))
            if put == count:
                waiting.pop()
            else:
                waiting[-1] = [own, count - put, rank + put]
            n, at = n - got, at + got
        if n:
            left.append((GAPS, size, n, at))
    return left + [(DOCS, *w) for w in waiting], placed


def placements(totals: DataFrame, capacity: int, range_rows: int = RANGE_ROWS, opened_share: float = OPENED) -> DataFrame:
    """The runs placed (columns of ``_RUNS``) for ``totals`` (length, n), by rounds of ``sweep`` over ranges of size."""
    none = F.lit(None).cast("long")
    state = cut(totals.select(F.lit(DOCS).alias("kind"), F.col("length").alias("size"), "n", F.lit(0).cast("long").alias("at"), none.alias("each"), none.alias("sequence"), none.alias("offset")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]  # runs of one range: about `range_rows`
        left, placed = sweep([r[:4] for r in rows if r[0] != PLACED], capacity)
        out = [*(r for r in rows if r[0] == PLACED), *placed, *((*r, None, None, None) for r in left)]
        columns = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["kind", "size", "n", "at", "each", "sequence", "offset"])

    docs, gaps = F.col("kind") == DOCS, F.col("kind") == GAPS
    told = [F.sum(F.when(docs, F.col("n") * F.col("size"))).alias("tokens"), F.min(F.when(docs, F.col("size"))).alias("least"), F.max(F.when(gaps, F.col("size"))).alias("widest"), F.count_if(F.col("kind") != PLACED).alias("runs"), F.count_if(F.col("kind") == PLACED).alias("placed")]
    now = state.agg(*told).first()
    opened, merged = 0, 1
    while now["tokens"]:
        if now["widest"] is None or now["least"] > now["widest"]:
            more = max(1, int(opened_share * now["tokens"]) // capacity)
            row = [GAPS, capacity, more, opened]
            state = state.unionByName(state.sparkSession.range(1).select(*(F.lit(v).cast(t).alias(c) for v, t, c in zip([*row, None, None, None], ["int"] + ["long"] * 6, state.columns, strict=True))))
            opened, merged = opened + more, 1
        ranges = -(-now["runs"] // (range_rows * merged))
        seen = Observation()
        sorted_runs = state.repartitionByRange(ranges, "size") if ranges > 1 else state.coalesce(1)
        state = cut(sorted_runs.mapInArrow(run, _RUNS).observe(seen, *told))
        after = seen.get
        # A sweep that placed nothing missed gaps of other ranges: wider ranges in the next round.
        merged = merged * 8 if after["placed"] == now["placed"] else 1
        now = after
    return state.where(F.col("kind") == PLACED)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (length, part, rank as of ``tokenized_pieces``).

    No sequence holds more than ``capacity`` tokens, and offsets are gapless from 0.
    """
    counts = cut(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    placed = placements(counts.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    # A few runs for each of at most `capacity` lengths, whatever the table's size.
    plan = np.array(sorted((r["size"], r["at"], r["sequence"], r["each"], r["offset"]) for r in placed.collect()), np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.hint("shuffle_hash").join(base.hint("shuffle_hash"), ["length", "part"])
    held = pieces.sparkSession.sparkContext.broadcast(plan)
    names = [c for c in pieces.columns if c not in ("part", "rank")]
    kinds = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        key = plan[:, 0] << 44 | plan[:, 1]  # sorted: ranks stay below 2^44
        for b in batches:
            size, rank = np.asarray(b.column("length")), np.asarray(b.column("at"))
            own = plan[np.searchsorted(key, size << 44 | rank, "right") - 1] if len(size) else np.zeros((0, 5), np.int64)
            nth = rank - own[:, 1]
            sequence = own[:, 2] + nth // np.maximum(own[:, 3], 1)
            offset = own[:, 4] + nth % np.maximum(own[:, 3], 1) * size
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, (F.col("base") + F.col("rank")).alias("at")).mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; null and empty texts are that one id.
    Only documents of more than ``capacity`` ids are cut, into full pieces and a
    last one. Repeated rows are packed each, and so are null ids; equal lengths
    are told apart by partition and place, so ties have no effect on the number of
    sequences. A long text is looked up a stretch of words at a time. Extra
    columns are left out, so that their names can't clash; an empty table gives
    an empty one.
    """
    return pack(cut(tokenized_pieces(docs, vocabulary, capacity, end_id, doc_id, text)), capacity)
