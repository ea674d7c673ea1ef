"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the word sequences of all items. Training words are
streamed through it; the state after a word stands for the longest item passage
that ends there, so a match of ``window`` words or more, or a whole shorter
item, is found wherever it starts. Words are lower-cased (A-Z only) runs of
digits, ASCII letters and non-ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import ALNUM, PairMap, slices, utf8, word_hashes, words
from .shared import cut

#: Words of one automaton; a larger benchmark is scanned in several passes.
ITEM_WORDS = 2_000_000
#: Words that one lane of a batch streams, besides its warm-up.
LANE = 512

@dataclass
class Automaton:
    """Arrays of the automaton; ``ids`` are the item ids it reports."""

    vocabulary: np.ndarray  # sorted word hashes
    next: PairMap
    link: np.ndarray
    length: np.ndarray
    pairs: np.ndarray  # sorted (word, word) keys of all passages of two words
    whole: np.ndarray  # state → state of its suffix of `window` words, or -1
    items: dict[int, np.ndarray]  # state of a full window → indexes of items
    shorts: dict[int, list[tuple[int, int]]]  # state → (words, item) of whole short items that end there
    has_short: np.ndarray
    window: int
    least: int  # words of the shortest window
    ids: list


def build(items: list[tuple[object, str | None]], window: int) -> Automaton:
    column = pa.array([t for _, t in items], pa.large_string())
    data, offsets = utf8(column)
    starts, ends, firsts = words(data, offsets, ALNUM)
    vocabulary, seq = np.unique(word_hashes(data, starts, ends), return_inverse=True)
    seq = seq.tolist()
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last_of: list[int] = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        last = 0
        for w in seq[a:b]:
            q = nxt[last].get(w)
            if q is not None:  # a passage that is already there
                if length[q] == length[last] + 1:
                    last = q
                    continue
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[last] + 1)
                link[q] = clone
                p = last
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                last = clone
                continue
            now = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = now
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    link[q] = link[now] = clone
                    while p >= 0 and nxt[p].get(w) == q:
                        nxt[p][w] = clone
                        p = link[p]
            last = now
        last_of.append(last)
    lengths, links = np.array(length, np.int32), np.array(link, np.int32)
    whole = np.full(len(links), -1, np.int32)
    order = np.argsort(lengths, kind="stable")
    for s in order.tolist():
        if s and lengths[s] >= window:
            whole[s] = s if lengths[links[s]] < window else whole[links[s]]
    held: dict[int, set[int]] = {}
    short_at: dict[int, list[tuple[int, int]]] = {}
    for i, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
        s = 0
        for j, w in enumerate(seq[a:b]):
            s = nxt[s][w]
            if j + 1 >= window:
                held.setdefault(int(whole[s]), set()).add(i)
        if 0 < b - a < window:
            short_at.setdefault(s, []).append((b - a, i))
    shorts: dict[int, list[tuple[int, int]]] = {}
    if short_at:
        for s in order.tolist():
            if s and (own := short_at.get(s, []) + shorts.get(int(links[s]), [])):
                shorts[s] = own
    has_short = np.zeros(len(links), bool)
    has_short[list(shorts)] = True
    state = np.repeat(np.arange(len(nxt)), [len(x) for x in nxt])
    word = np.array([w for x in nxt for w in x], np.int64)
    to = np.array([t for x in nxt for t in x.values()], np.int64)
    flat = np.array(seq, np.int64)
    joined = np.ones(max(0, len(flat) - 1), bool)
    inner = firsts[1:-1]
    joined[inner[(inner > 0) & (inner < len(flat))] - 1] = False
    pairs = np.unique((flat[:-1] << 32 | flat[1:])[joined]) if len(flat) > 1 else np.zeros(0, np.int64)
    sizes = np.diff(firsts)
    sizes = sizes[sizes > 0]
    least = int(min(window, sizes.min())) if len(sizes) else window
    return Automaton(vocabulary, PairMap(state, word, to), links, lengths, pairs, whole, {k: np.array(sorted(v)) for k, v in held.items()}, shorts, has_short, window, least, [i for i, _ in items])


def _stream(auto: Automaton, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, state, matching length) where a window can end. ids: -1 for words outside the vocabulary.

    A passage of n words is n-1 pairs of the automaton, so runs of fewer pairs
    than the shortest window has hold none; the others are streamed in lanes.
    Each lane starts ``window - 1`` words early, which gives every length up to
    ``window`` in full.
    """
    n = len(ids)
    known = ids >= 0
    keep = known
    if auto.least > 1 and n > 1:
        key = ids[:-1].astype(np.int64) << 32 | np.maximum(ids[1:], 0)
        both = np.flatnonzero(known[:-1] & known[1:] & (doc[:-1] == doc[1:]))
        at = np.minimum(np.searchsorted(auto.pairs, key[both]), max(0, len(auto.pairs) - 1))
        linked = np.zeros(n - 1, bool)
        if len(auto.pairs):
            linked[both] = auto.pairs[at] == key[both]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], linked.view(np.int8), [0]])))
        starts, ends = edge[::2], edge[1::2] + 1
    else:
        cuts = known.astype(np.int8)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], cuts, [0]])))
        starts, ends = edge[::2], edge[1::2]
        inner = np.searchsorted(doc, np.arange(doc[0], doc[-1] + 1)) if n else np.zeros(0, np.int64)
        if len(starts) and len(inner):
            inner = inner[(inner > 0) & known[np.minimum(inner, n - 1)] & known[inner - 1]]
            starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
            alive = ends > starts
            starts, ends = starts[alive], ends[alive]
    fit = ends - starts >= auto.least
    starts, ends = starts[fit], ends[fit]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    pieces = -(-(ends - starts) // LANE)
    own = np.repeat(starts, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LANE
    stop = np.minimum(own + LANE, np.repeat(ends, pieces))
    begin = np.maximum(own - (auto.window - 1), np.repeat(starts, pieces))
    order = np.argsort(begin - stop, kind="stable")
    begin, own, stop = begin[order], own[order], stop[order]
    spans = stop - begin
    state, match = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for t in range(int(spans[0])):
        live = int(np.searchsorted(-spans, -t, "left"))
        word = ids[begin[:live] + t]
        s, m = state[:live], match[:live]
        to = auto.next.get(s, word)
        lost = np.flatnonzero(to < 0)
        while len(lost):
            up = auto.link[s[lost]]
            root = up < 0
            s[lost[root]], m[lost[root]], to[lost[root]] = 0, -1, 0
            lost, up = lost[~root], up[~root]
            s[lost], m[lost] = up, auto.length[up]
            to[lost] = auto.next.get(s[lost], word[lost])
            lost = lost[to[lost] < 0]
        state[:live] = to
        m += 1
        at = begin[:live] + t
        hit = np.flatnonzero((at >= own[:live]) & ((m >= auto.window) | auto.has_short[to]))
        if len(hit):
            found.append((at[hit], to[hit].astype(np.int64), m[hit].copy()))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def scan_slice(auto: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list], list[list[tuple[int, int]]]]:
    """For each row: words, hit words, item ids found, and hit byte ranges (start, end) within the row."""
    starts, ends, firsts = words(data, offsets, ALNUM)
    rows = len(offsets) - 1
    counts = np.diff(firsts)
    hit_items: list[list] = [[] for _ in range(rows)]
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    n_hit = np.zeros(rows, np.int64)
    if not len(starts) or not len(auto.vocabulary):
        return counts, n_hit, hit_items, ranges
    hashes = word_hashes(data, starts, ends)
    at = np.minimum(np.searchsorted(auto.vocabulary, hashes), len(auto.vocabulary) - 1)
    ids = np.where(auto.vocabulary[at] == hashes, at, -1)
    doc = np.repeat(np.arange(rows), counts)
    pos, state, match = _stream(auto, ids, doc)
    if not len(pos):
        return counts, n_hit, hit_items, ranges
    cover = np.zeros(len(ids) + 1, np.int64)
    got: dict[int, set[int]] = {}
    full = match >= auto.window
    np.add.at(cover, pos[full] - auto.window + 1, 1)
    np.add.at(cover, pos[full] + 1, -1)
    for d, s in np.unique(np.stack([doc[pos[full]], auto.whole[state[full]]]), axis=1).T.tolist():
        got.setdefault(d, set()).update(auto.items[s].tolist())
    for k in np.flatnonzero(auto.has_short[state]).tolist():
        p = int(pos[k])
        for size, item in auto.shorts[int(state[k])]:
            if size <= match[k]:
                cover[p - size + 1] += 1
                cover[p + 1] -= 1
                got.setdefault(int(doc[p]), set()).add(item)
    hit = np.cumsum(cover[:-1]) > 0
    n_hit = np.bincount(doc[hit], minlength=rows)
    for d, found in got.items():
        hit_items[d] = sorted({auto.ids[i] for i in found}, key=str)
    edge = hit & ~np.concatenate([[False], hit[:-1] & (doc[1:] == doc[:-1])])
    close = hit & ~np.concatenate([hit[1:] & (doc[1:] == doc[:-1]), [False]])
    for a, b in zip(np.flatnonzero(edge).tolist(), np.flatnonzero(close).tolist(), strict=True):
        d = int(doc[a])
        ranges[d].append((int(starts[a] - offsets[d]), int(ends[b] - offsets[d])))
    return counts, n_hit, hit_items, ranges


def _automata(items: DataFrame, item_id: str, text: str, window: int, item_words: int) -> Iterator[tuple[Automaton, bool]]:
    """Automata over parts of the items, each of a checked size (bytes bound words), and whether it is the last."""
    known = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t")).distinct()
    total = known.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-int(total) // (2 * item_words)))
    for k in range(parts):
        own = known.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).orderBy("i", "t").collect()
        yield build([(r["i"], r["t"]) for r in own], window), k == parts - 1


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", window: int = 10, carry: tuple[str, ...] = (), remove: bool = False, item_words: int = ITEM_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, text, n_words, n_hit, item_ids (array of string, sorted), spans (hit byte ranges), and the columns of ``carry``.

    A window is ``window`` consecutive words of an item; an item of fewer words,
    but at least one, is a window as a whole. Every word inside an occurrence of
    a window counts as hit; spans run from the first to the last hit word of each
    unbroken run, and ``remove`` cuts them out of the text. Null and empty texts
    have no words; null items and items without words are ignored; repeated rows
    are scanned each, and repeated items count once; other columns are left out,
    so that their names can't clash. An empty items table hits nothing. A
    benchmark of more than ``item_words`` words takes several passes with a
    bounded automaton each; the documents are never shuffled. A very long text is
    streamed whole in one task, some 30 bytes for each of its bytes.
    """
    kinds = [(f"carry{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    now = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"carry{i}") for i, c in enumerate(carry)), F.array().cast("array<string>").alias("item_ids"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [("doc_id", docs.schema[doc_id].dataType), ("text", T.StringType()), *kinds, ("item_ids", T.ArrayType(T.StringType())), ("spans", T.ArrayType(span)), ("n_words", T.LongType()), ("n_hit", T.LongType())]
    schema = T.StructType([T.StructField(*x) for x in fields])
    through = ["doc_id", *(k for k, _ in kinds)]
    for auto, last in _automata(items, item_id, text, window, item_words):
        held = docs.sparkSession.sparkContext.broadcast(auto)

        def run(batches: Iterator[pa.RecordBatch], held=held, drop=remove and last) -> Iterator[pa.RecordBatch]:
            auto = held.value
            for batch in batches:
                for part in slices(batch):
                    data, offsets = utf8(part.column("text"))
                    counts, _, ids, ranges = scan_slice(auto, data, offsets)
                    old_ids, old_spans = part.column("item_ids").to_pylist(), part.column("spans").to_pylist()
                    for r in range(part.num_rows):
                        if old_spans[r]:
                            ranges[r] = _union(ranges[r], [(x["start"], x["end"]) for x in old_spans[r]])
                        ids[r] = sorted({*map(str, ids[r]), *old_ids[r]})
                    own = lambda r: data[offsets[r] : offsets[r + 1]]
                    n_hit = [_words_in(own(r), x) if x else 0 for r, x in enumerate(ranges)]
                    texts = part.column("text")
                    if drop and any(ranges):
                        texts = pa.array([_without(own(r).tobytes(), x) if x else t.as_py() for r, (t, x) in enumerate(zip(texts, ranges, strict=True))], pa.string())
                    spans = pa.array([[{"start": a, "end": b} for a, b in x] for x in ranges], _SPAN)
                    carried = [part.column(c) for c in through]
                    yield pa.RecordBatch.from_arrays([carried[0], texts, *carried[1:], pa.array(ids, pa.list_(pa.string())), spans, pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64())], [f for f, _ in fields])

        now = now.drop("n_words", "n_hit").mapInArrow(run, schema)
        if not last:
            now = cut(now)
    return now.select("doc_id", "text", "n_words", "n_hit", "item_ids", "spans", *(F.col(f"carry{i}").alias(c) for i, c in enumerate(carry)))


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(a + b):
        if out and x < out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def _words_in(data: np.ndarray, spans: list[tuple[int, int]]) -> int:
    return sum(len(words(data[a:b], np.array([0, b - a]), ALNUM)[0]) for a, b in spans)


def decontaminate(docs: DataFrame, items: DataFrame, max_coverage: float = 0.5, window: int = 10) -> DataFrame:
    """``docs`` (doc_id, text and other columns) with benchmark spans cut out of the texts; rows with more than ``max_coverage`` hit words go.

    ``n_chars``, where there is such a column, follows the shortened texts.
    Other rows and columns pass unchanged, whatever the columns' names; null and
    empty texts and repeated rows stay, an empty table gives an empty one, and
    without items nothing goes. See ``scan`` for the rest.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    # Carried under numbers, so that a column of the documents may have any name.
    numbered = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"carried{i}") for i, c in enumerate(others)))
    found = scan(numbered, items, window=window, carry=tuple(f"carried{i}" for i in range(len(others))), remove=True)
    kept = found.where((F.col("n_hit") == 0) | (F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words")))
    values = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(f"carried{i}") for i, c in enumerate(others)}
    if "n_chars" in others:
        values["n_chars"] = F.when(F.col("n_hit") > 0, F.length("text")).otherwise(values["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(*(values[c].alias(c) for c in docs.columns))


def _without(raw: bytes, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode()
