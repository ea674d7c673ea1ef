"""Packing along a space-filling curve: neighbouring documents share sequences.

A document's hashed token counts, as shares, are projected to a few dimensions by
random signs; each dimension is spread evenly by the mean and deviation of all
documents, and the place along a Hilbert curve through that grid is the sort key.
Documents are range-sorted by it and laid end to end; every full sequence is cut
from that line, and the tokens beyond the last full one fill sequences of falling
powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix, slices
from .shared import cut, partitions

#: Buckets that tokens are hashed into, dimensions of the curve, and bits of each.
BUCKETS, DIMS, BITS = 1 << 12, 6, 10
#: Text bytes that are encoded at once; a longer text is encoded alone.
LOOKUP = 4 << 20

_WHITE = r"[\t-\r\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: How the pattern treats runs of white space: the last character may belong to what follows.
_AHEAD = r"\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others in order from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}


class ByteIds:
    """Ids of whole texts by a byte-level vocabulary of the tokenizers library, special strings inside them included.

    An equal vocabulary of another library, which is several times faster, is
    built from it; its ids are compared on a probe. Looking ahead is needed only
    in texts with runs of white space, so others are split without it.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        bytes_of, own = _byte_of(), public_tokenizers.PATTERN
        ranks = {bytes(bytes_of[c] for c in t): i for t, i in library.get_vocab(with_added_tokens=False).items() if t not in special}
        if not own.endswith(_AHEAD):
            raise ValueError("this pattern treats white space in another way")
        by = lambda pattern: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.whole, self.quick = by(own), by(own.removesuffix(_AHEAD) + r"\s")
        self.size = library.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        probe = ["it's a b  c\n\n d \t'll I'VE 12,5 été 漢字! ", " x", "", "a\nb\x1c c\x85 d", *(f"{s} {s}x" for s in special)]
        if [x.tolist() for x in self.batch(pa.array(probe, pa.large_string()))] != [library.encode(x, add_special_tokens=False).ids for x in probe]:
            raise ValueError("this vocabulary is not one of the byte-level kind")

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        runs = pc.match_substring_regex(texts, _WHITE * 2).to_pylist()
        return [(self.whole if run else self.quick).encode_to_numpy(x, allowed_special="all").astype(self.kind) for x, run in zip(texts.to_pylist(), runs, strict=True)]


_vocabularies: dict[str, ByteIds] = {}


def _vocabulary(path: str) -> ByteIds:
    if path not in _vocabularies:
        _vocabularies[path] = ByteIds(path)
    return _vocabularies[path]


def _signs(size: int, dims: int) -> np.ndarray:
    """A direction of each token: that of its bucket, a random sign in each dimension."""
    bucket = mix(np.arange(1, size + 1, dtype=np.uint64)) % np.uint64(BUCKETS)
    bits = mix(bucket + np.uint64(1 << 20))[:, None] >> np.arange(dims, dtype=np.uint64)[None, :] & np.uint64(1)
    return bits.astype(np.float32) * 2 - 1


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of rows of grid coordinates below 2^bits (Skilling's transform, bits times dimensions at most 63)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns and mirrors of each level, from the coarsest
        below = (1 << level) - 1
        for i in range(dims):
            hit = x[i] >> level & 1 == 1
            swap = np.where(hit, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(hit, below, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):  # Gray code across dimensions
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> level & 1
    return key


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """part, nth (a row's task and place in it), doc_id, n, ids and p: its hashed vector, projected."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, here, seen = _vocabulary(vocabulary), TaskContext.get().partitionId(), 0
        signs = _signs(max(words.size, end_id + 1), DIMS)
        for batch in batches:
            for b in slices(batch, most=LOOKUP):
                texts = pc.fill_null(b.column("text").cast(pa.large_string()), "")
                ids = [np.append(x, words.kind(end_id)) for x in words.batch(texts)]
                size = np.array([len(x) for x in ids], np.int64)
                total = np.stack([np.add.reduceat(signs[np.concatenate(ids), d], np.cumsum(size) - size, dtype=np.float64) for d in range(DIMS)], axis=1)
                p = pa.ListArray.from_arrays(pa.array(np.arange(0, DIMS * len(ids) + 1, DIMS, dtype=np.int32)), pa.array((total / size[:, None]).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), here, np.int32)), pa.array(np.arange(seen, seen + len(ids))), b.column("doc_id"), pa.array(size), pa.array([x.tobytes() for x in ids], pa.binary()), p], ["part", "nth", "doc_id", "n", "ids", "p"])
                seen += len(ids)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"part int, nth long, doc_id {kind}, n long, ids binary, p array<double>")


def along_curve(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, nth, range, start: tokens before a row in its range; range, tokens of it): rows range-sorted by their place along the curve."""
    told = tokens.agg(*(f(F.col("p")[d]).alias(f"{n}{d}") for d in range(DIMS) for n, f in (("mean", F.avg), ("sd", F.stddev_pop)))).first()
    mean, sd = (np.array([told[f"{n}{d}"] or 0.0 for d in range(DIMS)]) for n in ("mean", "sd"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = (np.asarray(b.column("p").flatten()).reshape(-1, DIMS) - mean) / np.where(sd > 0, sd, 1)
            share = 1 / (1 + np.exp(-1.702 * z))  # near the normal distribution's
            cells = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "nth", "n")), pa.array(hilbert_key(cells, BITS))], ["part", "nth", "n", "place"])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = np.asarray(b.column("n"))
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("nth"), pa.array(np.full(len(n), here, np.int32)), pa.array(total + np.cumsum(n) - n), b.column("n")], ["part", "nth", "range", "start", "n"])
            total += int(n.sum())

    light = cut(tokens.select("part", "nth", "n", "p").mapInArrow(keys, "part int, nth long, n long, place long"))
    order = ["place", "part", "nth"]  # copies, however many, are told apart by where they were read
    ranged = light.repartitionByRange(partitions(tokens), *order).sortWithinPartitions(*order)
    placed = cut(ranged.mapInArrow(starts, "part int, nth long, range int, start long, n long"))
    return placed, placed.groupBy("range").agg(F.sum("n").alias("tokens"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; null and empty texts are that one id.
    Documents follow one another along the curve and are cut where a sequence is
    full, so that every sequence has ``capacity`` tokens but for the last ones,
    whose lengths are the powers of two that the rest is made of. Repeated rows
    and null ids are rows like others; copies lie side by side, and ties on the
    curve fall in the order the rows were read in. A long text is encoded alone,
    and its ids take two bytes each. Extra columns are left out, so that their
    names can't clash; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    tokens = cut(tokenized(docs, vocabulary, end_id, doc_id, text))
    placed, totals = along_curve(tokens)
    # One number for each range of the sort: as many as the session's partitions.
    base, total = {}, 0
    for r in totals.orderBy("range").collect():
        base[r["range"]] = total
        total += r["tokens"]
    full = total // capacity
    ends, rest, at = [], total - full * capacity, full * capacity
    while rest:
        at, rest = at + (1 << (rest.bit_length() - 1)), rest - (1 << (rest.bit_length() - 1))
        ends.append(at)
    tails = np.array([full * capacity, *ends], np.int64)  # where the sequences after the full ones begin and end
    held = spark.sparkContext.broadcast((base, tails))
    kind = docs.schema[doc_id].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, tails = held.value
        for b in batches:
            begin = np.array([base[r] for r in b.column("range").to_pylist()], np.int64) + np.asarray(b.column("start"))
            row, out = [], [[] for _ in range(6)]
            for r, (g, n, raw) in enumerate(zip(begin.tolist(), b.column("n").to_pylist(), b.column("ids"), strict=True)):
                raw, done = raw.as_buffer(), 0
                ids = np.frombuffer(raw, f"<u{raw.size // n}").astype("<u4")
                view = memoryview(ids).cast("B")
                while done < n:
                    here = g + done
                    if here < tails[0]:
                        sequence, first = divmod(here, capacity)
                        first, to = sequence * capacity, (sequence + 1) * capacity
                    else:
                        k = int(np.searchsorted(tails, here, "right")) - 1
                        sequence, first, to = int(tails[0]) // capacity + k, int(tails[k]), int(tails[k + 1])
                    size = min(n - done, to - here)
                    row.append(r)
                    for held_, x in zip(out, (done, size, zlib.crc32(view[4 * done : 4 * (done + size)]), n, sequence, here - first), strict=True):
                        held_.append(x)
                    done += size
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    met = tokens.select("part", "nth", "doc_id", "ids").join(placed.hint("shuffle_hash"), ["part", "nth"])
    return met.select("doc_id", "ids", "n", "range", "start").mapInArrow(pieces, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

