"""Vector code compression: product codebooks refined over the distinct parts of all vectors, met in a trie.

The distinct parts of a task lie in lexicographic order, which is the order of
the leaves of a trie over their components. The trie is walked depth first: the
squared distances of a prefix to all codebook entries are worked out once and
handed to everything below it, and a leaf picks its nearest entry and adds its
weight, the number of vectors that hold it, to that entry's sums.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, partitions
from .vectors import dimensions, matrix, whole_vectors

#: Leaves whose paths are followed together; their distances fit a core's cache.
LEAVES = 256
#: Rows of one label are summed and looked up in so many groups.
SALTS = 32


def distinct_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, the place of each row among them)."""
    order = np.lexsort(m.T[::-1]) if m.shape[1] else np.arange(len(m))
    fresh = np.ones(len(m), bool)
    fresh[1:] = (m[order[1:]] != m[order[:-1]]).any(axis=1)
    place = np.empty(len(m), np.int64)
    place[order] = np.cumsum(fresh) - 1
    if not m.shape[1]:
        return m[:1], np.zeros(len(m), np.int64)
    return m[order[fresh]], place


def _kind(parts: np.ndarray, entries: np.ndarray) -> type:
    """The narrowest numbers that hold every distance."""
    far = max((abs(int(x)) for m in (parts, entries) if m.size for x in (m.min(), m.max())), default=0) * 2
    most = far * far * max(1, parts.shape[1])
    return np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest of ``entries``, squared distance) of distinct ``parts`` in lexicographic order; ties go to the lower index."""
    kind = _kind(parts, entries)
    parts, entries = parts.astype(kind), entries.astype(kind)
    depth_of = parts.shape[1]
    code, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), object if kind is object else np.int64)

    def below(lo: int, hi: int, depth: int, shared: np.ndarray) -> None:
        """All leaves from ``lo`` to ``hi``, which share the first ``depth`` components, at ``shared`` from the entries."""
        block, known, node = parts[lo:hi], shared[None, :], np.zeros(hi - lo, np.int64)
        fresh = np.zeros(hi - lo, bool)
        fresh[0] = True
        for d in range(depth, depth_of):
            fresh[1:] |= block[1:, d] != block[:-1, d]
            heads = np.flatnonzero(fresh)
            step = block[heads, d][:, None] - entries[None, :, d]
            step *= step
            step += known[node[heads]]
            known, node = step, np.cumsum(fresh) - 1
        best = known.argmin(axis=1)
        code[lo:hi], far[lo:hi] = best[node], known[np.arange(len(known)), best][node]

    stack = [(0, len(parts), 0, np.zeros(len(entries), kind))] if len(parts) else []
    while stack:
        lo, hi, depth, shared = stack.pop()
        if hi - lo <= LEAVES or depth == depth_of:
            below(lo, hi, depth, shared)
            continue
        starts = np.concatenate([[lo], lo + 1 + np.flatnonzero(parts[lo + 1 : hi, depth] != parts[lo : hi - 1, depth]), [hi]])
        at = 0
        while at < len(starts) - 1:  # a child of many leaves, or neighbouring ones together
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + LEAVES, "right")) - 1)
            a, b = int(starts[at]), int(starts[to])
            if to == at + 1:
                step = entries[:, depth] - parts[a, depth]
                stack.append((a, b, depth + 1, shared + step * step))
            else:
                below(a, b, depth, shared)
            at = to
    return code, far


def _split(m: np.ndarray, pieces: int) -> list[np.ndarray]:
    return np.split(m, pieces, axis=1)


def distinct_parts(rows: DataFrame, dim: int, pieces: int) -> DataFrame:
    """part, w (components as bytes), n: each distinct part of ``rows`` (v) and its number, in ranges of (part, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j, m in enumerate(_split(matrix(b.column("v"), dim), pieces)):
                parts, place = distinct_rows(m)
                raw = [x.astype("<i8").tobytes() for x in parts]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), j, np.int32)), pa.array(raw, pa.binary()), pa.array(np.bincount(place, minlength=len(raw)).astype(np.int64))], ["part", "w", "n"])

    counted = rows.select("v").mapInArrow(run, "part int, w binary, n long").groupBy("part", "w").agg(F.sum("n").alias("n"))
    return cut(counted.repartitionByRange(partitions(rows), "part", "w"), ["part", "w"])


def refine(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over all distinct parts: each entry the floored mean of its parts, unused ones as they were."""
    width = books[0].shape[1]
    held = distinct.sparkSession.sparkContext.broadcast(books)

    def pack(total: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        total = [(np.zeros(b.shape, object), np.zeros(len(b), np.int64)) for b in books]
        for b in batches:
            part, n, w = np.asarray(b.column("part")), np.asarray(b.column("n")), matrix(b.column("w"), width)
            for j in np.unique(part).tolist():
                own = part == j
                parts, place = distinct_rows(w[own])
                weight = np.zeros(len(parts), np.int64)
                np.add.at(weight, place, n[own])
                code, _ = nearest(parts, books[j])
                wide = int(np.abs(parts).max(initial=0)) * int(weight.sum()) >= 1 << 62
                sums = np.zeros(books[j].shape, object if wide else np.int64)
                np.add.at(sums, code, parts.astype(sums.dtype) * weight[:, None])
                total[j][0][...] += sums
                np.add.at(total[j][1], code, weight)
        yield pack(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column("sums").to_pylist():
                one = pickle.loads(x)
                total = one if total is None else [(s + t, n + m) for (s, n), (t, m) in zip(total, one, strict=True)]
        if total is not None:
            yield pack(total)

    # One row of sums a task, added in at most 8 tasks: the driver sees 8 times the codebooks' size.
    told = [pickle.loads(r["sums"]) for r in distinct.mapInArrow(run, "sums binary").repartition(8).mapInArrow(add, "sums binary").collect()]
    out = []
    for j, book in enumerate(books):
        sums, count = sum(t[j][0] for t in told), sum(t[j][1] for t in told)
        out.append(np.array([[int(s) // int(c) for s in row] if c else list(old) for row, c, old in zip(sums, count, book, strict=True)], np.int64).reshape(book.shape))
    return out


def compress(vectors: DataFrame, pieces: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error for each whole vector; the final codebooks).

    Components count as floor(scale * x), and vectors are cut into ``pieces``
    equal parts, each of which has a codebook. It starts from the part of the
    ``entries`` smallest ids (fewer, if there are fewer rows; rows of one id follow
    their components) and is refined ``rounds`` times over all parts. ``code`` is
    two hexadecimal digits of each part's nearest entry, ``error`` the sum of
    their squared distances (null where it passes a long).

    Vectors that are null or hold a null or non-finite component are left out; a
    shorter vector has zeros at its end, as have all if their length is not a
    multiple of ``pieces``. Rows without an id are coded like others, but start no
    codebook. Repeated rows are rows, and weigh as such. Components beyond 2^62
    after scaling count as that. Other columns are left out, so that their names
    can't clash; an empty table gives an empty one and empty codebooks.
    """
    rows = cut(whole_vectors(vectors, scale, embedding, vec_id=vec_id, label=label))
    dim = -(-dimensions(rows) // pieces) * pieces
    least = rows.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).select("v").collect()  # as many rows as a codebook has
    if not least:  # nobody has an id, or nobody is there
        least = rows.orderBy("v").limit(entries).select("v").collect()
    first = matrix(pa.array([r["v"] for r in least], pa.binary()), dim) if least else np.zeros((0, dim), np.int64)
    books = [b.copy() for b in _split(first, pieces)]
    if least:
        distinct = distinct_parts(rows, dim, pieces)
        for _ in range(rounds):
            books = refine(distinct, books)
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digits, error = np.zeros((b.num_rows, pieces), np.uint8), np.zeros(b.num_rows, np.int64)
            for j, m in enumerate(_split(matrix(b.column("v"), dim), pieces)):
                parts, place = distinct_rows(m)
                code, far = nearest(parts, held.value[j])
                digits[:, j] = code[place]
                if far.dtype == object or error.dtype == object:
                    error = error.astype(object)
                error = error + far[place]
            raw = digits.tobytes().hex()
            text = [raw[i : i + 2 * pieces] for i in range(0, len(raw), 2 * pieces)]
            fits = [x if x < 1 << 63 else None for x in error.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(text, pa.string()), pa.array(fits, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    return rows.mapInArrow(run, f"{kinds}, code string, error long"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` and label_error, the error summed over equal labels (nulls together). A label's rows are summed and looked up in ``SALTS`` groups, so that one label may hold any share of them."""
    coded = cut(coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    spread = sums.select(F.col("label").alias("own"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    met = F.col("label").eqNullSafe(F.col("own")) & (F.col("salt") == F.col("part"))
    return coded.join(spread.hint("shuffle_hash"), met).drop("own", "part", "salt")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
