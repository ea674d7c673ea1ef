"""Quality by co-training: a text classifier and a page-metadata classifier teach each other.

The text view is the set of hashed words and word shapes; the metadata view is
the source, the language, the stated length and the page's layout in numbers.
Each round, either view marks the unlabelled documents it is surest of, over the
whole corpus, and these train the other view. At the end each view is calibrated
on held-out labels, and both together score every document. All labelled rows
take part: Spark sums the gradients over them, and the driver holds weights only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .arrays import NON_SPACE, mix, slices, utf8, word_hashes, words
from .shared import cut, unused

#: Rounds, and pseudo-labels of each class that a view gives in a round.
ROUNDS, PSEUDO = 3, 300
TEXT_BINS, META_BINS = 1 << 15, 1 << 11
#: Documents of a lower score are rejected.
KEEP = 0.5
#: Bins of sets that are learned from at once, and margins of rows that are calibrated by at once.
BLOCK_BINS, BLOCK_ROWS = 1 << 18, 1 << 14
#: Binary digits after the point of the sums over rows, of gradients and of curves. They are sums of whole numbers, so neither order nor partitions change them; gradients add up to one at most, which doubles hold exactly.
POINT, CURVE_POINT = 52, 24

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x80:], _SHAPE[0x30:0x3A] = 1, 2, 2, 3


def _bins(h: np.ndarray, salt: int, bins: int) -> np.ndarray:
    return (mix(h + np.uint64(salt * 7919)) % np.uint64(bins)).astype(np.int64)


def text_view(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each row: the distinct bins of its words and word shapes; and layout numbers (words, distinct share, lines, upper-case and symbol shares)."""
    starts, ends, firsts = words(data, offsets, NON_SPACE)
    own = word_hashes(data, starts, ends)
    rows = len(offsets) - 1
    # A shape is a word with each run of a kind of character as one.
    shape = _SHAPE[data]
    same = np.zeros(len(data), bool)
    same[1:] = shape[1:] == shape[:-1]
    same[starts] = False
    inside = NON_SPACE[data]
    taken = np.flatnonzero(inside & ~same)
    s2 = np.searchsorted(taken, starts)
    e2 = np.searchsorted(taken, ends)
    shapes = word_hashes(shape[taken], s2, e2, lower=False)
    bins = np.stack([_bins(own, 1, TEXT_BINS), _bins(shapes, 2, TEXT_BINS)], axis=1)
    out, distinct = [], np.zeros(rows)
    for r, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
        out.append(np.unique(bins[a:b]).astype("<u2"))
        distinct[r] = len(np.unique(bins[a:b, 0])) / max(1, b - a)
    count = np.diff(firsts)
    add = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    size = np.maximum(np.diff(offsets), 1)
    lines = add(data == 10) + 1
    upper = add(shape == 1) / size
    symbols = add(inside & (shape > 3)) / size
    return out, np.stack([count, distinct, lines, upper, symbols], axis=1)


def meta_view(layout: np.ndarray, columns: list[list]) -> np.ndarray:
    """Of each row: bins of its metadata columns (null is a value of its own) and of its layout in steps."""
    count, distinct, lines, upper, symbols = layout.T
    steps = [np.log2(1 + count) * 2, np.minimum(distinct * 10, 9), np.log2(lines) * 2, np.log2(1 + count / lines) * 2, np.minimum(upper * 40, 20), np.minimum(symbols * 100, 30)]
    values = [x.astype(np.int64).astype(np.uint64) for x in steps]
    for c in columns:
        raw = pa.array(["\0" if x is None else str(x) for x in c], pa.large_string())
        data, offsets = utf8(raw)
        h = np.zeros(len(c), np.uint64)
        some = np.flatnonzero(np.diff(offsets) > 0)
        if len(some):
            h[some] = word_hashes(data, offsets[:-1][some], offsets[1:][some], lower=False)
        values.append(h)
    return np.stack([_bins(v, 100 + i, META_BINS) for i, v in enumerate(values)], axis=1).astype("<u2")


@dataclass
class View:
    """A logistic classifier over sets of bins, each set scaled to length one."""

    weights: np.ndarray
    bias: float = 0.0
    slope: tuple[float, float] = (1.0, 0.0)

    def margin(self, sets: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        flat, size = sets
        row = np.repeat(np.arange(len(size)), size)
        return np.bincount(row, self.weights[flat], len(size)) / np.sqrt(np.maximum(size, 1)) + self.bias

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        return self.slope[0] * margin + self.slope[1]


def _blocks(rows: DataFrame, sizes: Callable[[Row], int], most: int, pack: Callable[[list[Row]], tuple]) -> RDD:
    """``rows`` as arrays, a block of them for about ``most`` of their sizes, kept on the executors' disks for the passes over them."""

    def run(own: Iterable[Row]) -> Iterator[tuple]:
        held, size = [], 0
        for r in own:
            held.append(r)
            size += sizes(r)
            if size >= most:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return rows.rdd.mapPartitions(run).persist(StorageLevel.DISK_ONLY)


def _summed(blocks: RDD, of: Callable[..., np.ndarray], size: int) -> np.ndarray:
    """Sums over all ``blocks`` of the ``size`` whole numbers that ``of`` gives for each; a task sends its own sums."""

    def run(own: Iterable[tuple]) -> Iterator[bytes]:
        total = np.zeros(size, np.int64)
        for block in own:
            total += of(*block)
        yield total.tobytes()

    return sum((np.frombuffer(x, np.int64) for x in blocks.mapPartitions(run).collect()), np.zeros(size, np.int64))


def _whole(x: np.ndarray, point: int) -> np.ndarray:
    return np.rint(np.ldexp(x, point))


def _pull(w: np.ndarray, sets: tuple[np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradient of the log loss at ``w`` (of the bins, and the bias), rows weighed by class, in multiples of 2^-POINT."""
    flat, size = sets
    row, scale = np.repeat(np.arange(len(size)), size), 1 / np.sqrt(np.maximum(size, 1))
    z = np.bincount(row, w[flat], len(size)) * scale + w[-1]
    e = weight[y] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
    return np.append(np.bincount(flat, _whole(e * scale, POINT)[row], len(w) - 1), _whole(e, POINT).sum()).astype(np.int64)


def labelled_blocks(rows: DataFrame) -> RDD:
    """Blocks of both views and the labels of ``rows`` (a, b, y)."""

    def pack(held: list[Row]) -> tuple:
        sets = (_joined([np.frombuffer(r[c], "<u2") for r in held]) for c in "ab")
        return (*((flat.astype("<u2"), size) for flat, size in sets), np.array([r["y"] for r in held]))

    return _blocks(rows.select("a", "b", "y"), lambda r: (len(r["a"]) + len(r["b"])) // 2, BLOCK_BINS, pack)


def fit_views(blocks: RDD, counts: np.ndarray, extra: list[tuple[list[np.ndarray], list[int]]], rounds: int = 60, rate: float = 0.3, ridge: float = 1e-4) -> tuple[View, View]:
    """Both views from all rows of ``labelled_blocks``, of each class ``counts``, and from sets and labels ``extra`` for either view.

    Every step takes the whole gradient: one Spark job over the rows, whose result
    doesn't depend on how they are dealt out. Classes weigh the same.
    """
    bins = (TEXT_BINS, META_BINS)
    own = [(_joined(sets), np.array(y, np.int64)) for sets, y in extra]
    weights = [0.5 / np.maximum(1, counts + np.bincount(y, minlength=2)) for _, y in own]
    w, b = [np.zeros(n + 1) for n in bins], bins[0] + 1
    m, v = [np.zeros(n + 1) for n in bins], [np.zeros(n + 1) for n in bins]
    for k in range(1, rounds + 1):
        held = blocks.context.broadcast((w, weights))

        def pull(a: tuple, b: tuple, y: np.ndarray, held=held) -> np.ndarray:
            w, weights = held.value
            return np.concatenate([_pull(w[i], sets, y, weights[i]) for i, sets in enumerate((a, b))])

        told = _summed(blocks, pull, sum(bins) + 2)
        held.destroy()
        for i, part in enumerate((told[:b], told[b:])):
            g = np.ldexp((part + _pull(w[i], *own[i], weights[i])).astype(float), -POINT) + ridge * w[i]
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.001 * (g * g - v[i])
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    return View(w[0][:-1], float(w[0][-1])), View(w[1][:-1], float(w[1][-1]))


def _curve(blocks: RDD, of: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], n: int) -> np.ndarray:
    """Logistic curve of the ``n`` numbers that ``of`` gives for the margins of each row (and a constant), with a small ridge; ``blocks`` hold both margins and the label of all rows."""
    w = np.zeros(n + 1)
    for _ in range(25):

        def sums(za: np.ndarray, zb: np.ndarray, y: np.ndarray, w=w) -> np.ndarray:
            x = np.stack([*of(za, zb), np.ones(len(y))], axis=1)
            p = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -30, 30)))
            h = (x * (p * (1 - p))[:, None])[:, :, None] * x[:, None, :]
            each = np.concatenate([h.reshape(len(x), -1), x * (p - y)[:, None]], axis=1)
            return _whole(each, CURVE_POINT).astype(np.int64).sum(axis=0)

        told = np.ldexp(_summed(blocks, sums, (n + 1) * (n + 2)).astype(float), -CURVE_POINT)
        h, g = told[: (n + 1) ** 2].reshape(n + 1, n + 1), told[(n + 1) ** 2 :]
        step = np.clip(np.linalg.solve(h + 1e-2 * np.eye(n + 1), g + 1e-2 * w), -5, 5)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    text: View
    meta: View
    mix: list[float]
    fixed: float | None = None
    meta_columns: list[str] = field(default_factory=list)


def _encoded(docs: DataFrame, doc_id: str, text: str, meta_columns: list[str]) -> DataFrame:
    """doc_id, and both views as bytes (16-bit bins)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                sets, layout = text_view(data, offsets)
                meta = meta_view(layout, [part.column(f"m{i}").to_pylist() for i in range(len(meta_columns))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())], ["doc_id", "a", "b"])

    own = [F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(meta_columns)]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *own).mapInArrow(run, f"doc_id {kind}, a binary, b binary")


def _joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the sets one after another, and the size of each set."""
    return np.concatenate([np.zeros(0, np.int64), *sets]).astype(np.int64), np.fromiter(map(len, sets), np.int64, len(sets))


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``_joined``, of a column of sets as bytes."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]].view("<u2").astype(np.int64), np.diff(offs) // 2


def _margins(encoded: DataFrame, model: Model) -> DataFrame:
    held = encoded.sparkSession.sparkContext.broadcast(model)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for b in slices(batch, "a"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(m.text.margin(_sets(b.column("a")))), pa.array(m.meta.margin(_sets(b.column("b")))), b.column("y")], ["doc_id", "za", "zb", "y"])

    return encoded.select("doc_id", "a", "b", "y").mapInArrow(run, f"doc_id {kind}, za double, zb double, y int")


def train(encoded: DataFrame, labels: DataFrame, doc_id: str, label: str, meta_columns: list[str], rounds: int = ROUNDS, pseudo: int = PSEUDO) -> Model:
    """Co-training over ``encoded``, by every labelled row; the driver gets sums, and the bounded numbers of rows that the views teach each other.

    A quarter of the labelled rows, by the hash of their views, is held out and
    calibrates. The same rows give the same model, however they are dealt out.
    """
    known = labels.where(f"`{label}` in (0, 1) and `{doc_id}` is not null").groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    # Equal documents would all be equally sure: one of each is enough, named by the hash of its views.
    told = encoded.join(known.hint("shuffle_hash"), "doc_id", "left").select("a", "b", "y").distinct()
    told = cut(told.select(F.xxhash64("a", "b").alias("doc_id"), "a", "b", "y"))
    pool, labelled = told.where("y is null"), told.where("y is not null").withColumn("held", F.expr("pmod(doc_id, 4) = 3"))
    sizes = labelled.groupBy("held", "y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("a") + F.length("b")).alias("bytes")).collect()
    count = lambda held: np.array([sum(r["n"] for r in sizes if r["y"] == y and r["held"] in held) for y in (0, 1)])
    if min(every := count((False, True))) < 8:
        return Model(View(np.zeros(TEXT_BINS)), View(np.zeros(META_BINS)), [0, 0, 0], float(every[1] / every.sum()) if every.sum() else 1.0, meta_columns)
    # A task for two blocks, but no more than run at once: each sends its sums to the driver.
    tasks = min(encoded.sparkSession.sparkContext.defaultParallelism, 1 + sum(r["bytes"] for r in sizes) // (4 * BLOCK_BINS))
    learn = labelled_blocks(labelled.where("not held").coalesce(tasks))
    arrays = lambda x: [np.frombuffer(v, "<u2") for v in x]
    extra_a, extra_b = ([], []), ([], [])
    fit = lambda: fit_views(learn, count((False,)), [extra_a, extra_b])
    model = Model(*fit(), [0, 0, 0], None, meta_columns)
    gone: set[int] = set()  # at most 4 * pseudo a round: nothing is taught twice
    for _ in range(rounds):
        left = pool.where(~F.col("doc_id").isin(*sorted(gone))) if gone else pool
        sure = cut(_margins(left, model))
        taught: dict[str, list] = {"za": [], "zb": []}
        for by in taught:
            for up, cls in ((True, 1), (False, 0)):
                order = F.desc(by) if up else F.asc(by)
                rows = sure.where(F.col(by) > 0 if up else F.col(by) < 0).orderBy(order, "doc_id").limit(pseudo).select("doc_id")
                surest = pool.join(F.broadcast(rows), "doc_id").select("doc_id", "a", "b").collect()
                taught[by] += [(bytes(r["a"]), bytes(r["b"]), cls) for r in surest]
                gone |= {r["doc_id"] for r in surest}
        # Each view learns what the other one is sure of.
        for (sets, y), by, i in ((extra_a, "zb", 0), (extra_b, "za", 1)):
            sets += arrays(x[i] for x in sorted(taught[by]))
            y += [x[2] for x in sorted(taught[by])]
        model.text, model.meta = fit()
    learn.unpersist()
    pack = lambda held: tuple(np.array([r[c] for r in held]) for c in ("za", "zb", "y"))
    held = _blocks(_margins(labelled.where("held"), model).coalesce(tasks), lambda _: 1, BLOCK_ROWS, pack)
    text, meta = _curve(held, lambda za, zb: [za], 1), _curve(held, lambda za, zb: [zb], 1)
    slopes = [(float(max(w[0], 1e-3)), float(w[1])) for w in (text, meta)]
    model.text.slope, model.meta.slope = slopes
    model.mix = _curve(held, lambda za, zb: [s * z + c for z, (s, c) in zip((za, zb), slopes, strict=True)], 2).tolist()
    held.unpersist()
    return model


def _prepared(docs: DataFrame, doc_id: str, text: str, meta_columns: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    there = [c for c in meta_columns if c in docs.columns]
    columns = [_length(docs, c) if c == "n_chars" else F.col(c) for c in there]
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(c.cast("string").alias(f"meta{i}") for i, c in enumerate(columns)))
    return _encoded(named, "doc_id", "text", [f"meta{i}" for i in range(len(columns))]), there


def _chances(m: Model, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    za, zb = m.text.calibrated(m.text.margin(a)), m.meta.calibrated(m.meta.margin(b))
    both = p(m.mix[0] * za + m.mix[1] * zb + m.mix[2]) if m.fixed is None else np.full(len(za), m.fixed)
    return p(za), p(zb), both


_META = ("source", "lang", "n_chars")


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", meta_columns: tuple[str, ...] = _META, rounds: int = ROUNDS, pseudo: int = PSEUDO) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept for each row of ``docs``.

    Scores are chances of label 1; ``kept`` is score >= ``KEEP``. Null and empty
    texts have no words, and missing or null metadata is a value of its own;
    repeated rows are scored each; a document with several labels counts as the
    largest. With fewer than 8 documents of a class (or none) every row scores
    the share of label 1, and 1 without labels. A very long text is encoded whole
    in one task, some 40 bytes for each of its bytes. Extra columns are left out.
    An empty table gives an empty one.
    """
    encoded, there = _prepared(docs, doc_id, text, meta_columns)
    encoded = cut(encoded)
    held = docs.sparkSession.sparkContext.broadcast(train(encoded, labels, doc_id, label, there, rounds, pseudo))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            za, zb, both = _chances(held.value, _sets(b.column("a")), _sets(b.column("b")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(za), pa.array(zb), pa.array(both), pa.array(both >= KEEP)], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return encoded.mapInArrow(run, f"doc_id {kind}, text_score double, meta_score double, score double, kept boolean")


def keep(docs: DataFrame, labels: DataFrame, meta_columns: tuple[str, ...] = _META) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and other columns) that ``score`` keeps, unchanged; they are scored where they lie, without a join.

    Repeated rows get one score and stay or go together; null and empty texts are
    scored like others; columns may have any names; ties at ``KEEP`` stay; an empty
    table gives an empty one, and without labels everything stays.
    """
    encoded, there = _prepared(docs, "doc_id", "text", meta_columns)
    held = docs.sparkSession.sparkContext.broadcast(train(cut(encoded), labels, "doc_id", "quality", there))
    names = docs.columns
    extra = [unused(docs, f"meta{i}") for i in range(len(there))]
    wide = docs.select(*(F.col(f"`{c}`") for c in names), *((_length(docs, c) if c == "n_chars" else F.col(c)).cast("string").alias(m) for c, m in zip(there, extra, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, layout = text_view(*utf8(part.column("text")))
                meta = meta_view(layout, [part.column(m).to_pylist() for m in extra])
                both = _chances(held.value, _joined(sets), _joined(list(meta)))[2]
                yield part.filter(pa.array(both >= KEEP)).select(names)

    return wide.mapInArrow(run, docs.schema)


def _length(docs: DataFrame, column: str):
    """The stated length in steps of a factor of the square root of two."""
    return F.floor(F.log2(F.greatest(F.col(column), F.lit(0)) + 1) * 2)
