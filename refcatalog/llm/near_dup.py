"""Near-duplicate groups by HyperMinHash sketches, confirmed on full shingle sets.

A sketch has ``REGISTERS`` buckets. The bucket of a shingle hash is its place in
the 64-bit range, and the bucket keeps of its smallest hash only the count of
leading zeros and ``MANTISSA`` bits after the first one. Buckets that stay empty
are filled by re-hashing the whole set, so that two sets agree in each register
with the probability of their Jaccard index, whatever their sizes. Bands of
``ROWS`` registers make candidates; a collision-corrected estimate drops pairs
far below the threshold (by ``SLACK`` standard deviations), and every link is
confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import NON_SPACE, mix, shingles, slices, utf8, word_hashes, words
from .components import connected_components
from .shared import cut, partitions, unused

REGISTERS, ROWS, MANTISSA = 200, 5, 10
BANDS = REGISTERS // ROWS
#: Standard deviations of the estimate below the threshold at which a candidate goes without a full check.
SLACK = 5.0
#: Rounds of re-hashing all buckets, before each empty one gets a hash function of its own.
REFILLS = 16
#: Rows, and shingles, of one side of a block in which members of a bucket are compared across components.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000

_BOUNDS = (np.arange(REGISTERS + 1, dtype=object) * (1 << 64) // REGISTERS)[:-1].astype(np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1000 + REGISTERS, dtype=np.uint64) * _STEP


def _least(values: np.ndarray, least: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Put the smallest of the sorted ``values`` in each still empty bucket; returns which stay empty."""
    at = np.searchsorted(values, _BOUNDS[empty])
    got = np.minimum(at, len(values) - 1)
    upper = np.where(empty + 1 < REGISTERS, _BOUNDS[np.minimum(empty + 1, REGISTERS - 1)] - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
    fits = (at < len(values)) & (values[got] <= upper)
    least[empty[fits]] = values[got[fits]] - _BOUNDS[empty[fits]]
    return empty[~fits]


def sketch(sorted_set: np.ndarray) -> bytes:
    """Registers of a non-empty set of 64-bit hashes, as little-endian 16-bit numbers."""
    least = np.zeros(REGISTERS, np.uint64)
    empty = _least(sorted_set, least, np.arange(REGISTERS))
    for t in range(1, REFILLS + 1):
        if not len(empty):
            break
        empty = _least(np.sort(mix(sorted_set + _STEPS[t])), least, empty)
    for j in empty.tolist():
        least[j] = mix(sorted_set + _STEPS[1000 + j]).min() // np.uint64(REGISTERS)
    return compress(least).tobytes()


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros (upper 6 bits) and the ``MANTISSA`` bits after the first one, of values below 2^64 / REGISTERS."""
    high = (least * np.uint64(REGISTERS)) >> np.uint64(11)
    zeros = (53 - np.frexp(high.astype(np.float64))[1]).astype(np.uint64)
    after = (high << (zeros + np.uint64(1))) & np.uint64((1 << 53) - 1)
    return (zeros << np.uint64(MANTISSA) | after >> np.uint64(53 - MANTISSA)).astype("<u2")


def collision_rate(n: int = 0) -> float:
    """Chance that two different minima share a register: sums over zeros of 4^-(z+1), each with 2^-MANTISSA."""
    return (1 / 3) * 2.0**-MANTISSA


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard index from the count of equal registers, corrected for collisions."""
    c = collision_rate()
    return np.clip((equal / REGISTERS - c) / (1 - c), 0, 1)


def candidate_floor(percent: int) -> float:
    """The estimate below which a pair at the threshold falls with negligible probability."""
    p = percent / 100
    return p - SLACK * (p * (1 - p) / REGISTERS) ** 0.5


def _sets(part: pa.RecordBatch, k: int) -> list[np.ndarray]:
    data, offsets = utf8(part.column("text"))
    starts, ends, firsts = words(data, offsets, NON_SPACE)
    return shingles(word_hashes(data, starts, ends), firsts, k)


def signatures(docs: DataFrame, doc_id: str, text: str, k: int, sketched: bool = True) -> DataFrame:
    """doc_id, n_shingles, two 64-bit digests of the set, and its sketch (null for an empty set, or if not ``sketched``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, d1, d2, sketches = [], [], [], []
                for one in _sets(part, k):
                    n.append(len(one))
                    for held, x in zip((d1, d2), _digests(one), strict=True):
                        held.append(x)
                    sketches.append(sketch(one) if len(one) and sketched else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "sketch"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sketch binary")


def _bloom_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return np.stack([(h & np.uint64(bits - 1)), (h >> np.uint64(32)) & np.uint64(bits - 1)])


def _bloom(ids: DataFrame) -> tuple[bytes, int]:
    """A bitmap of ids, 2^17 to 2^28 bits (32 MB) whatever their number; it only saves work, as extra ids do no harm."""
    count = ids.count()
    bits = 1 << min(28, max(17, int(np.ceil(np.log2(max(1, count) * 10)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = np.unique(_bloom_bits(np.asarray(b.column(0)), bits))
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        word = held.view(np.int64)
        at = np.flatnonzero(word)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(word[at])], ["at", "word"])

    # A task per two million 8-byte ids, up to 128; the bitmap is bounded, and so is what the driver gets.
    rows = ids.coalesce(min(128, max(8, count >> 21))).mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    held = np.zeros(bits // 64, np.int64)
    held[rows["at"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64)
    return held.tobytes(), bits


def _digests(one: np.ndarray) -> tuple[int, int]:
    if not len(one):
        return 0, 0
    return int(one.sum(dtype=np.uint64).view(np.int64)), int(mix(one ^ _STEP).sum(dtype=np.uint64).view(np.int64))


_CLASS = ["d1", "d2", "n_shingles"]


def _sets_of(docs: DataFrame, doc_id: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """node and full set (sorted 64-bit hashes as bytes) of the ``wanted`` classes (node, rep, d1, d2, n_shingles).

    Rows whose id is no class's ``rep`` are skipped before shingling; of the others
    those with the digests of the class count, as an id may come with several texts.
    """
    bitmap, bits = _bloom(wanted.select("rep"))
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            at = _bloom_bits(np.asarray(batch.column("doc_id")), bits)
            there = (known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            batch = batch.filter(pa.array(there.all(axis=0)))
            for part in slices(batch):
                sets = _sets(part, k)
                digests = [_digests(x) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", *_CLASS, "shingles"])

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.mapInArrow(run, "rep long, d1 long, d2 long, n_shingles long, shingles binary").where("n_shingles > 0")
    met = rows.hint("shuffle_merge").join(wanted.select("node", "rep", *_CLASS), ["rep", *_CLASS])
    return cut(met.dropDuplicates(["rep", *_CLASS]).select("node", "shingles"))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """Of (a, b) candidates, those whose full sets reach the threshold."""
    floor = candidate_floor(percent)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("sa", "sb"))
            n, m = (np.asarray(b.column(c)) for c in ("na", "nb"))
            fits = (estimate((x == y).sum(axis=1)) >= floor) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield b.filter(pa.array(fits)).select(["a", "b"])

    side = lambda x: classes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    near_pairs = cut(pairs.hint("shuffle_merge").join(side("a"), "a").hint("shuffle_merge").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(near, "a long, b long"))
    nodes = near_pairs.select(F.col("a").alias("node")).union(near_pairs.select("b")).distinct()
    sets = _sets_of(docs, doc_id, text, k, _wanted(nodes, classes))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column("ka").to_pylist(), b.column("kb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield b.filter(pa.array(linked, pa.bool_())).select(["a", "b"])

    own = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"k{x}"))
    return cut(near_pairs.hint("shuffle_merge").join(own("a"), "a").hint("shuffle_merge").join(own("b"), "b").select("a", "b", "ka", "kb").mapInArrow(full, "a long, b long"))


def _wanted(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    return cut(nodes.hint("shuffle_merge").join(classes.select("node", "rep", *_CLASS), "node"))


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys, of batches that are sorted by them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        table = pa.Table.from_batches(rest)
        own = np.stack([np.asarray(table.column(c)).astype(np.int64) for c in keys])
        edges = np.concatenate([[0], np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield table.slice(a, b - a)
        rest = table.slice(int(edges[-1])).combine_chunks().to_batches()  # the last group may go on in the next batch
    if rest:
        yield pa.Table.from_batches(rest)


_BLOCK_KEYS = ("key", "x", "y")


def _near_in_block(g: pa.Table, floor: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a block whose components differ, whose estimate reaches the floor, and whose first equal band is the block's own."""
    sketches = np.frombuffer(b"".join(g.column("sketch").to_pylist()), "<u2").reshape(-1, REGISTERS)
    comp, mine, band = (np.asarray(g.column(c)) for c in ("component", "mine", "band"))
    two = g.column("x")[0].as_py() != g.column("y")[0].as_py()
    first = np.flatnonzero(mine == mine.min()) if two else np.arange(len(comp))
    second = np.flatnonzero(mine != mine.min()) if two else first
    for i in first.tolist():
        js = second[(comp[second] != comp[i]) & (two | (second > i))]
        if len(js):
            same = sketches[js] == sketches[i]
            near = estimate(same.sum(axis=1)) >= floor
            near &= same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band[i]
            if near.any():
                yield i, js[near]


def _blocked(members: DataFrame) -> DataFrame:
    return members.repartition(partitions(members), *_BLOCK_KEYS).sortWithinPartitions(*_BLOCK_KEYS)


def _cross_links(members: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """Confirmed links between different components that share a bucket.

    members: key, band, n (rows of the bucket), weight (shingles of its rows),
    node, component, sketch. A bucket is cut into blocks by a hash of the node, so
    that a block has about ``BLOCK`` rows and ``BLOCK_SHINGLES`` shingles at
    most; each pair of blocks is one group, so the work in a bucket of n members
    that stay unlinked grows with n squared, in tasks of bounded size. A first
    pass over the sketches finds the members that have a near partner, and only
    these get their full sets; the second pass confirms. Pairs are looked at in
    the first band they share, and never leave their block unless they are links.
    """
    floor = candidate_floor(percent)
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "band", "mine", "node", "component", "sketch")
    names = own.columns

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches, _BLOCK_KEYS):
            found = np.zeros(g.num_rows, bool)
            for i, js in _near_in_block(g, floor):
                found[i] = True
                found[js] = True
            if found.any():
                yield from g.filter(pa.array(found)).select(names).combine_chunks().to_batches()

    left = cut(_blocked(own).mapInArrow(near, own.schema))
    sets = _sets_of(docs, doc_id, text, k, _wanted(left.select("node").distinct(), classes))
    held = left.hint("shuffle_merge").join(sets, "node")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches, _BLOCK_KEYS):
            ids, comp = np.asarray(g.column("node")), np.asarray(g.column("component"))
            full = [np.frombuffer(x, np.uint64) for x in g.column("shingles").to_pylist()]
            out = []
            for i, js in _near_in_block(g, floor):
                linked: set[int] = set()  # one link to a component is enough
                for j in js.tolist():
                    if comp[j] in linked or 100 * min(len(full[i]), len(full[j])) < percent * max(len(full[i]), len(full[j])):
                        continue
                    shared = len(np.intersect1d(full[i], full[j], assume_unique=True))
                    if 100 * shared >= percent * (len(full[i]) + len(full[j]) - shared):
                        linked.add(comp[j])
                        out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*out, strict=True)], ["a", "b"])

    return cut(_blocked(held).mapInArrow(confirm, "a long, b long").distinct())


def _classed(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(signatures of the rows, classes of equal sets: d1, d2, n_shingles, root, component_id).

    ``root`` names the class's connected component, ``component_id`` is the smallest
    id of any row in it. A class is a node of its own, whatever ids its rows share
    with others.
    """
    sigs = cut(signatures(docs, doc_id, text, k))
    some = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy(*_CLASS).agg(F.min("doc_id").alias("rep"), F.max("sketch").alias("sketch"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))  # fixed by being written
    band = F.xxhash64("band", F.expr(f"substring(sketch, band * {2 * ROWS} + 1, {2 * ROWS})"))
    bands = cut(classes.select("node", "n_shingles", "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).select("node", "n_shingles", "band", band.alias("key")))
    buckets = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = bands.hint("shuffle_hash").join(buckets, "key").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    edges = _confirmed(stars, classes, docs, doc_id, text, k, percent)
    labels = cut(connected_components(edges))

    named = cut(bands.hint("shuffle_merge").join(labels, "node", "left").select("key", "band", "node", "n_shingles", F.coalesce("component", "node").alias("component")))
    still = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight")).where("lo <> hi").select("key", "n", "weight")
    members = named.drop("n_shingles").hint("shuffle_hash").join(still, "key").hint("shuffle_merge").join(classes.select("node", "sketch"), "node")
    more = _cross_links(members.select("key", "band", "n", "weight", "node", "component", "sketch"), classes, docs, doc_id, text, k, percent)
    if more.limit(1).count():
        labels = cut(connected_components(edges.unionByName(more)))

    rooted = cut(classes.select("node", "rep", *_CLASS).hint("shuffle_merge").join(labels, "node", "left").select(*_CLASS, "rep", F.coalesce("component", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return sigs.select("doc_id", *_CLASS), rooted.hint("shuffle_merge").join(least, "root").select(*_CLASS, "root", "component_id")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for each row of ``docs``.

    Words are runs of anything but blanks and tab to carriage return, with A-Z
    lower-cased; a document's set is its distinct ``k``-word shingles, or its
    whole sequence if it has fewer words. Two documents are linked if
    100 * |intersection| >= percent * |union|; component_id is the smallest id
    reachable and kept marks it. Null, empty and blank texts have an empty set
    and are linked with nothing, themselves kept. Equal sets form one class
    before any pair is made, so copies are never expanded. Every row is a document
    of its own: an id that comes with several texts takes part with each of them.
    A null id is kept, with a null component. Extra columns are left out. An empty
    table gives an empty one. A very long text is one set, 8 bytes a shingle.

    Within a bucket, all members are first compared with its first class; only
    buckets that still hold more than one component are compared further, in
    blocks, and only across components. No bucket or candidate is capped.
    """
    sigs, classes = _classed(docs, doc_id, text, k, percent)
    out = sigs.hint("shuffle_merge").join(classes.select(*_CLASS, "component_id"), _CLASS, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, with the smallest id; all columns as they are.

    Rows without an id and texts without words stay, though of rows that repeat
    such a text under one id one stays. Of several rows of a group that share its smallest id
    (a row that was landed twice) one stays; of those with unequal texts it is an arbitrary one. An
    empty table gives an empty one; see ``groups`` for the rest.
    """
    sigs, classes = _classed(docs, doc_id, text, k, percent)
    own = F.coalesce("component_id", "doc_id")
    rows = cut(sigs.where("doc_id is not null").hint("shuffle_merge").join(classes, _CLASS, "left").select("doc_id", *_CLASS, "root", (F.col("doc_id") == own).alias("kept")))
    # Of each id: whether any row of it goes, and whether several stay. Most ids have neither.
    seen = rows.groupBy("doc_id").agg(F.count_if("kept").alias("stay"), F.count_if(~F.col("kept")).alias("go"))
    odd = cut(seen.where("go > 0 or stay > 1").select("doc_id", ((F.col("stay") == 0)).alias("all_go")))
    names, key = docs.columns, unused(docs, "doc")
    ided = docs.withColumn(key, F.col(doc_id).cast("long"))
    plain = ided.hint("shuffle_merge").join(odd.select(F.col("doc_id").alias(key)), key, "left_anti").select(*names)
    mixed = odd.where("not all_go").select(F.col("doc_id").alias(key))
    if not mixed.limit(1).count():
        return plain
    some = ided.hint("shuffle_merge").join(mixed, key, "left_semi")
    return plain.unionByName(_one_each(some, rows.where("kept"), key, text, k).select(*names))


def _one_each(docs: DataFrame, rows: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Of the rows of ids that several rows share: one of each component of those that are kept."""
    names, own = docs.columns, [unused(docs, c) for c in _CLASS]
    root = unused(docs, "root")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                sets = _sets(pa.RecordBatch.from_arrays([part.column(text)], ["text"]), k)
                digests = [(*_digests(x), len(x)) for x in sets]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([d[i] for d in digests], pa.int64()) for i in range(3))], [*part.schema.names, *own])

    told = rows.select(F.col("doc_id").alias(key), *(F.col(c).alias(n) for c, n in zip(_CLASS, own, strict=True)), F.coalesce("root", F.lit(-1).cast("long")).alias(root)).distinct()
    met = docs.mapInArrow(run, schema).hint("shuffle_merge").join(told, [key, *own])
    return met.dropDuplicates([key, root]).select(*names)
