"""Exact top-k inner products: norm-sorted blocks, rotated partial sums and Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, partitions

#: Vectors of a candidate block and of a query block.
BLOCK, QUERIES = 4096, 256
#: Leading dimensions of the rotated vectors after which partial sums are held against the bound, as shares.
HEADS = (0.125, 0.25, 0.5)
#: Share of a block's pairs that must be left for one product of whole matrices to be cheaper than one per query.
MANY = 0.25


def _clean(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """row, vec_id, norm, v (doubles as bytes): scaled and floored components; rows without a full vector or an id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out, norms = [], [], []
            for r, x in enumerate(b.column("embedding").to_pylist()):
                if x is None or any(c is None for c in x):
                    continue
                v = np.floor(np.array(x, np.float64) * scale)
                if np.isfinite(v).all():
                    keep.append(r)
                    out.append(v.astype("<f8").tobytes())
                    norms.append(float(np.sqrt((v * v).sum())))
            taken = b.select(["row", "vec_id"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(norms, pa.float64()), pa.array(out, pa.binary())], ["row", "vec_id", "norm", "v"])

    rows = vectors.where(F.col(vec_id).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    return rows.mapInArrow(run, "row long, vec_id long, norm double, v binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal length; shorter vectors get zeros at their end."""
    raw = column.to_pylist()
    if all(len(x) == 8 * dim for x in raw):
        return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), dim)
    return np.stack([np.pad(np.frombuffer(x, "<f8"), (0, dim - len(x) // 8)) for x in raw]) if raw else np.zeros((0, dim))


def _rotation(clean: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, from the sum of their outer products (dim x dim, summed in two steps)."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column("v"), dim)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            for x in b.column("g").to_pylist():
                total += np.frombuffer(x).reshape(dim, dim)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    parts = clean.select("v").mapInArrow(gram, "g binary").repartition(8).mapInArrow(add, "g binary").collect()
    total = sum((np.frombuffer(r["g"]).reshape(dim, dim) for r in parts), np.zeros((dim, dim)))
    return np.linalg.eigh(total)[1][:, ::-1]


def _blocks(rows: DataFrame, size: int, dim: int, basis) -> DataFrame:
    """block, norm (largest), ids, rows, m, turned, tails: consecutive rows of a partition, ``size`` to a block, as one matrix each.

    ``turned`` are the rows in the rotated basis (a broadcast), ``tails`` their
    lengths beyond each of the ``HEADS``; both are computed once for each row, and
    held in single precision, which ``left_over`` allows for.
    """
    cuts = _heads(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, n = TaskContext.get().partitionId(), 0
        held, count = [], 0

        def emit(table: pa.Table) -> pa.RecordBatch:
            nonlocal n
            t = table.combine_chunks()
            ids, row, norm = (np.asarray(t.column(c)) for c in ("vec_id", "row", "norm"))
            m = _matrix(pa.chunked_array(t.column("v")), dim)
            turned = m @ basis.value
            tails = np.stack([np.sqrt((turned[:, h:] ** 2).sum(axis=1)) for h in cuts])
            n += 1
            raw = [ids.astype("<i8"), row.astype("<i8"), m.astype("<f8"), turned.astype("<f4"), tails.astype("<f4")]
            return pa.RecordBatch.from_arrays([pa.array([here << 32 | n]), pa.array([float(norm.max())]), *(pa.array([x.tobytes()], pa.binary()) for x in raw)], ["block", "norm", "ids", "rows", "m", "turned", "tails"])

        for b in batches:
            while b.num_rows:
                part = b.slice(0, size - count)
                held.append(part)
                count += part.num_rows
                b = b.slice(part.num_rows)
                if count == size:
                    yield emit(pa.Table.from_batches(held))
                    held, count = [], 0
        if count:
            yield emit(pa.Table.from_batches(held))

    return rows.select("row", "vec_id", "norm", "v").mapInArrow(run, "block long, norm double, ids binary, rows binary, m binary, turned binary, tails binary")


def _heads(dim: int) -> list[int]:
    return sorted({max(1, int(dim * h)) for h in HEADS})


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of q and v."""
    most = (np.abs(q).max(initial=0) + 1) * (np.abs(v).max(initial=0) + 1) * max(1, q.shape[1])
    if most < 2**52:
        return (q @ v.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return (whole(q) @ whole(v).T).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 8 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def left_over(tq: np.ndarray, tv: np.ndarray, rq: np.ndarray, rv: np.ndarray, length: np.ndarray, floor: np.ndarray, reach: float, cuts: list[int]) -> np.ndarray:
    """Pairs (query, candidate) that can still reach the query's ``floor``, by partial sums up to each of ``cuts`` and the remaining lengths; rounding in single precision is allowed for."""
    least = floor - 1e-6 - 4e-7 * tq.shape[1] * length * reach
    fits = np.repeat((length * reach >= least)[:, None], len(tv), axis=1)
    total, done = np.zeros(fits.shape, np.float32), 0
    for step, to in enumerate(cuts):
        if not fits.any():
            break
        total += tq[:, done:to] @ tv[:, done:to].T
        done = to
        fits &= total + rq[step][:, None] * rv[step][None, :] >= least[:, None]
    return fits


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the ``k`` best other rows.

    Components count as floor(scale * x); a score is the integer inner product,
    and ties go to the smaller vec_id. Vectors that are null or hold a null or
    non-finite component, and rows without an id, take no part; a shorter vector
    has zeros at its end. A repeated row is a candidate like others, for its
    copies too, and a query of its own. Extra columns are left out; an empty
    table gives an empty one, and with fewer than ``k`` others all are returned.

    Candidates are range-sorted by descending length into blocks. The first
    block gives each query a lower bound of its k-th score, and so each block of
    queries the number of candidate blocks whose largest length can still reach
    it; only these are joined. Within a pair of blocks, sums over more and more
    leading rotated dimensions plus the product of the remaining lengths decide
    which pairs are left; their exact products are taken one query at a time, or
    as one matrix product where most are left. Bounds only skip what cannot be
    among the best.
    """
    spark = vectors.sparkSession
    clean = cut(_clean(vectors, vec_id, embedding, scale))
    dim = int((clean.agg(F.max(F.octet_length("v"))).first()[0] or 8) // 8) or 1
    held_basis = spark.sparkContext.broadcast(_rotation(clean, dim))

    sized = clean.repartitionByRange(partitions(vectors), F.desc("norm"), F.col("vec_id"), F.col("row")).sortWithinPartitions(F.desc("norm"), "vec_id", "row")
    blocks = cut(_blocks(sized, BLOCK, dim, held_basis))
    # 16 bytes for each block of 4096 vectors.
    reach = sorted(((r["norm"], -r["block"]) for r in blocks.select("norm", "block").collect()), reverse=True)
    if not reach:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    falling = np.array([-n * (1 + 1e-9) - 1e-6 for n, _ in reach])
    nth = spark.createDataFrame([(-b, i + 1, n) for i, (n, b) in enumerate(reach)], "block long, nth int, reach double")
    first = blocks.where(F.col("block") == -reach[0][1]).select("ids", "rows", "m").collect()  # one block: at most BLOCK vectors
    held_first = spark.sparkContext.broadcast([(r["ids"], r["rows"], r["m"]) for r in first])
    asked = clean.where(F.pmod("vec_id", F.lit(every)) == 0).repartition(partitions(vectors), "row")
    queries = _blocks(asked, QUERIES, dim, held_basis)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = held_first.value
        for b in batches:
            floors, needs = [], []
            for rows, m in zip(b.column("rows").to_pylist(), b.column("m").to_pylist(), strict=True):
                row, q = np.frombuffer(rows, "<i8"), np.frombuffer(m, "<f8").reshape(-1, dim)
                floor = np.full(len(row), -np.inf)
                for _, other, v in seed:
                    other, v = np.frombuffer(other, "<i8"), np.frombuffer(v, "<f8").reshape(-1, dim)
                    s = _scores(q, v).astype(np.float64)
                    s[row[:, None] == other[None, :]] = -np.inf
                    if s.shape[1] >= k:
                        floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                length = np.sqrt((q * q).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(length > 0, floor / length, np.where(floor > 0, np.inf, -np.inf))
                floors.append(floor.astype("<f8").tobytes())
                needs.append(int(np.searchsorted(falling, -need.min(), "right")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("ids", "rows", "m", "turned", "tails")), pa.array(floors, pa.binary()), pa.array(needs, pa.int32())], ["qids", "qrows", "q", "tq", "rq", "floors", "upto"])

    queries = cut(queries.mapInArrow(bound, "qids binary, qrows binary, q binary, tq binary, rq binary, floors binary, upto int"))
    numbered = blocks.hint("shuffle_hash").join(nth.hint("shuffle_hash"), "block").drop("block", "norm")
    pairs = queries.where("upto > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("upto")))).drop("upto")
    pairs = pairs.hint("shuffle_hash").join(numbered, "nth")
    cuts = _heads(dim)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                whole = lambda c, kind="<f8", r=r: np.frombuffer(r[c], kind).reshape(-1, dim)
                qid, qrow, floor = np.frombuffer(r["qids"], "<i8"), np.frombuffer(r["qrows"], "<i8"), np.frombuffer(r["floors"], "<f8")
                ids, row = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["rows"], "<i8")
                q, v, tq, tv = whole("q"), whole("m"), whole("tq", "<f4"), whole("turned", "<f4")
                rq, rv = (np.frombuffer(r[c], "<f4").reshape(len(cuts), -1) for c in ("rq", "tails"))
                fits = left_over(tq, tv, rq, rv, np.sqrt((q * q).sum(axis=1)), floor, r["reach"], cuts)
                fits &= qrow[:, None] != row[None, :]
                out = [[], [], [], []]
                asked = np.flatnonzero(fits.any(axis=1))
                scores = _scores(q[asked], v) if fits.mean() > MANY else None
                for n, i in enumerate(asked.tolist()):
                    at = np.flatnonzero(fits[i])
                    s = _scores(q[i : i + 1], v[at])[0] if scores is None else scores[n, at]
                    top = _best(s, ids[at], k)
                    for held, x in zip(out, (np.full(len(top), qrow[i]), np.full(len(top), qid[i]), ids[at][top], s[top]), strict=True):
                        held.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["qrow", "query_id", "vec_id", "score"])

    near = pairs.select("qids", "qrows", "q", "tq", "rq", "floors", "ids", "rows", "m", "turned", "tails", "reach").mapInArrow(match, "qrow long, query_id long, vec_id long, score long")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
