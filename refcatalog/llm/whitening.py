"""Embedding whitening by spectrum slicing.

Sums and the scatter matrix come from two passes over all vectors, the second one
about a whole-numbered centre, so that both are exact and the same however tasks
are retried. The leading eigenvalues of the covariance (dimensions squared, on
the driver) are isolated by inertia: an LDL' factorisation of the matrix less a
shift has as many positive pivots as there are eigenvalues above it. Rayleigh
quotient iteration then converges in each interval, and counts on both sides of
what it found certify its number. A third pass projects all vectors, and a fourth
measures the covariance of what came out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .vectors import dimensions, matrix, whole_vectors

_ALPHA = (1 + 17**0.5) / 8


class Factor:
    """P'(A)P = L D L' of a symmetric matrix with pivots of one or two rows, each the largest that is left (Bunch and Parlett)."""

    def __init__(self, a: np.ndarray):
        a, n = a.copy(), len(a)
        self.order, self.lower, self.blocks = np.arange(n), np.eye(n), []
        k = 0
        while k < n:
            own = np.abs(np.diagonal(a)[k:])
            r = k + int(own.argmax())
            off = np.abs(a[k:, k:])
            np.fill_diagonal(off, 0.0)
            most = off.max(initial=0.0)
            wide = 1
            if most and own[r - k] < _ALPHA * most:
                i, j = np.unravel_index(int(off.argmax()), off.shape)
                wide = 2
                self._swap(a, k, k + int(min(i, j)))
                self._swap(a, k + 1, k + int(max(i, j)))
            else:
                self._swap(a, k, r)
            to = k + wide
            pivot = a[k:to, k:to].copy()
            self.blocks.append((k, pivot))
            if to < n and np.abs(pivot).max() > 0:
                column = a[to:, k:to]
                part = np.linalg.solve(pivot, column.T).T
                self.lower[to:, k:to] = part
                a[to:, to:] -= part @ column.T
            k = to

    def _swap(self, a: np.ndarray, i: int, j: int) -> None:
        if i != j:
            both, turned = [i, j], [j, i]
            a[both], self.order[both] = a[turned], self.order[turned]
            a[:, both] = a[:, turned]
            k = min(i, j)
            self.lower[both, :k] = self.lower[turned, :k]

    def positive(self) -> int:
        """Number of positive eigenvalues, by Sylvester's law that of the pivots'."""
        return sum(int((np.linalg.eigvalsh(d) > 0).sum()) for _, d in self.blocks)

    def solve(self, b: np.ndarray, tiny: float) -> np.ndarray:
        """x with A x = b; a pivot of nothing counts as ``tiny``."""
        y = b[self.order].copy()
        for k, d in self.blocks:
            to = k + len(d)
            y[to:] -= self.lower[to:, k:to] @ y[k:to]
        for k, d in self.blocks:
            if len(d) == 1:
                y[k] /= d[0, 0] if abs(d[0, 0]) > tiny else tiny
            else:
                y[k : k + 2] = np.linalg.solve(d, y[k : k + 2])
        for k, d in reversed(self.blocks):
            to = k + len(d)
            y[k:to] -= self.lower[to:, k:to].T @ y[to:]
        x = np.empty_like(y)
        x[self.order] = y
        return x


def above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``v`` above ``shift``."""
    return Factor(v - shift * np.eye(len(v))).positive()


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(the up to ``most`` largest eigenvalues that are not nothing, falling; their unit eigenvectors as columns, the largest entry of each positive).

    Intervals are halved until each holds one eigenvalue, or as many as can't be
    told apart in double precision. Each eigenvalue's number is certified by the
    counts on both sides of it.
    """
    n = len(v)
    size = float(np.linalg.norm(v))  # bounds every eigenvalue
    floor = size * n * 8 * np.finfo(float).eps
    if not size:
        return np.zeros(0), np.zeros((n, 0))
    close = size * 64 * np.finfo(float).eps
    counts: dict[float, int] = {}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(v, shift)
        return counts[shift]

    top = size * (1 + 1e-9)
    want = min(most, count(floor))
    vectors = np.zeros((n, 0))

    def apart(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - vectors @ (vectors.T @ x)
        return x / np.linalg.norm(x)

    # Intervals (low, high] with the counts above each end; upper ones first.
    todo, values = [(floor, top)], []
    rng = np.random.default_rng(7)
    while todo and len(values) < want:
        low, high = todo.pop()
        held = count(low) - count(high)
        if not held or count(high) >= want:
            continue
        if held > 1 and high - low > close:
            middle = (low + high) / 2
            todo += [(low, middle), (middle, high)]
            continue
        found, sure = _within(v, low, high, held, apart, rng, close)
        if found is None:  # the iteration left the interval
            middle = (low + high) / 2
            todo += [(low, middle), (middle, high)]
            continue
        for e, x in found:
            values.append(e)
            vectors = np.column_stack([vectors, apart(x)])
        if held == 1 and sure and (count(values[-1] - close) <= count(high) or count(values[-1] + close) > count(high)):
            raise ArithmeticError("an eigenvalue is not where the counts place it")
    order = np.argsort(-np.array(values), kind="stable")[:want]
    values, vectors = np.array(values)[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values, vectors * signs


def _within(v: np.ndarray, low: float, high: float, held: int, apart, rng, close: float):
    """(pairs of eigenvalue and vector inside an interval that holds ``held`` of them, whether its width tells them apart), or (None, False) if the iteration leaves it."""
    n, tiny = len(v), close / 64
    eye = np.eye(n)
    if held > 1 or high - low <= close:  # a cluster: any basis of its space serves
        factor, out = Factor(v - (low + high) / 2 * eye), []
        block = np.linalg.qr(rng.standard_normal((n, held)))[0]
        for _ in range(4):
            block = np.column_stack([apart(factor.solve(c, tiny)) for c in block.T])
            block = np.linalg.qr(block)[0]
        small, turn = np.linalg.eigh(block.T @ v @ block)
        block = block @ turn
        for k in range(held - 1, -1, -1):
            out.append((float(small[k]), block[:, k]))
        return out, False
    x, e = apart(rng.standard_normal(n)), (low + high) / 2
    factor, known = Factor(v - e * eye), e
    for step in range(60):
        if e != known:
            factor, known = Factor(v - e * eye), e
        x = apart(factor.solve(x, tiny))
        quotient = float(x @ v @ x)
        rest = float(np.linalg.norm(v @ x - quotient * x))
        inside = low < quotient <= high
        if inside and rest <= close:
            return [(quotient, x)], True
        # Inverse iteration from the middle until the quotient is inside, then Rayleigh's.
        if inside and rest < (high - low) / 2:
            e = quotient
        elif step > 30:
            return None, False
    return None, False


def moments(rows: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """(n, exact sums per dimension, covariance) of all vectors v, by two passes; the driver gets ``dim`` and then ``dim`` squared numbers of at most 8 tasks."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for b in batches:
            m = matrix(b.column("v"), dim)
            n += len(m)
            high += (m >> 31).sum(axis=0)
            low += (m & 0x7FFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, n)), pa.array(np.arange(dim)), pa.array(high), pa.array(low)], ["n", "d", "high", "low"])

    told = rows.select("v").mapInArrow(sums, "n long, d long, high long, low long").groupBy("d").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).orderBy("d").collect()
    n, total = told[0]["n"], [(r["high"] << 31) + r["low"] for r in told]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)  # nearest whole number to the mean
    rest = np.array([float(s - n * int(c)) / n for s, c in zip(total, centre, strict=True)])
    held = rows.sparkSession.sparkContext.broadcast(centre)

    def scatter(m: np.ndarray) -> np.ndarray:
        d = (m - held.value).astype(np.float64)
        return d.T @ d

    return n, total, _summed(rows, dim, lambda b: scatter(matrix(b.column("v"), dim))) / n - np.outer(rest, rest)


def _summed(rows: DataFrame, width: int, of) -> np.ndarray:
    """The sum of ``of`` (a matrix of ``width`` columns) over all batches, by one row a task and then 8 tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = of(b) if total is None else total + of(b)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column("m").to_pylist():
                total = np.frombuffer(x) if total is None else total + np.frombuffer(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = rows.mapInArrow(run, "m binary").repartition(8).mapInArrow(add, "m binary").collect()
    return sum(np.frombuffer(r["m"]) for r in parts).reshape(-1, width)


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n, deviation, whitened (array), explained (array), identity_error: one row for each whole vector.

    x is floor(scale * c) of each component; where all of them are moved by the
    same number nothing below changes. ``deviation`` is the exact sum of
    (n * x - S)^2 over the dimensions, null where it passes a long. ``whitened``
    are the deviations from the mean projected on the leading eigenvectors of
    the covariance (divisor n), over the roots of their eigenvalues; at most
    ``components``, and none for an eigenvalue of nothing (constant or dependent
    dimensions, a single row, copies of one row). Equal eigenvalues get some basis
    of their space. ``explained`` are the eigenvalues as shares of the trace, and
    ``identity_error`` is the largest absolute entry of the covariance of what came
    out less the identity, measured over all rows.

    Vectors that are null or hold a null or non-finite component are left out; a
    shorter one has zeros at its end. Null and repeated ids are rows like others.
    Components beyond 2^62 after scaling count as that. Other columns are left
    out, so that their names can't clash; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, n long, deviation long, whitened array<double>"
    rows = cut(whole_vectors(vectors, scale, embedding, vec_id=vec_id))
    dim = dimensions(rows)
    if not dim:  # nobody, or vectors without components
        none = F.array().cast("array<double>")
        return rows.select("vec_id", F.lit(rows.count()).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), none.alias("whitened"), none.alias("explained"), F.lit(None).cast("double").alias("identity_error"))
    n, total, v = moments(rows, dim)
    values, basis = leading(v, components)
    held = spark.sparkContext.broadcast((np.array(total, object), basis / np.sqrt(values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, turn = held.value
        small = max((abs(int(s)) for s in total), default=0) < 1 << 61
        for b in batches:
            m = matrix(b.column("v"), dim)
            reach = max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
            whole = small and n * reach < 1 << 61
            d = m * n - total.astype(np.int64) if whole else m.astype(object) * n - total
            far = np.abs(d).max(initial=0)
            square = (d * d).sum(axis=1) if int(far) ** 2 * dim < 1 << 63 else (d.astype(object) ** 2).sum(axis=1)
            fits = pa.array([x if x < 1 << 63 else None for x in square.tolist()], pa.int64())
            out = (d.astype(np.float64) / n) @ turn
            ends = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32) if out.shape[1] else np.zeros(len(out) + 1, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(np.full(len(m), n)), fits, lists], ["vec_id", "n", "deviation", "whitened"])

    out = rows.mapInArrow(run, schema)
    k = len(values)

    def spread(b: pa.RecordBatch) -> np.ndarray:
        w = np.asarray(b.column("whitened").flatten()).reshape(-1, k)
        return np.vstack([w.sum(axis=0), w.T @ w])

    error = None
    if k:
        seen = _summed(out.select("whitened"), k, spread) / n
        error = float(np.abs(seen[1:] - np.outer(seen[0], seen[0]) - np.eye(k)).max())
    share = F.array(*(F.lit(float(e / np.trace(v))) for e in values)).cast("array<double>")
    return out.withColumns({"explained": share, "identity_error": F.lit(error).cast("double")})
