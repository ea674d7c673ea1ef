"""Vectors of whole numbers: rows whose vector is null or not finite throughout are left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scaled components beyond this count as this.
LARGEST = float(1 << 62)


def finite_rows(column: pa.Array) -> np.ndarray:
    """Numbers of the rows whose list is there and holds neither null nor non-finite components."""
    offsets = np.asarray(column.offsets) - column.offsets[0].as_py()
    values = column.flatten() if column.null_count == 0 else column.values.slice(column.offsets[0].as_py(), int(offsets[-1]))
    bad = np.concatenate([[0], np.cumsum(~np.asarray(pc.fill_null(pc.is_finite(values.cast(pa.float64())), False), bool))])
    return np.flatnonzero(np.asarray(column.is_valid(), bool) & (bad[offsets[1:]] == bad[offsets[:-1]]))


def whole_vectors(vectors: DataFrame, scale: int, embedding: str, **others: str) -> DataFrame:
    """``others`` (new name: column) and v, floor(scale * x) of each component as little-endian 64-bit numbers."""
    names = list(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = finite_rows(b.column("v"))
            taken = b.take(pa.array(keep))
            rows = taken.column("v")
            ends = np.asarray(rows.offsets) - rows.offsets[0].as_py()
            x = np.floor(np.asarray(rows.flatten().cast(pa.float64())) * scale)
            raw = np.clip(x, -LARGEST, LARGEST).astype("<i8").tobytes()
            cells = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((ends * 8).astype(np.int32).tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in names), cells], [*names, "v"])

    kinds = ", ".join(f"{c} {vectors.schema[o].dataType.simpleString()}" for c, o in others.items())
    listed = F.col(embedding).cast("array<double>")
    return vectors.select(*(F.col(o).alias(c) for c, o in others.items()), listed.alias("v")).mapInArrow(run, f"{kinds}, v binary")


def dimensions(rows: DataFrame) -> int:
    """Length of the longest vector; 0 without any."""
    return int((rows.agg(F.max(F.octet_length("v"))).first()[0] or 0) // 8)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` numbers; shorter vectors get zeros at their end."""
    raw = column.to_pylist()
    if all(len(x) == 8 * dim for x in raw):
        return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), dim)
    return np.stack([np.pad(np.frombuffer(x, "<i8"), (0, dim - len(x) // 8)) for x in raw])
