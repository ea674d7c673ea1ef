"""What ordered rows do to the venue and year of one paper, as summaries that can be joined.

A row may name a venue or a placeholder, and a year that is trusted or not. A
named venue is taken; a placeholder tidies a venue that is known with the year
held before it, and replaces any other; a trusted year is taken, another fills.
Summaries of consecutive rows have a fixed size and joining them is associative,
so that the rows of one paper, however many, can be folded in several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written


class Moves(NamedTuple):
    year: int | None  # the first one known
    trusted: int | None  # the last trusted one
    real: str | None  # the last named venue
    junk: str | None  # the last placeholder after it
    met: bool  # whether there is a placeholder after it, and what was known before the first one
    met_trusted: int | None
    met_year: int | None
    dated: bool  # the same of the first one before which these rows knew a year
    dated_trusted: int | None
    dated_year: int | None


def _or(a, b):
    return b if a is None else a


def row_moves(real: str | None, junk: str | None, year: int | None, trusted: int | None) -> Moves:
    """One row: its placeholder comes before its year."""
    return Moves(year, trusted, real, junk, junk is not None, None, None, False, None, None)


def then(a: Moves, b: Moves) -> Moves:
    """The rows of ``a``, then those of ``b``."""
    met = (b.met, _or(b.met_trusted, a.trusted), _or(a.year, b.met_year))
    dated = met if b.met and a.year is not None else (b.dated, _or(b.dated_trusted, a.trusted), _or(a.year, b.dated_year))
    if b.real is None:
        met = (a.met, a.met_trusted, a.met_year) if a.met else met
        dated = (a.dated, a.dated_trusted, a.dated_year) if a.dated else dated
    junk = b.junk if b.real is not None else _or(b.junk, a.junk)
    return Moves(_or(a.year, b.year), _or(b.trusted, a.trusted), _or(b.real, a.real), junk, *met, *dated)


_KINDS = "matched {}, seq long, year int, trusted int, real string, junk string, met boolean, met_trusted int, met_year int, dated boolean, dated_trusted int, dated_year int"


def _runs(of) -> object:
    """Joins consecutive rows of one paper; a paper that spans tasks has a row of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paper, start, held, out = None, None, None, []
        for batch in batches:
            batch = batch.astype(object).where(batch.notna(), None)
            for matched, seq, *rest in batch.itertuples(index=False, name=None):
                if matched == paper:
                    held = then(held, of(*rest))
                    continue
                if held is not None:
                    out.append((paper, start, *held))
                paper, start, held = matched, seq, of(*rest)
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _KINDS.split(", ")])
                out = []
        if held is not None:
            out.append((paper, start, *held))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _KINDS.split(", ")])
        whole = [c.split()[0] for c in _KINDS.split(", ") if c.endswith(" int")]
        yield frame.astype({c: "Int32" for c in whole})

    return run


def folded(rows: DataFrame) -> DataFrame:
    """``Moves`` of each ``matched``, over rows (matched, seq, real, junk, year, trusted) in order of seq.

    Rows are range-sorted by paper and place, so that a paper of many rows is
    shared out; each task leaves one summary of each of its papers, and only those
    are brought together.
    """
    rows = written(rows.select("matched", "seq", "real", "junk", F.col("year").cast("int").alias("year"), F.col("trusted").cast("int").alias("trusted")))
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order, kinds = ["matched", "seq"], _KINDS.format(rows.schema["matched"].dataType.simpleString())
    some = rows.repartitionByRange(width, *order).sortWithinPartitions(*order).mapInPandas(_runs(row_moves), kinds)
    return some.repartition(width, "matched").sortWithinPartitions(*order).mapInPandas(_runs(Moves), kinds).drop("seq")
