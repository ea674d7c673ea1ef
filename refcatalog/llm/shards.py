"""Sharding by histogram sort, with DataFrame operations only.

Every row has a key of 192 bits: a hash of its text, a hash of its id, and its
place in the table, so that equal texts lie side by side and a group of copies of
any size can still be split. Splitters start from the whole key range. Each round
counts the exact bytes and rows in every cell below the current candidates, for
all partitions at once, and narrows each splitter to the one cell that holds its
target, until that cell is lighter than the tolerance. Then the rows are
exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Bits of a key by which a round refines a splitter: 2^11 cells for each.
DIGIT = 11
#: A splitter may miss its target by this share of a shard's bytes.
TOLERANCE = 0.001
#: Rows that are numbered together in one task, on average.
RUN_ROWS = 50_000

_TOP = 1 << 63


def _signed(x: int) -> int:
    return x - _TOP


def _word(key: int, level: int) -> int:
    return key >> (64 * (2 - level)) & ((1 << 64) - 1)


def _digit(level: int, shift: int, width: int) -> Column:
    flipped = F.col(f"k{level}").bitwiseXOR(F.lit(-_TOP))
    return F.shiftrightunsigned(flipped, shift).bitwiseAND(F.lit((1 << width) - 1))


def _within(lo: int, level: int, shift: int) -> Column:
    """Rows whose key shares ``lo``'s bits above ``shift`` of word ``level``."""
    cond = F.lit(True)
    for k in range(level):
        cond = cond & (F.col(f"k{k}") == F.lit(_signed(_word(lo, k))))
    if shift < 64:
        a = _word(lo, level)
        cond = cond & F.col(f"k{level}").between(_signed(a), _signed(a + (1 << shift) - 1))
    return cond


def splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """Keys that cut ``keyed`` (k0, k1, k2, size) into shards of nearly equal bytes; exact counts, refined until they fit."""
    total = keyed.agg(F.sum("size").alias("b")).first()["b"] or 0
    slack = max(1, int(total / shards * tolerance))
    # Of each splitter: the cell's first key, bytes below it, and the word and bits that are still open.
    open_: dict[int, tuple[int, int, int, int]] = {i: (0, 0, 0, 64) for i in range(1, shards)}
    found: dict[int, int] = {}
    while open_ and total:
        cells = sorted({(lo, level, left) for lo, _, level, left in open_.values()})
        which, digit = F.lit(None).cast("int"), F.lit(None).cast("long")
        for n, (lo, level, left) in reversed(list(enumerate(cells))):
            inside, width = _within(lo, level, left), min(DIGIT, left)
            which = F.when(inside, F.lit(n)).otherwise(which)
            digit = F.when(inside, _digit(level, left - width, width)).otherwise(digit)
        # At most 2^11 rows for each splitter.
        counted: dict[int, list] = {n: [] for n in range(len(cells))}
        ends = [f(f"k{k}").alias(f"{a}{k}") for k in range(3) for f, a in ((F.min, "lo"), (F.max, "hi"))]
        for r in keyed.select(which.alias("which"), digit.alias("digit"), "size", "k0", "k1", "k2").where("which is not null").groupBy("which", "digit").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *ends).collect():
            counted[r["which"]].append(r)
        for i, (lo, below, level, left) in list(open_.items()):
            width = min(DIGIT, left)
            target = i * total / shards
            for r in sorted(counted[cells.index((lo, level, left))], key=lambda r: r["digit"]):
                if below + r["bytes"] >= target:
                    break
                below += r["bytes"]
            unit = 1 << (64 * (2 - level) + left - width)
            start = lo + r["digit"] * unit
            if r["bytes"] <= slack or r["rows"] == 1:
                near = target - below <= r["bytes"] / 2
                found[i] = start if near else start + unit
                del open_[i]
                continue
            left -= width
            first = start
            for k in range(level, 3):  # bits that all rows of the cell share need no rounds of their own
                if r[f"lo{k}"] != r[f"hi{k}"]:
                    common = 64 - (((r[f"lo{k}"] + _TOP) ^ (r[f"hi{k}"] + _TOP)).bit_length())
                    level, left = k, 64 - common
                    first = (first >> (64 * (3 - k)) << (64 * (3 - k))) | ((r[f"lo{k}"] + _TOP) >> left << left) << (64 * (2 - k))
                    break
                first = (first >> (64 * (3 - k)) << (64 * (3 - k))) | (r[f"lo{k}"] + _TOP) << (64 * (2 - k))
            open_[i] = (first, below, level, left)
    return [found.get(i, 1 << 192) for i in range(1, shards)]


def _from(key: int) -> Column:
    """Rows at or above ``key``."""
    if key >= 1 << 192:
        return F.lit(False)
    a, b, c = (F.lit(_signed(_word(key, k))) for k in range(3))
    return (F.col("k0") > a) | ((F.col("k0") == a) & ((F.col("k1") > b) | ((F.col("k1") == b) & (F.col("k2") >= c))))


def shard(docs: DataFrame, shards: int = 16, tolerance: float = TOLERANCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``.

    The law is ``bytes``: each shard holds nearly the same sum of sizes (UTF-8
    bytes of the text plus 1; null: 1), to within ``tolerance`` of a shard and
    the size of one document. Rows of equal texts follow one another in key
    order, so that a group is cut only where a splitter falls into it. Slots
    number each shard's rows from 0 without gaps. Repeated rows, null texts and
    null ids are rows like others; extra columns are left out; an empty table
    gives an empty one.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k0"), F.xxhash64(doc_id).alias("k1"), F.monotonically_increasing_id().alias("k2"))
    keyed = cut(rows)
    bounds = splitters(keyed, shards, tolerance)
    own = F.lit(0)
    for b in bounds:
        own = own + _from(b).cast("int")
    count = keyed.count()
    runs = max(1, -(-count // (shards * RUN_ROWS)))
    placed = keyed.withColumn("shard", own).withColumn("run", F.pmod(F.xxhash64("k2"), F.lit(runs)))
    sizes = placed.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "run").orderBy("k0", "k1", "k2")))
    out = numbered.join(base.hint("shuffle_hash"), ["shard", "run"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
