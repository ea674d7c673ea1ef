"""Toxicity by compression distance: two zstandard dictionaries, window by window.

Both dictionaries end in the same base, trained on ordinary windows; before it
each has the words and word beginnings that are typical of its own class. A
window whose text the toxic dictionary describes in fewer bytes than the ordinary
one speaks for toxicity. A document's differences (largest, mean, share and
number above a bound) go through a calibrated logistic curve.
"""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled rows that a model is fitted on: rows of each class (those of the smallest hash), bytes of each text, and windows that the library trains a dictionary on.
TOXIC_ROWS, ORDINARY_ROWS, ROW_BYTES, TRAINED_WINDOWS = 2000, 4000, 50_000, 40_000
WINDOW_WORDS = 8
LEVEL = 6
BASE_BYTES, OWN_BYTES = 14_000, 2_000
#: Bytes by which the toxic dictionary must be shorter for a window to count.
CLEAR = 2


def windows(text: str | None) -> list[bytes]:
    """Runs of ``WINDOW_WORDS`` words of the whole lower-cased text; one empty window without words."""
    x = (text or "").lower().split()
    return [" ".join(x[i : i + WINDOW_WORDS]).encode() for i in range(0, len(x), WINDOW_WORDS)] or [b""]


def _units(text: str) -> set[str]:
    out = set()
    for w in set(text.lower().split()):
        w = w.strip(".,;:!?")
        if w:
            out.update(" " + w[:n] for n in range(3, min(len(w), 12) + 1))
            out.add(f" {w} ")
    return out


def typical(own: list[str], other: list[str], size: int, share: float = 0.01, ratio: float = 8.0, each: int = 8, least: int = 7) -> bytes:
    """Words and word beginnings that mark ``own`` texts, the ones that mark most texts last (nearest to the base)."""
    sets = [_units(x) for x in own]
    seen, against = Counter(u for s in sets for u in s), Counter()
    likely = {u for u, k in seen.items() if k >= max(least, share * len(own))}
    for x in other:
        against.update(_units(x) & likely)
    likely = {u for u in likely if (seen[u] + 0.5) / (len(own) + 1) > ratio * (against[u] + 0.5) / (len(other) + 1)}
    where: dict[str, set[int]] = defaultdict(set)
    for i, s in enumerate(sets):
        for u in s & likely:
            where[u].add(i)
    marked, out, have = Counter(), [], 0
    while where:
        gain = {u: sum(marked[i] < each for i in w) - 30 * against[u] for u, w in where.items()}
        u = max(gain, key=lambda u: (gain[u], len(u), u))
        if gain[u] < max(least, share * len(own)) or have + len(u) > size:
            break
        out.append(u)
        have += len(u.encode())
        texts = where.pop(u)
        marked.update(texts)
        for v in [v for v, w in where.items() if (v in u or u in v) and len(w & texts) > 0.9 * len(w | texts)]:
            del where[v]
    return "".join(reversed(out)).encode()


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: list[float]
    scale: list[tuple[float, float]]
    fixed: float | None = None

    def __post_init__(self) -> None:
        self._made = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def _compressors(self) -> tuple:
        import zstandard as zstd

        if self._made is None:
            make = lambda d: zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            self._made = make(self.ordinary), make(self.toxic)
        return self._made

    def features(self, text: str | None) -> list[float]:
        plain, toxic = self._compressors()
        v = sorted((len(plain.compress(x)) - len(toxic.compress(x)) for x in windows(text)), reverse=True)
        n = len(v)
        clear = sum(x >= CLEAR for x in v)
        return [v[0], sum(v[:3]) / min(3, n), max(-3.0, min(3.0, sum(v) / n)), clear / n, np.log1p(clear), sum(x >= 4 for x in v) / n, np.log(n), np.log1p(sum(x >= 4 for x in v))]

    def score(self, text: str | None) -> float:
        if self.fixed is not None:
            return self.fixed
        x = [(f - m) / s for f, (m, s) in zip(self.features(text), self.scale, strict=True)]
        z = self.weights[-1] + sum(a * b for a, b in zip(self.weights, x, strict=False))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep) + 1e-9 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (weight * (p - y)) + keep * w)
    return w


def _trained(texts: list[str], size: int) -> bytes:
    """A dictionary of ``size`` bytes at most, trained by the library on at most ``TRAINED_WINDOWS`` windows of ``texts``, drawn by chance."""
    import zstandard as zstd

    pieces = [w for t in texts for w in windows(t)]
    random.Random(7).shuffle(pieces)
    pieces = pieces[:TRAINED_WINDOWS]
    try:
        return zstd.train_dictionary(size + 2048, pieces).as_bytes()[-size:]
    except zstd.ZstdError:  # too little text to train on
        return b" ".join(pieces)[-size:]


def fit(rows: list[tuple[str, int]], separate: bool = False) -> Model:
    """Dictionaries from one half of the distinct labelled texts, the curve from the other.

    ``separate`` trains one dictionary on toxic and one on ordinary windows instead
    of a shared base with typical words; the README compares the two.
    """
    rows = list(dict.fromkeys(rows))
    toxic, plain = [t for t, y in rows if y], [t for t, y in rows if not y]
    if len(toxic) < 8 or len(plain) < 8:
        return Model(b"", b"", [], [], len(toxic) / len(rows) if rows else 0.0)
    learn_t, learn_p = toxic[::2] + toxic[1::4], plain[::2]
    held = [(t, 1) for t in toxic[3::4]] + [(t, 0) for t in plain[1::2]]
    base = _trained(learn_p, BASE_BYTES)
    if separate:
        model = Model(_trained(learn_t, BASE_BYTES), base, [], [])
    else:
        model = Model(base + typical(learn_t, learn_p, OWN_BYTES), base + typical(learn_p, learn_t, OWN_BYTES, share=0.03), [], [])
    x, y = np.array([model.features(t) for t, _ in held], float), np.array([c for _, c in held], float)
    model.scale = [(float(m), float(max(s, 1e-6))) for m, s in zip(x.mean(axis=0), x.std(axis=0), strict=True)]
    weight = np.where(y == 1, max(1.0, 0.5 * (y == 0).sum() / max(1, y.sum())), 1.0)
    model.weights = _logistic((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6), y, weight).tolist()
    return model


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, row_bytes: int = ROW_BYTES) -> list[tuple[str, int]]:
    """A bounded sample of distinct labelled texts: at most these numbers of rows of each class, by hash, of at most ``row_bytes`` each.

    Only fitting is bounded so; scoring reads every text whole. Null ids and labels
    other than 0 and 1 don't count, of several labels of a document the largest
    does, null and empty texts teach nothing, and empty tables give no rows.
    """
    known = labels.where(f"`{label}` in (0, 1) and `{doc_id}` is not null").groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text").between(1, row_bytes))
    order, out = [F.xxhash64("doc_id"), F.col("doc_id")], []
    for y, most in ((1, toxic_rows), (0, ordinary_rows)):
        some = known.where(F.col("y") == y).orderBy(*order).limit(most)
        # An id may come with many texts: the joined rows are bounded, too.
        met = rows.join(F.broadcast(some), "doc_id").select("doc_id", "text").distinct().orderBy(*order, F.xxhash64("text")).limit(most)
        out += [(r["doc_id"], r["text"], y) for r in met.collect()]
    return [(t, y) for _, t, y in sorted(out)]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) for each row of ``docs``, from its whole text alone, without a shuffle.

    Null and empty texts are one empty window; all windows of a very long text
    count, in one task. Repeated rows are scored each;
    extra columns are left out; an empty table gives an empty one. A model of
    fewer than 8 texts in a class scores all rows with the toxic share.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            known: dict[str | None, float] = {}
            out = []
            for t in b.column("text"):
                t = t.as_py()
                if t not in known:
                    known[t] = own.score(t)
                out.append(known[t])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
