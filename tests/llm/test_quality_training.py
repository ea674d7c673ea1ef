"""The quality views learn from every labelled row, and are calibrated by every held-out one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from refcatalog.llm import quality


def _plain_fit(sets, y, bins, rounds):
    """All rows at once, without Spark."""
    x = np.zeros((len(sets), bins + 1))
    for i, s in enumerate(sets):
        x[i, s] = 1 / np.sqrt(max(1, len(s)))
    x[:, -1] = 1
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w, m, v = np.zeros(bins + 1), np.zeros(bins + 1), np.zeros(bins + 1)
    for k in range(1, rounds + 1):
        g = x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y)) + 1e-4 * w
        m, v = m + 0.1 * (g - m), v + 0.001 * (g * g - v)
        w = w - 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def test_every_labelled_row_teaches(spark):
    """More labelled rows than a driver's list of 8,000: the own word of each of them gets a weight, but for those held out."""
    rows = [(i, f"own{i} " + ("fine words" if i % 3 else "poor stuff"), int(i % 3 > 0)) for i in range(9600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    encoded, _ = quality._prepared(docs, "doc_id", "text", ())
    encoded = quality.cut(encoded)
    model = quality.train(encoded, docs.select("doc_id", "quality"), "doc_id", "quality", [], rounds=0)
    taught = [np.frombuffer(r["a"], "<u2") for r in encoded.where(F.expr("pmod(xxhash64(a, b), 4) <> 3")).select("a").collect()]
    assert 7000 < len(taught) < 7400 and all((model.text.weights[s] != 0).all() for s in taught)
    assert model.fixed is None and model.mix[0] + model.mix[1] > 0


def test_views_equal_a_plain_fit_however_rows_are_dealt_out(spark, monkeypatch):
    draw = np.random.default_rng(4)
    sets = [[np.unique(draw.integers(0, n, draw.integers(0, 30))).astype("<u2") for _ in range(700)] for n in (500, 60)]
    y = np.array([int(len(a) and a[0] % 3 > 0) for a in sets[0]])
    extra = [([np.array([1, 2, 499], "<u2")], [0]), ([np.array([5], "<u2"), np.array([], "<u2")], [1, 0])]
    docs = spark.createDataFrame([(bytes(a), bytes(b), int(c)) for a, b, c in zip(*sets, y, strict=True)], "a binary, b binary, y int")
    monkeypatch.setattr(quality, "BLOCK_BINS", 1000)
    got = [quality.fit_views(quality.labelled_blocks(docs.repartition(n)), np.bincount(y), extra, rounds=12) for n in (1, 5)]
    for i, bins in enumerate((quality.TEXT_BINS, quality.META_BINS)):
        want = _plain_fit(sets[i] + extra[i][0], np.append(y, extra[i][1]), bins, 12)
        assert np.append(got[0][i].weights, got[0][i].bias) == pytest.approx(want, abs=1e-5)
        assert (got[0][i].weights == got[1][i].weights).all() and got[0][i].bias == got[1][i].bias


def test_curve_of_all_rows(spark, monkeypatch):
    draw = np.random.default_rng(5)
    za, zb = draw.normal(size=3000) * 3, draw.normal(size=3000)
    y = (draw.random(3000) < 1 / (1 + np.exp(-(0.7 * za - 1.5 * zb + 0.4)))).astype(int)
    pack = lambda held: tuple(np.array([r[c] for r in held]) for c in ("za", "zb", "y"))
    frame = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(za, zb, y, strict=True)], "za double, zb double, y int")
    got = [quality._curve(quality._blocks(frame.repartition(n), lambda _: 1, 100, pack), lambda a, b: [a, b], 2) for n in (1, 4)]
    assert (got[0] == got[1]).all()
    x = np.stack([za, zb, np.ones(3000)], axis=1)
    p = 1 / (1 + np.exp(-x @ got[0]))
    # The slope of the whole loss, with its ridge, is nothing there.
    assert np.abs(x.T @ (p - y) + 1e-2 * got[0]).max() < 1e-2
