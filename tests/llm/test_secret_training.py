"""The secret field is learned from all rows, and its least margins are set by all of them."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from refcatalog.llm import secrets

DRAW = np.random.default_rng(8)
KNOWN = ["".join(DRAW.choice(list("aeinorst"), DRAW.integers(2, 9))) for _ in range(2000)]


def _words(n):
    return " ".join(DRAW.choice(KNOWN, n))


def _key(n, known="0123456789abcdef"):
    return "".join(DRAW.choice(list(known), n))


def _added(field, texts):
    found = secrets.find(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), field)
    return [[t[a:b] for a, b, k in x if k == "crf"] for t, x in zip(texts, found, strict=True)]


def test_long_documents_teach(spark):
    """All matches lie in texts beyond 100,000 bytes."""
    texts = [" ".join(f'{_words(600)} token = "{_key(40)}"' for _ in range(40)) for _ in range(6)] + [_words(60) for _ in range(100)]
    assert all(len(x) > 100_000 for x in texts[:6])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    field = secrets.train(docs)
    uuids = ["-".join(_key(k) for k in (8, 4, 4, 4, 12)) for _ in range(20)]
    got = _added(field, [f"{_words(30)} {u} {_words(30)}" for u in uuids])
    assert sum(g == [u] for g, u in zip(got, uuids, strict=True)) >= 18


def test_pipeline_fits_nothing_on_the_driver(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(secrets, "fit", lambda *_: pytest.fail("texts were fitted on the driver"))
    texts = [_words(40) for _ in range(20)] + [f"{_words(30)} secret = {_key(40)}"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.secrets_stage(spark, docs, "").collect()}
    assert got[20]["text"].endswith("[SECRET]") and all(len(r["text"]) == r["n_chars"] for r in got.values())


def test_every_row_is_counted_and_learned_from(spark):
    """A match in the last of many rows teaches, and a pass updates the features of all tasks' rows."""
    texts = [_words(12) for _ in range(4000)] + [f"{_words(20)} secret: {_key(32)} {_words(20)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).select("text")
    plains, matches, chunks = secrets._counted(texts)
    assert (plains, matches, chunks[2]) == (4000, 2, 1) and chunks.sum() == sum(-(-len(x.replace(":", "").split()) // secrets.CHUNK) for x in texts)
    lesson = secrets.Lesson.of(matches, chunks)
    _, seen = secrets._pass(docs, secrets._blank(), secrets._blank(), lesson, 0)
    data, offsets = secrets.utf8(pa.array(texts, pa.large_string()))
    t = secrets.tokens(data, offsets)
    met = np.unique(secrets.features(t, np.arange(len(t.starts))))
    # A third of the slots is hidden in each update, so a feature may be missed, but hardly one in three.
    assert (seen[met] > 0).any(axis=1).mean() > 0.6
    again = secrets._pass(docs, secrets._blank(), secrets._blank(), lesson, 0)
    assert (again[1] == seen).all()


def test_tasks_are_joined_by_what_they_met(spark):
    """Weights of a feature that only one of several tasks met are those of that task."""
    plain, keyed = [_words(40) for _ in range(60)], [f"{_words(40)} secret: {_key(32)} {_words(40)}" for _ in range(60)]
    lesson = secrets.Lesson.of(60, secrets._counted(plain + keyed)[2])
    alone = secrets.Learner(secrets._blank(), secrets._blank(), lesson, 0)
    alone.learn(keyed)
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(x,) for x in plain + keyed], 2), "text string")
    weights, _ = secrets._pass(docs, secrets._blank(), secrets._blank(), lesson, 0)
    data, offsets = secrets.utf8(pa.array(plain, pa.large_string()))
    t = secrets.tokens(data, offsets)
    others = np.unique(secrets.features(t, np.arange(len(t.starts))))
    own = np.setdiff1d(np.flatnonzero(alone.own[:-4].any(axis=1)), others)
    assert len(own) and weights[own] == pytest.approx(alone.weights[own], abs=1e-3)


def test_margins_of_all_plain_rows(spark):
    """At most so many spans stay as are spared, whatever their number, and rows with a match don't count."""
    keyed = [f"{_words(20)} token = {_key(40)} {_words(20)}" for _ in range(60)]
    field = secrets.fit(keyed + [_words(40) for _ in range(60)])
    texts = [f"{_words(20)} {_key(20, 'ABCDEFGHIJ0123456789')} {_words(20)}" for _ in range(50)]
    docs = spark.createDataFrame([(x,) for x in texts], "text string").repartition(4)
    with_matches = docs.union(spark.createDataFrame([(f"{x} {y}",) for x, y in zip(texts, keyed, strict=False)], "text string"))
    assert sum(map(len, _added(field, texts))) >= 20
    for spared in (0, 1, 7):
        held = secrets.calibrated(field, docs, spared)
        assert sum(map(len, _added(held, texts))) <= spared
        assert secrets.calibrated(field, with_matches, spared, only_plain=True).least == held.least
    assert secrets.calibrated(field, docs, 10**6).least == (0.0, 0.0)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    u, step, start, share = rng.normal(size=(4, 5, 3)), rng.normal(size=(3, 3)) + secrets._BLOCKED, rng.normal(size=(4, 3)) + secrets._START, rng.random(4)
    p, pairs, first = secrets._forward_backward(u, step, start, share)
    want, both = np.zeros_like(u), np.zeros((3, 3))
    for n in range(4):
        paths = list(itertools.product(range(3), repeat=5))
        weight = np.array([np.exp(start[n, y[0]] + sum(u[n, i, g] for i, g in enumerate(y)) + sum(step[a, b] for a, b in itertools.pairwise(y))) for y in paths])
        for y, w in zip(paths, weight / weight.sum(), strict=True):
            for i, g in enumerate(y):
                want[n, i, g] += w
            for a, b in itertools.pairwise(y):
                both[a, b] += share[n] * w
    assert p == pytest.approx(want, abs=1e-9) and pairs == pytest.approx(both, abs=1e-9) and first == pytest.approx(want[:, 0], abs=1e-9)
