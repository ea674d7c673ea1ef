"""Blocks of titles: no pair is lost, whatever the block and the length."""

import random

from refcatalog.operators import enrich, near_titles, similar
from refcatalog.operators.similar import _lcs
from refcatalog.plans.tables import written


def _varied(n, seed, sizes):
    draw = random.Random(seed)
    out = set()
    while len(out) < n:
        own = [draw.choice("abcdeé 字") for _ in range(draw.choice(sizes))]
        out.add("".join(own))
        for _ in range(draw.randint(0, 3)):
            for _ in range(draw.randint(1, max(1, len(own) // 9))):
                own[draw.randrange(len(own))] = draw.choice(["", "", "a", "xy"])
            own = list("".join(own)) or ["a"]
            out.add("".join(own))
    return sorted(out)


def test_blocks_lose_no_pair_of_any_length(spark, monkeypatch):
    for name, value in {"MOST": 900, "ROWS": 4, "COLUMNS": 16, "PAIRS": 8, "CELLS": 256}.items():
        monkeypatch.setattr(near_titles, name, value)
    titles = _varied(160, 5, [1, 2, 5, 9, 30, 64, 70, 150])
    like = lambda x, y: 200 * _lcs(x, y) >= 90 * (len(x) + len(y))
    score = lambda x, y: 200.0 * _lcs(x, y) / (len(x) + len(y))
    frame = lambda t: spark.createDataFrame(t, "k long, t string")
    each = list(enumerate(titles))
    got = {(r["a"], r["b"]): r["score"] for r in near_titles.near(frame(each)).collect()}
    assert got == {(i, j): score(x, y) for i, x in each for j, y in each if i > j and like(x, y)} and len(got) > 40
    left, right = each[::2], each[1::3]
    met = {(i, j): score(x, y) for i, x in left for j, y in right if like(x, y)}
    rows = near_titles.near(frame(left), frame(right)).collect()
    assert len(rows) == len(met) and {(r["a"], r["b"]): r["score"] for r in rows} == met
    for best, order in (("first", lambda a, s: a), ("closest", lambda a, s: (-s, a))):
        want = {b: min(((a, s) for (a, x), s in met.items() if x == b), key=lambda p: order(*p)) for b in {b for _, b in met}}
        assert {r["b"]: (r["a"], r["score"]) for r in near_titles.near(frame(left), frame(right), best=best).collect()} == want
    assert near_titles.near(frame([]), frame(right)).count() == 0 and near_titles.near(frame([])).count() == 0


def test_a_large_group_of_similar_titles_is_never_paired_within(spark, monkeypatch):
    draw = random.Random(2)
    some = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    rows = [(i, "the same beginning of forty characters a" + some(4) if i % 2 else some(44), draw.choice([None, None, str(draw.randint(0, 3))]), None) for i in range(600)]
    made, whole = [], similar.similar_pairs

    def counted(*a, **k):
        made.append(written(whole(*a, **k)))
        return made[-1]

    monkeypatch.setattr(similar, "similar_pairs", counted)
    monkeypatch.setattr(similar, "RUN", 16, raising=False)
    frame = spark.createDataFrame(rows, "seq long, title string, arxiv_id string, doi string")
    got = {r["seq"]: r["leader"] for r in similar.dedup(frame, ["arxiv_id", "doi"]).collect()}
    assert got == _greedy(rows)
    assert sum(df.count() for df in made) < 2 * len(rows)
    # Old rows lead, however many of them there are and however alike.
    old = frame.where("seq < 300").select("seq")
    want = _greedy(rows[:300], True) | {}
    got = {r["seq"]: r["leader"] for r in similar.dedup(frame, ["arxiv_id", "doi"], seeds=old).collect()}
    assert {k: v for k, v in got.items() if k < 300} == want and all(v < 300 or v == k or k > v for k, v in got.items())


def _greedy(rows, all_lead=False):
    leaders, out = [], {}
    low = lambda t: t.strip().lower()
    like = lambda x, y: 200 * _lcs(low(x), low(y)) >= 90 * (len(low(x)) + len(low(y)))
    for seq, title, arxiv, _ in rows:
        at = None if all_lead else next((x for x in leaders if arxiv and x[2] == arxiv), None) or next((x for x in leaders if like(title, x[1])), None)
        if at is None:
            leaders.append((seq, title, arxiv))
        out[seq] = seq if at is None else at[0]
    return out


def test_old_titles_are_not_paired_with_one_another(spark, monkeypatch):
    made, whole = [], enrich.written

    def counted(df):
        made.append(whole(df))
        return made[-1]

    monkeypatch.setattr(enrich, "written", counted)
    draw = random.Random(4)
    old = [(i, "the same beginning of forty characters a" + "".join(draw.choice("abcdef") for _ in range(4))) for i in range(200)]
    new = [(1000, old[7][1].upper()), (1001, "none of them"), (1002, "the same beginning of forty characters aZZ"), (1003, None)]
    frame = lambda rows: spark.createDataFrame(rows, "seq long, title string")
    got = {r["seq"]: r["matched"] for r in enrich.match_titles(frame(new), frame(old)).collect()}
    close = lambda t: min(old, key=lambda o: (-_lcs(o[1], t) / (len(o[1]) + len(t)), o[0]))[0]
    assert got == {1000: min(i for i, t in old if t == old[7][1]), 1002: close(new[2][1].lower())}
    assert all(df.count() <= 300 for df in made)
