"""Similarity, resolution and the state over runs, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from refcatalog.functions import affiliations, evidence, keys, venues
from refcatalog.operators import decisions, enrich, moves, reports, similar, state
from refcatalog.operators.entities import apply_curation, merge_repos
from refcatalog.operators.similar import _lcs, dedup, greedy_leaders, similar_pairs
from refcatalog.plans import curated
from refcatalog.plans.catalogue import DIM
from refcatalog.plans.tables import written
from refcatalog.sources import landed


def _titles(n, seed):
    draw = random.Random(seed)
    words = ["graph", "deep", "model", "of", "the", "learning", "sparse", "ab", "a", "networks", "probing", "x"]
    out = []
    for _ in range(n):
        t = " ".join(draw.choice(words) for _ in range(draw.randint(0, 9)))
        out.append(t)
        for _ in range(draw.randint(0, 2)):
            own = list(t)
            for _ in range(draw.randint(0, 6)):
                if own:
                    own[draw.randrange(len(own))] = draw.choice(["", "a", "zz", " "])
            out.append("".join(own))
    return out


def _alike(a, b):
    a, b = a.strip().lower(), b.strip().lower()
    return bool(a and b) and 200 * _lcs(a, b) >= 90 * (len(a) + len(b))


def test_similar_pairs_equal_all_pairs(spark):
    titles = _titles(60, 1)
    rows = spark.createDataFrame(list(enumerate(titles)), "seq long, title string")
    first = {}
    for i, t in enumerate(titles):
        if t.strip():
            first.setdefault(t.strip().lower(), i)
    want = {(i, first[t.strip().lower()]) for i, t in enumerate(titles) if t.strip() and first[t.strip().lower()] != i}
    want |= {(max(i, j), min(i, j)) for x, i in first.items() for y, j in first.items() if i < j and _alike(x, y)}
    assert {(r["a"], r["b"]) for r in similar_pairs(rows).collect()} == want and len(want) > 30


def _greedy(rows):
    leaders, out = [], {}
    for seq, title, arxiv, doi in sorted(rows):
        at = next((x for x in leaders if arxiv and x[2] == arxiv), None) or next((x for x in leaders if doi and x[3] == doi), None) or next((x for x in leaders if _alike(title, x[1])), None)
        if at is None:
            leaders.append((seq, title, arxiv, doi))
        out[seq] = seq if at is None else at[0]
    return out


def test_dedup_equals_the_sequential_rule(spark):
    draw = random.Random(3)
    rows = [(i, t, draw.choice([None, None, "", str(draw.randint(0, 12))]), draw.choice([None, None, str(draw.randint(0, 12))])) for i, t in enumerate(_titles(50, 2))]
    frame = spark.createDataFrame(rows, "seq long, title string, arxiv_id string, doi string")
    got = {r["seq"]: r["leader"] for r in dedup(frame, ["arxiv_id", "doi"]).collect()}
    assert got == _greedy(rows) and len(set(got.values())) < len(rows)


def test_a_chain_of_rows_that_wait_for_one_another_settles(spark):
    # Each row shares an id with the one before it, by turns of two kinds.
    rows = [(i, f"{i:05d} {'xyzw'[i % 4] * 9}{i * i}", str((i + 1) // 2), str(i // 2) + "d") for i in range(14)]
    frame = spark.createDataFrame(rows, "seq long, title string, arxiv_id string, doi string")
    assert {r["seq"]: r["leader"] for r in dedup(frame, ["arxiv_id", "doi"]).collect()} == _greedy(rows)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """2,000 rows that each wait for the one before (by doubling), or for the two before (in order in one task)."""
    n = 2000
    rows = spark.range(n).withColumnRenamed("id", "seq")
    none = spark.createDataFrame([], "rank int, v string, w string")
    calls = []
    real = similar._along_runs
    monkeypatch.setattr(similar, "_along_runs", lambda *a: calls.append(1) or real(*a))
    chain = written(spark.createDataFrame([(i, 0, f"{k}") for i in range(n) for k in (i, i + 1)], "seq long, rank int, v string"))
    got = {r["seq"]: r["leader"] for r in greedy_leaders(rows, chain, none, at_once=0).collect()}
    assert got == {i: i - i % 2 for i in range(n)} and len(calls) <= 3
    wide = written(spark.createDataFrame([(i, 0, f"{k}") for i in range(n) for k in (i, i + 1, i + 2)], "seq long, rank int, v string"))
    calls.clear()
    got = {r["seq"]: r["leader"] for r in greedy_leaders(rows, wide, none).collect()}
    assert got == {i: i - i % 3 for i in range(n)} and len(calls) <= 3


def _merged(old, new):
    """The rule paper by paper: (leader of each new one)."""
    by_id, by_doi, titles, out = {}, {}, [], {}
    for seq, title, arxiv, doi in old:
        by_id |= {arxiv: seq} if arxiv else {}
        by_doi |= {doi: seq} if doi else {}
        titles.append((seq, title))
    for seq, title, arxiv, doi in new:
        at = by_id.get(arxiv) if arxiv else None
        at = by_doi.get(doi) if at is None and doi else at
        at = next((s for s, t in titles if _alike(title, t)), None) if at is None else at
        if at is None:
            at = seq
            by_id |= {arxiv: seq} if arxiv else {}
            by_doi |= {doi: seq} if doi else {}
            titles.append((seq, title))
        out[seq] = at
    return out


def test_merging_equals_the_sequential_rule(spark):
    names = "seq long, title string, arxiv_id string, doi string"
    for seed in range(3):
        draw = random.Random(seed)
        pick = lambda: draw.choice([None, None, "", str(draw.randint(0, 14))])  # noqa: E731, B023
        rows = [(i, t, pick(), pick()) for i, t in enumerate(_titles(40, 10 + seed))]
        cut = len(rows) // 2
        frame = spark.createDataFrame(rows, names)
        got = {r["seq"]: r["leader"] for r in dedup(frame, ["arxiv_id", "doi"], seeds=frame.where(f"seq < {cut}").select("seq")).collect()}
        assert got == {i: i for i in range(cut)} | _merged(rows[:cut], rows[cut:])


def _paper(seq, title, arxiv=None, doi=None):
    return (seq, title, "", None, None, 2024, *(arxiv if c == "arxiv_id" else doi if c == "doi" else None for c in state.FILLED))


def test_merge_takes_the_first_similar_title_and_ids_before_titles(spark):
    names = "seq long, title string, authors string, venue string, venue_source string, year int, " + ", ".join(f"{c} string" for c in state.FILLED)
    frame = lambda rows: spark.createDataFrame(rows, names).withColumn("manual_override", F.lit(False))
    long = "a study of sparse circuits in models parts one"
    old = frame([_paper(1, long), _paper(2, long + "x")])
    # The first similar title counts, not the most similar one.
    merged, stats = state.merge_papers(old, frame([_paper(10, long + "x", doi="d")]), DIM)
    assert {r["seq"]: r["doi"] for r in merged.collect()} == {1: "d", 2: None} and stats.first()["updated"] == 1
    # Of equal titles too, where nothing else is similar.
    twins = frame([_paper(1, long, "a"), _paper(2, long, "a")])
    merged, _ = state.merge_papers(twins, frame([_paper(10, long, doi="d")]), DIM)
    assert {r["seq"]: r["doi"] for r in merged.collect()} == {1: "d", 2: None}
    # Of equal ids the last old one.
    merged, _ = state.merge_papers(twins, frame([_paper(10, "quite another name", "a", "d")]), DIM)
    assert {r["seq"]: r["doi"] for r in merged.collect()} == {1: None, 2: "d"}
    # An id of an earlier new paper comes before an old one's title.
    merged, stats = state.merge_papers(old, frame([_paper(10, "quite another name", "2401.00001"), _paper(11, long, "2401.00001")]), DIM)
    assert {r["seq"]: r["arxiv_id"] for r in merged.collect()} == {1: None, 2: None, 10: "2401.00001"}
    assert tuple(stats.first()) == (2, 1, 0, 3)
    # Without old papers, all new ones join.
    assert state.merge_papers(old.where("false"), frame([_paper(10, long), _paper(11, long)]), DIM)[0].count() == 2


def test_discovery_orders_by_source_and_takes_the_first_confident_venue(spark):
    schema = "seq long, title string, arxiv_id string, doi string, year int, venue string, source string"
    late = spark.createDataFrame([(1, "One paper", "1", None, 2024, "ICML 2024", "late"), (2, "Old", "2", None, 1999, None, "late")], schema)
    early = spark.createDataFrame([(5, "One  paper!", "1", "d", None, "arXiv", "early"), (6, "the", None, None, 2024, None, "early")], schema)
    got = [tuple(r) for r in curated.discover([(1, late), (0, early)], 2020, ["The"], DIM).select("seq", "title", "doi", "year", "venue", "source").collect()]
    assert got == [(5, "One  paper!", "d", 2024, "ICML 2024", "early")]


def test_best_title_match_is_the_most_similar_one(spark):
    old = spark.createDataFrame([(1, "a study of sparse circuits in models", "ICLR 2024"), (2, "a study of sparse circuits in model", "submitted to ICLR"), (3, "another thing", "ICML")], "seq long, title string, venue string")
    new = spark.createDataFrame([(10, "A study of sparse circuits in models "), (11, "a study of sparse circuits in mode"), (12, "Another thing"), (13, "")], "seq long, title string")
    assert {r["seq"]: r["matched"] for r in enrich.match_titles(new, old).collect()} == {10: 1, 11: 2, 12: 3}
    assert {r["seq"]: r["venue"] for r in enrich.best_match(new, old).collect()} == {10: "ICLR 2024", 12: "ICML"}


def test_state_is_replaced_as_a_whole_and_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    rows = lambda *x: spark.createDataFrame(x, "seq long, title string, source string, bucket string")
    state.write_state(rows((1, "a", "s", "pending"), (2, "b", "s", "verified")), path)
    moved = state.read_state(spark, path).withColumn("bucket", F.lit("verified"))
    state.write_state(moved, path)
    assert sorted(tuple(r) for r in state.read_state(spark, path).select("seq", "bucket").collect()) == [(1, "verified"), (2, "verified")]
    with pytest.raises(ValueError, match="no column"):
        spark.range(1).withColumn("bucket", F.lit("x")).write.partitionBy("bucket").parquet(f"{path}2")
        state.read_state(spark, f"{path}2")
    (tmp_path / "s.json").write_text('{"pending": [{"title": "a", "source": "s"}, {"title": ""}], "verified": [], "discarded": [{"title": "c", "source": "t", "reason": "r"}]}')
    assert sorted((r["title"], r["bucket"]) for r in state.read_state(spark, f"file://{tmp_path}/s.json", "json").collect()) == [("a", "pending"), ("c", "discarded")]
    (tmp_path / "flat.json").write_text('[{"title": "a"}]')
    with pytest.raises(ValueError, match="buckets"):
        state.read_state(spark, f"file://{tmp_path}/flat.json", "json")
    repos = spark.createDataFrame([("o", "r", 3), (None, "x", 1)], "owner string, repo string, stars int")
    state.write_repo_state(repos, f"{path}3")
    assert [tuple(r) for r in state.read_repo_state(spark, f"{path}3").collect()] == [("o", "r", 3)]


def test_whole_repo_rows_survive_a_merge(spark):
    day = F.to_date(F.lit("2025-06-01"))
    old = spark.createDataFrame([("a", 1, "old", False, "2025-01-01", "2025-05-30"), ("b", 2, "kept", True, "2025-01-01", "2020-01-01"), ("c", 3, "gone", False, "2025-01-01", "2025-01-01")], "key string, stars int, note string, manual_override boolean, first_seen string, last_seen string").withColumns({c: F.to_date(c) for c in ("first_seen", "last_seen")})
    new = spark.createDataFrame([("a", 9, "new", "x"), ("b", 9, "new", "x"), ("d", 9, "new", "x")], "key string, stars int, note string, language string")
    got = {r["key"]: (r["stars"], r["note"], r["language"], str(r["first_seen"]), str(r["last_seen"])) for r in merge_repos(new, old, day).collect()}
    assert got == {"a": (9, "new", "x", "2025-01-01", "2025-06-01"), "b": (2, "kept", "x", "2025-01-01", "2025-06-01"), "d": (9, "new", "x", "2025-06-01", "2025-06-01")}


def test_curation_checks_reasons_and_sets_details(spark):
    rows = spark.createDataFrame([(1, "pending", "r", "x", False), (2, "pending", "r", "x", False)], "key long, bucket string, reason string, reason_detail string, manual_override boolean")
    act = lambda *x: spark.createDataFrame(x, "key long, seq int, action string, reason string, detail string")
    got = {r["key"]: (r["bucket"], r["reason"], r["reason_detail"]) for r in apply_curation(rows, act((1, 1, "discard", "spam", "seen"), (2, 1, "promote", None, None)), ["spam"]).collect()}
    assert got == {1: ("discarded", "spam", "seen"), 2: ("verified", None, None)}
    with pytest.raises(Exception, match="unknown reason"):
        apply_curation(rows, act((1, 1, "demote", "odd", None)), ["spam"]).collect()


def _column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t"))).collect()]


def test_windows_that_are_no_evidence(spark):
    signal = lambda t: evidence.window_signal(t, "toolkit|fabric", "toolkit|fabric|national\\s+fabric")
    used = [
        "We thank the makers of Toolkit (Writer et al., 2024), which is the python package we used to run everything.",
        "Thanks to the fabric, which (i.e., the shared one) is the platform we used.",
        "We thank the fabric team. Fabric (e.g., for hosting) is the system we used.",
        "We thank the team. All experiments are implemented using toolkit.",
        "We use toolkit to read activations.",
        "",
    ]
    assert _column(spark, used, signal) == [None] * len(used)
    thanks = ["We thank fabric. Our experiments rely on other hooks.", "We thank fabric for support. The package we used was something else.", "This was supported by the national fabric"]
    assert _column(spark, thanks, signal) == [evidence.THANKS] * len(thanks)
    negative = ["Removing the dependency on toolkit helps.", "We removed the toolkit dependency.", "hooks rather than toolkit", "instead of fabric", "without using toolkit", "no longer uses toolkit", "an alternative to fabric", "compared to alternatives like toolkit"]
    assert _column(spark, negative, signal) == [evidence.NEGATIVE] * len(negative)
    assert _column(spark, ["toolkit ✓ ✗ ∼", "toolkit ✓ ✗"], signal) == [evidence.TABLE, None]


def test_labels_come_from_the_labeller_or_the_rule(spark):
    rows = spark.createDataFrame([(1, "say uses"), (2, "fail"), (3, "odd"), (4, "skip"), (5, "none")], "seq long, p string").repartition(1)

    def answer(prompts):
        return [{"say uses": "It USES it.", "odd": "hm", "none": None}.get(p) for p in prompts]

    got = {r["seq"]: (r["category"], r["unclassified_reason"], r["classification_signal"]) for r in decisions.with_labels(rows, F.col("p"), answer, ["uses"], F.lit("referencing"), F.col("p") != "skip").collect()}
    assert got == {1: ("uses", None, "llm"), 2: ("referencing", None, "keyword_fallback"), 3: ("unclassified", "llm_unparseable", "llm"), 4: (None, None, None), 5: ("referencing", None, "keyword_fallback")}

    def broken(prompts):
        raise RuntimeError("no service")

    assert {r["category"] for r in decisions.with_labels(rows, F.col("p"), broken, ["uses"], F.lit("referencing")).collect()} == {"referencing"}


def test_venue_endings_dois_and_hyphens(spark):
    year = F.lit(2026)
    names = ["ICLR 2026 Conference Desk Rejected Submission", "ICLR 2026 Desk Rejected Submission", "Posterior Notes 2026", "Proceedings of the 41st International Conference on Machine Learning", "ICLR, 2025", "arXiv preprint arXiv:1"]
    assert _column(spark, names, lambda t: venues.normalize_venue(t, year, DIM)) == ["ICLR 2026", "ICLR 2026", "Posterior Notes 2026", "ICML 2026", "ICLR 2025", ""]
    tracks = ["findings-emnlp", "findings-acl", "findings-naacl", "blackboxnlp", "acl-", "naacl-", "emnlp-", "eacl-", "aacl-"]
    dois = [*(f"10.18653/V1/2024.{t}long.7" for t in tracks), "10.1145/3715275.1", "10.1145/3630106.2", "10.48550/arXiv.2401.00001", "10.1/x", None]
    want = ["Findings of EMNLP 2024", "Findings of ACL 2024", "Findings of NAACL 2024", "BlackboxNLP 2024", "ACL 2024", "NAACL 2024", "EMNLP 2024", "EACL 2024", "AACL 2024", "FAccT 2025", "FAccT 2024", "ArXiv", "", ""]
    assert _column(spark, dois, venues.venue_from_doi) == want
    assert _column(spark, ["Col-\nlege", "a -\nb", "x- \n y", "--\nz"], keys.join_hyphens) == ["College", "a -\nb", "xy", "--\nz"]


def test_single_company_names_are_affiliations(spark):
    rows = spark.createDataFrame([("Ann Bee\nOpenAI\nGoogle DeepMind\nSomewhere\nAbstract\n", "Ann Bee")], "t string, a string")
    assert rows.select(affiliations.affiliations(F.col("t"), F.col("a"))).first()[0] == ["OpenAI", "Google DeepMind"]


def test_venue_dimension_pages_and_snapshots(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"venues": {"ICML": {"type": "conference", "aliases": ["Int Conf ML", "Intl ML"]}, "BlackboxNLP": {"type": "workshop", "parent": "EMNLP"}}}')
    listed = landed.venue_list(landed.load_venues(spark, f"file://{tmp_path}/v.json"))
    assert [(v.canonical, v.kind, v.aliases) for v in listed] == [("BlackboxNLP", "workshop", ()), ("ICML", "conference", ("Int Conf ML", "Intl ML"))]
    pages = spark.createDataFrame([(1, '<a href="/o/r">x</a><a href="/about">y</a><a href="/n?p=2">Next</a>'), (2, "none")], "page_id long, html string")
    assert [(r["link"], r["hits"]) for r in landed.links_from_pages(pages, r'href="/([^"]+)"', named=True).collect()] == [("o/r", 1)]
    assert {r["page_id"]: r["next"] for r in landed.next_page(pages, r'href="([^"]+)">Next').collect()} == {1: "/n?p=2", 2: None}
    repos = spark.createDataFrame([("o/a", "old"), ("o/b", "old"), ("o/c", "old"), ("o/d", "old")], "key string, description string")
    snap = spark.createDataFrame([("o/a", 200, "O/A", False, ""), ("o/b", 404, None, None, None), ("o/c", 200, "o/new", False, "x")], "key string, status int, full_name string, archived boolean, description string")
    out = landed.apply_repo_snapshot(repos, snap)
    assert {r["key"]: (r["description"], r["removed"]) for r in out.collect()} == {"o/a": ("old", None), "o/b": ("old", "404"), "o/c": ("x", "rename_redirect"), "o/d": ("old", None)}
    assert sorted(tuple(r) for r in landed.removals(out).collect()) == [("404", 1), ("rename_redirect", 1)]
    figures = spark.createDataFrame([(1, 25, 0), (2, 3, 1), (3, 3, 0), (4, None, None)], "page_num int, n_drawings int, n_images int")
    assert [r["page_num"] for r in reports.pages_with_figures(figures).collect()] == [1, 2]


def test_rows_without_a_venue_are_placeholders(spark):
    rows = spark.createDataFrame([(1, None), (2, " "), (3, "arXiv preprint arXiv:2401.1"), (4, "Parts (cut"), (5, "3rd Meeting"), (6, "ICML 2024"), (7, "arXiv (Cornell University)")], "seq long, venue string")
    assert [r["p"] for r in rows.select("seq", venues.is_preprint(F.col("venue")).alias("p")).orderBy("seq").collect()] == [True, True, True, True, True, False, False]


def test_type_and_review_flag_follow_a_new_venue(spark):
    names = "seq long, authors string, venue string, venue_source string, year int, " + ", ".join(f"{c} string" for c in state.FILLED)
    empty = (None,) * len(state.FILLED)
    old = spark.createDataFrame([(i, None, v, None, 2024, *empty, "preprint", False, False) for i, v in enumerate(["arXiv preprint 1", "ICML 2024", "Handbook", None])], names + ", venue_type string, peer_reviewed boolean, manual_override boolean")
    new = spark.createDataFrame([(10 + i, None, v, None, 2024, *empty, i) for i, v in enumerate(["ICLR 2025", "arXiv preprint 1", "arXiv preprint 1", "Nature Methods"])], names + ", matched long")
    got = state.apply_updates(old, new, DIM).orderBy("seq").select("venue", "venue_type", "peer_reviewed").collect()
    assert [tuple(r) for r in got] == [("ICLR 2025", "conference", True), ("ICML 2024", "preprint", False), ("arXiv preprint 1", "preprint", False), ("Nature Methods", "journal", True)]


NAMES = ["International Conference on Machine Learning", "ICML", "ICLR 2026 Poster", "Handbook", "arXiv preprint arXiv:1", "arXiv", "3rd Meeting", "Nature Methods", None]


def test_field_updates_equal_the_rule_row_by_row(spark):
    """Random sequences of venues, sources and years, a third of all rows on one paper; summaries join in any grouping."""
    draw = random.Random(4)
    years = [0, 2019, 2021, 2024]
    known = spark.createDataFrame([(v, y) for v in NAMES[:-1] for y in years], "v string, y int")
    once_ = known.select("v", "y", venues.normalize_venue(F.col("v"), F.col("y"), DIM).alias("n"))
    twice = once_.where("n <> ''").select(F.col("n").alias("v")).distinct().join(known.select("y").distinct().hint("shuffle_replicate_nl")).select("v", "y", venues.normalize_venue(F.col("v"), F.col("y"), DIM).alias("n"))
    table = {(r["v"], r["y"]): r for r in once_.union(twice).select("*", venues.is_preprint(F.col("v")).alias("junk"), venues.is_confident(F.col("v"), DIM).alias("sure"), venues.venue_type(F.col("v"), DIM).alias("kind")).collect()}
    trait = {v: r for (v, _), r in table.items()}
    old = [(p, draw.choice(NAMES), draw.choice(years)) for p in range(40)]
    new = [(100 + i, draw.choice([0, draw.randrange(40)]) if i % 3 else 0, draw.choice(NAMES), draw.choice(["doi_prefix", "s2", "s2"]), draw.choice(years)) for i in range(240)]
    want = {p: [v, y, trait[v]["kind"] if v else "preprint", False] for p, v, y in old}
    for _, p, v, source, y in new:
        own = want[p]
        if v and v != own[0]:
            if trait[v]["junk"] and own[0] and trait[own[0]]["sure"]:
                tidy = table[own[0], own[1]]["n"]
                if tidy and tidy != own[0]:
                    own[0], own[2] = tidy, trait[tidy]["kind"]
            else:
                own[0], own[2] = v, trait[v]["kind"]
                own[3] = own[3] or own[2] in ("conference", "workshop", "journal")
        if source == "doi_prefix" and y:
            own[1] = y
        own[1] = own[1] or y
    names = "seq long, authors string, venue string, venue_source string, year int, " + ", ".join(f"{c} string" for c in state.FILLED)
    empty = (None,) * len(state.FILLED)
    held = spark.createDataFrame([(p, None, v, None, y, *empty, trait[v]["kind"] if v else "preprint", False, False) for p, v, y in old], names + ", venue_type string, peer_reviewed boolean, manual_override boolean")
    rows = spark.createDataFrame([(s, None, v, source, y, *empty, p) for s, p, v, source, y in new], names + ", matched long")
    got = state.apply_updates(held, rows, DIM).collect()
    assert {r["seq"]: [r["venue"], r["year"], r["venue_type"], r["peer_reviewed"]] for r in got} == want
    for _ in range(300):
        each = [moves.row_moves(*((x, None) if k == 0 else (None, x) if k == 1 else (None, None)), *((y, y) if k % 3 == 0 else (y, None))) for x, y, k in ((draw.choice("ab"), draw.choice([None, 1, 2]), draw.randrange(4)) for _ in range(3))]
        assert moves.then(moves.then(each[0], each[1]), each[2]) == moves.then(each[0], moves.then(each[1], each[2]))
