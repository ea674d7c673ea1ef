import pytest
from pyspark.sql import functions as F

from refcatalog.functions import affiliations, readme
from refcatalog.operators import decisions, state
from refcatalog.plans.catalogue import DIM
from refcatalog.sources import landed

PAPER = "seq long, title string, arxiv_id string, doi string, venue string, year int, authors string, venue_source string, manual_override boolean, affiliations string, abstract string, pdf_url string, s2_paper_id string, openalex_id string"


def _papers(spark, *rows):
    fields = [f.split()[0] for f in PAPER.split(", ")]
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], PAPER)


def test_merge_papers_matches_ids_then_titles_then_new_rows(spark):
    old = _papers(spark, {"seq": 0, "title": "An old paper", "arxiv_id": "1", "venue": "ICML 2024", "year": 2024}, {"seq": 1, "title": "Another title entirely", "venue": "arXiv"}, {"seq": 2, "title": "Kept as it is", "doi": "d", "manual_override": True, "authors": "A"})
    new = _papers(spark, {"seq": 10, "title": "x", "arxiv_id": "1", "venue": "arXiv 2025", "abstract": "text"}, {"seq": 11, "title": "another title entirelY", "venue": "ICLR 2025", "year": 2025}, {"seq": 12, "title": "y", "doi": "d", "authors": "Much longer"}, {"seq": 13, "title": "Wholly new one", "arxiv_id": "7"}, {"seq": 14, "title": "z", "arxiv_id": "7", "authors": "B"})
    merged, stats = state.merge_papers(old, new, DIM)
    got = {r["seq"]: (r["venue"], r["year"], r["authors"], r["abstract"], r["changed"], r["added"]) for r in merged.collect()}
    assert got == {0: ("ICML 2024", 2024, None, "text", True, False), 1: ("ICLR 2025", 2025, None, None, True, False), 2: (None, None, "A", None, False, False), 13: (None, None, "B", None, True, True)}
    assert stats.first().asDict() == {"existing": 3, "new": 1, "updated": 2, "total": 4}


def test_merge_papers_with_an_empty_state(spark):
    none = _papers(spark).where("false")
    merged, stats = state.merge_papers(none, _papers(spark, {"seq": 1, "title": "a"}, {"seq": 2}), DIM)
    assert sorted(r["seq"] for r in merged.collect()) == [1, 2]
    assert stats.first()["new"] == 2


def test_edits_check_their_values(spark):
    columns = {c: F.lit(None).cast("string") for c in state.EDITABLE + ["arxiv_id", "doi", "unclassified_reason", "category_confidence_band"]}
    flags = {c: F.lit(False) for c in ("has_summary", "has_classification", "has_thumbnail", "has_affiliations", "manual_override", "peer_reviewed")}
    rows = spark.range(1).select(F.col("id").alias("seq")).withColumns(columns | flags | {"year": F.lit(2000), "bucket": F.lit("pending")})
    edit = lambda f, v: spark.createDataFrame([(0, 1, f, v)], "seq long, ord int, field string, value string")
    got = state.apply_edits(rows, edit("description", "text")).first()
    assert got["description"] == "text" and got["has_summary"] and got["manual_override"]
    for f, v in (("year", "soon"), ("bucket", "attic"), ("seq", "3"), ("peer_reviewed", "maybe")):
        with pytest.raises(Exception, match="bad|not editable"):
            state.apply_edits(rows, edit(f, v)).collect()


def test_sections_and_entries_of_odd_readmes(spark):
    texts = ["", "no header", "a\r\n# One\r\nx\r\n\r\n## Two \nlast", "# Same\n1\n# Other\n2\n# same\n3\n", None, "#\ntext", "@misc{a, eprint={2301.00001}, t={x}} @book{b, eprint={2301.00002}", "}@misc{a, url={https://arxiv.org/abs/2301.00003}}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq long, t string")
    got = {r["seq"]: r["s"] and [(x["header"], x["body"]) for x in r["s"]] for r in rows.select("seq", readme.sections(F.col("t")).alias("s")).collect()}
    assert got[0] == [("", "")] and got[1] == [("", "no header")] and got[4] is None and got[5] == [("", "#\ntext")]
    assert got[2] == [("", "a"), ("one", "x\n"), ("two", "last")]
    assert got[3] == [("", ""), ("same", "3"), ("other", "2")]
    ids = {r["seq"]: r["bibtex_ids"] for r in readme.bibtex_ids(rows, "seq", "t").collect()}
    assert ids == {6: ["2301.00001"], 7: ["2301.00003"]}


def test_feed_and_registry_records(spark):
    xml = '<feed xmlns="a" xmlns:arxiv="b"><entry><id>http://arxiv.org/abs/2301.00001v2</id><author><name> A B </name><arxiv:affiliation>Lab Z</arxiv:affiliation><arxiv:affiliation>Lab A</arxiv:affiliation></author><author><name>C</name></author><category term="cs.CL"/><arxiv:comment>Accepted at ICML 2024</arxiv:comment></entry><entry><id/></entry></feed>'
    got = landed.feed_from_xml(spark.createDataFrame([(xml,), ("no xml",), (None,)], "xml string")).collect()
    assert [tuple(r) for r in got] == [("2301.00001", "A B, C", "Lab A, Lab Z", ["cs.CL"], None, "Accepted at ICML 2024")]
    body = '{"message": {"DOI": "10.1/x", "container-title": [], "event": {"name": "Meet"}, "publisher": "P", "type": "t", "author": [{"affiliation": [{"name": "Q"}, {"name": "B"}]}, {}], "link": [{"URL": "u", "content-type": "text/html"}, {"URL": "v", "content-type": "application/pdf"}]}}'
    got = landed.registry_to_signals(spark.createDataFrame([(body,), ("{}",), (None,)], "body string")).collect()
    assert [tuple(r) for r in got] == [("10.1/x", "Meet", "P", "t", "B, Q", "v")]


def test_affiliations_of_a_footnote_and_of_nothing(spark):
    text = "Title\nAnn Bee\n" + "word " * 120 + "1University of One 2Institute of Two-\nfold Things. Correspondence to: a@b.org"
    rows = spark.createDataFrame([(text, "Ann Bee"), ("", ""), (None, None), ("Ann Bee\nAbstract", "Ann Bee")], "t string, a string")
    got = [r[0] for r in rows.select(affiliations.affiliations(F.col("t"), F.col("a"))).collect()]
    assert got == [["University of One", "Institute of Twofold Things"], [], [], []]


def test_repo_routes_keep_the_last_old_row_and_pass_it_through(spark):
    schema = "seq long, owner string, repo string, description string, last_commit string, archived boolean, content_hash string, manual_override boolean, has_classification boolean, category string"
    row = lambda seq, name, h, kept=False, done=True, category="c": (seq, "o", name, "d", "2025", False, h, kept, done, category)
    old = spark.createDataFrame([row(1, "a", "h"), row(2, "a", "x"), row(3, "b", "h", True), row(4, "c", "h", False, False), row(5, "e", "h")], schema)
    new = spark.createDataFrame([row(10, n, "h", category=None, done=False) for n in "abcDe"], schema)
    met = decisions.route_repos(new, old)
    assert {r["repo"]: r["route"] for r in met.collect()} == {"a": "reprocess", "b": "protected", "c": "fill_gaps", "D": "new", "e": "skip"}
    got = {r["repo"]: (r["seq"], r["category"], r["content_hash"] == "h") for r in decisions.process_repos(met, F.lit("made")).collect()}
    assert got == {"a": (10, None, False), "b": (3, "c", True), "c": (10, "made", False), "D": (10, None, False), "e": (5, "c", True)}


def test_captions_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, 0, "FIG 2 steering\nsee Figure 3: no\nFigure 12.\nFig. x\nFigure 1: " + "a" * 200), (2, 0, ""), (3, 0, None)], "seq long, page_num int, text string")
    got = {(r["seq"], r["ord"]): (r["figure_num"], len(r["caption"])) for r in decisions.captions(pages, "seq").collect()}
    assert got[1, 0] == (2, 14) and got[1, 1][0] == 12 and {k[0] for k in got} == {1}


def test_affiliations_are_looked_for_once_in_each_way(spark):
    from refcatalog.functions import affiliations as A

    rows = spark.createDataFrame([("t", "a")], "t string, a string").withColumn("b", F.lit(None).cast(A.BLOCKS))
    plan = rows.select(A.affiliations(F.col("t"), F.col("a"), A.footer_block(F.col("b"))).alias("x"))._jdf.queryExecution().analyzed().toString()
    # Five ways; each names the words of noise once, and organisations beside the footer's own blocks.
    assert plan.count("Equal\\s+contributions") == 5 and plan.count("Universidade") == 6


def test_papers_of_one_id_are_updated_without_pairing_rows(spark, monkeypatch):
    from refcatalog.operators import state
    from refcatalog.plans import curated

    seen, whole = [], state.folded
    monkeypatch.setattr(state, "folded", lambda rows: seen.append(rows.count()) or whole(rows))
    curated.paper_updates(spark, "/root/testdata/sf0.1")
    papers = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 = 0").count()
    assert seen == [papers]
