"""Versions, ingestion that resumes, labels that are kept, rejected rows and large venue dimensions."""

import json
import time

import pytest
from pyspark.sql import functions as F

from refcatalog.functions import venues
from refcatalog.operators import decisions, state, versions
from refcatalog.plans.catalogue import DIM
from refcatalog.streaming import ingest


def test_versions_stay_whole(spark, tmp_path):
    path, rows = f"file://{tmp_path}/t", lambda *x: spark.createDataFrame([(i,) for i in x], "n long")
    read = lambda v=None: sorted(r["n"] for r in versions.read_version(spark, path, v)[0].collect())
    assert versions.latest(spark, path) == 0
    with pytest.raises(ValueError, match="no version"):
        versions.read_version(spark, path)
    assert versions.write_version(rows(1, 2), path) == 1
    # A write from what it reads; then one that started from an older version.
    assert versions.write_version(versions.read_version(spark, path)[0].where("n > 1"), path, based_on=1) == 2
    with pytest.raises(versions.Outdated):
        versions.write_version(rows(9), path, based_on=1)
    # A failing write, and one that another overtakes.
    with pytest.raises(Exception, match="broken"):
        versions.write_version(rows(1).select(F.raise_error(F.lit("broken")).alias("n")), path)
    assert read() == [2] and read(1) == [1, 2]

    class Slow:
        sparkSession, n = spark, 0

        @property
        def write(self):
            versions.write_version(rows(5), path)
            return rows(7).write

    with pytest.raises(versions.Outdated, match="meanwhile"):
        versions.write_version(Slow(), path)
    assert read() == [5]
    # A version that was begun and not finished is passed over.
    (tmp_path / "t" / "versions" / f"{4:010d}").write_text("")
    assert read() == [5] and versions.write_version(rows(6), path, based_on=3) == 5 and read() == [6]
    assert versions.expire(spark, path, 1) == [1, 2, 3, 4] and read() == [6]


def _page(folder, name, *pages):
    (folder / name).write_text("\n".join(json.dumps({"listing": listing, "page": n, "next_url": more, "items": [{"name": x, "url": f"u/{x}"} for x in items]}) for listing, n, more, items in pages))


def test_ingestion_resumes_and_consolidates_once(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    sink, known, at = f"file://{tmp_path}/out", f"file://{tmp_path}/known", f"file://{source}"
    _page(source, "a.json", ("x", 0, "p1", ["a", "b"]))
    _page(source, "b.json", ("x", 1, "p2", ["c"]), ("y", 0, None, ["q", "q"]))
    _page(source, "c.json", ("x", 2, None, ["d"]), ("z", 1, None, ["lost"]))
    real, seen = ingest.consolidate, []

    def breaks(*a):
        seen.append(a[2])
        if len(seen) == 3:
            raise RuntimeError("stopped")
        real(*a)

    monkeypatch.setattr(ingest, "consolidate", breaks)
    with pytest.raises(Exception, match="stopped"):
        ingest.ingest_pages(spark, at, sink, known, files=1)
    got = lambda: sorted((r["listing"], r["page"], r["place"], r["name"]) for r in ingest.listings(spark, sink).collect())
    assert set(r[0] for r in got()) <= {"y"} and len(seen) == 3
    monkeypatch.setattr(ingest, "consolidate", real)
    _page(source, "d.json", ("x", 0, "p1", ["a", "b"]))  # landed twice
    ingest.ingest_pages(spark, at, sink, known, files=1)
    ingest.ingest_pages(spark, at, sink, known)
    assert got() == [("x", 0, 0, "a"), ("x", 0, 1, "b"), ("x", 1, 0, "c"), ("x", 2, 0, "d"), ("y", 0, 0, "q"), ("y", 0, 1, "q")]
    done = sorted((r["listing"], r["pages"], r["items"]) for r in spark.read.parquet(f"{sink}/manifest").collect())
    assert done == [("x", 3, 4), ("y", 1, 2)]


def test_one_failing_prompt_is_kept_to_itself_and_replies_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"prompt {i % 100}") for i in range(400)], "seq long, p string").repartition(3)
    replies, log = f"file://{tmp_path}/replies", tmp_path / "log"
    log.mkdir()

    def answer(prompts):
        import uuid

        if "prompt 7" in prompts:
            raise RuntimeError("no answer to 7")
        (log / uuid.uuid4().hex).write_text("\n".join(prompts))
        return ["it uses it" for _ in prompts]

    def run(f):
        return {r["seq"]: (r["category"], r["classification_signal"], r["label_error"]) for r in decisions.with_labels(rows, F.col("p"), f, ["uses"], F.lit("rule"), replies=replies).collect()}

    asked = lambda: sorted(x for f in log.iterdir() for x in f.read_text().split("\n"))
    first = run(answer)
    assert {i for i, x in first.items() if x[0] != "uses"} == {7, 107, 207, 307} and first[7] == ("rule", "keyword_fallback", "RuntimeError: no answer to 7")
    assert asked() == sorted(f"prompt {i}" for i in range(100) if i != 7)  # each once
    for f in log.iterdir():
        f.unlink()
    second = run(lambda prompts: (log / "again").write_text("\n".join(prompts)) and ["uses"] * len(prompts))
    assert asked() == ["prompt 7"] and {x[0] for x in second.values()} == {"uses"}


def test_bad_rows_are_listed_with_the_reason(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string as form

    papers = [{"title": f"t{i}", "source": "s", "year": 2020 + i} for i in range(8)]
    whole = {"pending": [*papers[:4], {"title": "odd", "source": "s", "year": "soon"}], "verified": [*papers[4:], {"title": " ", "source": "s"}], "discarded": ["no object"]}
    (tmp_path / "s.json").write_text(json.dumps(whole))
    rows, rejects = state.read_checked_state(spark, f"file://{tmp_path}/s.json", form("title string, source string, year int"))
    assert sorted((r["title"], r["year"], r["bucket"]) for r in rows.collect()) == [(p["title"], p["year"], "pending" if i < 4 else "verified") for i, p in enumerate(papers)]
    assert sorted((r["bucket"], r["reason"]) for r in rejects.collect()) == [("discarded", "not of the declared form"), ("pending", "not of the declared form"), ("verified", "no title")]
    (tmp_path / "flat.json").write_text('{"pending": []}')
    with pytest.raises(Exception, match="by buckets"):
        state.read_checked_state(spark, f"file://{tmp_path}/flat.json", form("title string"))[0].collect()
    for name, text in (("l.json", '[{"owner": "o", "repo": "r", "stars": 1}, {"owner": "o"}]'), ("l.jsonl", '{"owner": "o", "repo": "r", "stars": 1}\n{"owner": "o"}')):
        (tmp_path / name).write_text(text)
        repos, rejects = state.read_checked_repos(spark, f"file://{tmp_path}/{name}", form("owner string, repo string, stars int"))
        assert [tuple(r) for r in repos.collect()] == [("o", "r", 1)] and [r["reason"] for r in rejects.collect()] == ["no repo"]


def test_thousands_of_aliases_plan_in_seconds(spark):
    big = [*DIM, *(venues.Venue(f"VX{i}", "conference", (f"international meeting on subject {i} and more", f"intl meeting {i}")) for i in range(1000)), venues.Venue("LONG", "journal", ("meeting 7 of minds",))]
    names = ["International Conference on Machine Learning (ICML)", "Intl meeting 77 poster", "The INTERNATIONAL meeting on subject 12 and more, 2024", "intl meeting 7 of minds", "vx5 notes", "xvx5", "x", None]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(names)], "n int, v string")
    start = time.time()
    got = df.select("n", venues.normalize_venue(F.col("v"), F.lit(2023), big).alias("a"), venues.has_known_venue(F.col("v"), big).alias("b"), venues.venue_type(F.col("v"), big).alias("c")).orderBy("n").collect()
    assert time.time() - start < 20
    # Of "intl meeting 7" and the longer "meeting 7 of minds", which overlap, the longer counts.
    assert [r["a"] for r in got][1:] == ["VX77 2023", "VX12 2024", "intl LONG 2023", "vx5 notes 2023", "xvx5 2023", "x 2023", ""]
    assert [r["b"] for r in got] == [True, True, True, True, True, False, False, False] and got[4]["c"] == "conference"
    small = df.where("n in (0, 6)").select(venues.normalize_venue(F.col("v"), F.lit(2023), DIM).alias("a")).collect()
    assert [r["a"] for r in small] == [got[0]["a"], got[6]["a"]]
