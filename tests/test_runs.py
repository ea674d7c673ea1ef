"""A full run in stages: its order, and what a second run after a fault has to work on."""

import pytest
from pyspark.sql import functions as F

from refcatalog.functions import keys
from refcatalog.operators import state as S
from refcatalog.plans import curated, runs
from refcatalog.plans.catalogue import DIM


def _repos(spark, rows):
    frame = spark.createDataFrame(rows, "seq long, owner string, repo string, stars int, description string, linked_paper_url string, linked_paper_tier int")
    none = F.lit(None).cast("string")
    made = {"key": F.concat_ws("/", "owner", "repo"), "url": F.concat_ws("/", "owner", "repo"), "parent_full_name": none, "category": none, "repo_type": none, "archived": F.lit(False), "last_commit": F.lit("2025-01-02"), "manual_override": F.lit(False), "has_classification": F.lit(True), "first_seen": F.to_date(F.lit("2025-01-01")), "last_seen": F.to_date(F.lit("2025-05-30"))}
    return frame.withColumns(made).withColumn("content_hash", keys.repo_hash(F.col("description"), F.col("last_commit"), F.col("archived")))


def test_links_shared_with_old_repos_are_cleared_before_routing(spark, tmp_path):
    link = "https://arxiv.org/abs/2407.00001"
    old = _repos(spark, [(i, "o", f"r{i}", 9, "d", link, 1) for i in range(4)])
    new = _repos(spark, [(10, "n", "late", 0, None, link, 2), (11, "n", "lib", 5, "d", None, None), (12, "n", "more machinery", 1, "x", "https://arxiv.org/abs/2407.00002", 1)])
    settings = {**curated.RUN, "excluded_repos": ["N/lib"]}
    got = {r["key"]: (r["repo_type"], r["linked_paper_url"]) for r in runs.run_repos(runs.Stages(spark, f"file://{tmp_path}"), new, old, settings).collect()}
    # The fifth repo of a link loses it and, bare as it is, counts as a course; the excluded one isn't there.
    assert got == {**{f"o/r{i}": (None, link) for i in range(4)}, "n/late": ("course", None), "n/more machinery": ("course", None)}


def test_a_run_after_a_fault_works_only_on_what_is_left(spark, tmp_path, monkeypatch):
    names = "seq long, title string, arxiv_id string, doi string, source string, year int, venue string, abstract string"
    none = F.lit(None).cast("string")
    empty = "authors affiliations pdf_url s2_paper_id openalex_id url project_url image reason_detail description unclassified_reason venue_source reason category_confidence_band bucket category".split()

    def papers(rows):
        out = spark.createDataFrame(rows, names).withColumns({c: none for c in empty} | {"manual_override": F.lit(False), "peer_reviewed": F.lit(False), "linked_paper_tier": none.cast("int"), **{f"has_{x}": F.lit(False) for x in ("summary", "classification", "thumbnail", "affiliations")}})
        return out.withColumn("content_hash", keys.paper_hash(F.col("title"), F.col("abstract")))

    state = papers([(1, "a study of parts", "2407.00001", None, "s", 2024, "arXiv preprint 1", "An abstract of some length")]).withColumn("bucket", F.lit("pending"))
    landed = papers([(1, "a study of parts", "2407.00001", "d1", "s", 2024, "ICML 2024", "An abstract of some length"), (2, "the", None, None, "s", 2024, None, "x"), (3, "other things", "2407.00003", None, "s", 2023, None, "More ation, which is long enough")]).drop("bucket", "reason", "manual_override", "category", "has_classification")
    repos = _repos(spark, [(10, "n", "own", 7, "d", "https://arxiv.org/abs/2407.00003", 1)])
    texts = spark.createDataFrame([(3, "we go on using ation " * 60)], "seq long, text string")
    args = ([(0, landed)], state, texts, repos, repos.where("false"), DIM, curated.RUN)
    folder = f"file://{tmp_path}/run"
    whole, broken = S.merge_papers, []

    def fails(*a):
        broken.append(1)
        raise RuntimeError("merge broke")

    monkeypatch.setattr(S, "merge_papers", fails)
    with pytest.raises(RuntimeError, match="merge broke"):
        runs.run(runs.Stages(spark, folder), *args)
    monkeypatch.setattr(S, "merge_papers", whole)
    stages = runs.Stages(spark, folder)
    out = runs.run(stages, *args)
    assert stages.worked == ["merged", "papers", "upgrades"]
    got = {r["title"]: (r["venue"], r["doi"], r["project_url"], r["category"]) for r in out["papers"].collect()}
    assert got == {"a study of parts": ("ICML 2024", "d1", None, None), "other things": (None, None, "n/own", "uses_library")}
    assert [r["venue"] for r in out["upgrades"].collect()] == ["ICML 2024"] and tuple(out["stats"].first()) == (1, 1, 1, 2)
    again = runs.Stages(spark, folder)
    runs.run(again, *args)
    assert again.worked == []
    changed = runs.Stages(spark, folder)
    runs.run(changed, args[0], args[1], texts.withColumn("text", F.lit("nothing of it")), *args[3:])
    assert "processed" in changed.worked and "discovered" not in changed.worked and "typed_repos" not in changed.worked
