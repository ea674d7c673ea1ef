"""A full run as stages, each kept under a fingerprint of what it was made from.

A run that failed, or one over inputs of which few have changed, reads finished
stages back and works only on the others.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import decisions as D
from ..operators import enrich as N
from ..operators import entities as M
from ..operators import reports as P
from ..operators import state as S
from ..operators.similar import dedup
from .tables import written


class Stages:
    """Tables in ``folder``/name/fingerprint; ``worked`` lists the stages that this run had to work on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.worked = spark, folder.rstrip("/"), []
        self.prints: dict[str, str] = {}
        self.tables: dict[str, DataFrame] = {}

    def source(self, name: str, df: DataFrame) -> None:
        """An input table; its fingerprint is its form, and the number and sum of its rows' hashes, whatever their order."""
        cell = lambda f: F.to_json(f.name) if f.dataType.typeName() in ("map", "variant") else F.col(f.name)
        told = df.select(F.xxhash64(*(cell(f) for f in df.schema.fields)).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
        self._put(name, df, [df.schema.json(), str(tuple(told))])

    def setting(self, name: str, value) -> None:
        """Settings; a function in them counts by its module and name, so it should have one."""
        said = json.dumps(value, sort_keys=True, default=lambda x: f"{x.__module__}.{x.__qualname__}" if callable(x) else repr(x))
        self.prints[name] = hashlib.sha256(said.encode()).hexdigest()

    def _put(self, name: str, df: DataFrame, said: list[str]) -> None:
        self.tables[name], self.prints[name] = df, hashlib.sha256("\n".join(said).encode()).hexdigest()

    def made(self, name: str, of: list[str], work: Callable[..., DataFrame]) -> DataFrame:
        """The table of stage ``name``: as an earlier run left it, or ``work`` of the tables among ``of`` (in order), written beside its place and then moved there."""
        own = hashlib.sha256("\n".join([name, *(self.prints[x] for x in of)]).encode()).hexdigest()
        path, fs = f"{self.folder}/{name}/{own}", self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = fs.Path(path)
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            staged = f"{path}_{uuid.uuid4().hex}_staged"
            work(*(self.tables[x] for x in of if x in self.tables)).write.parquet(staged)
            if not files.rename(fs.Path(staged), at):
                raise OSError(f"could not move {staged}")
            self.worked.append(name)
        self.prints[name], self.tables[name] = own, self.spark.read.parquet(path)
        return self.tables[name]


def discover(sources: list[tuple[int, DataFrame]], least_year: int, excluded: list[str], dim: list) -> DataFrame:
    """Unique papers of all sources in order of rank: excluded titles go, rows are resolved, gaps are filled within each cluster, the first confident venue counts, and old years go at last."""
    rows = written(M.exclude(M.union_sources(*sources), "title", excluded))
    leaders = dedup(rows.select("order", "title", "arxiv_id", "doi"), ["arxiv_id", "doi"], key="order").withColumnRenamed("seq", "order")
    rows = written(rows.hint("shuffle_hash").join(leaders.hint("shuffle_hash"), "order"))
    filled = [c for c in rows.columns if c not in ("seq", "order", "venue", "leader")]
    one, venues = M.coalesce_cluster(rows, "leader", filled, "order"), M.venue_survivor(rows, "leader", dim, "order")
    firsts = rows.where("order = leader").select("leader", "seq")
    out = one.hint("shuffle_hash").join(venues.hint("shuffle_hash"), "leader").join(firsts.hint("shuffle_hash"), "leader")
    return M.min_year(out.drop("leader", "order"), least_year)


def typed_repos(repos: DataFrame, old: DataFrame, settings: dict) -> DataFrame:
    """Discovered repos (``key``) without the excluded ones, after shared links were cleared, types set and course links cleared over them and the old repos of other keys."""
    kept = M.exclude(repos, "key", settings["excluded_repos"])
    tidy = M.unlink_shared(M.overlay(old.select(*(c for c in old.columns if c in kept.columns)), kept, "key"), settings.get("shared", 5))
    kind = M.repo_type(F.col("repo"), F.col("description"), F.col("stars"), F.col("linked_paper_url"), F.col("parent_full_name"), F.col("unlinked"), F.col("category"), F.coalesce("manual_override", F.lit(False)), F.col("repo_type"), settings["course_parents"], settings["course_words"])
    tidy = D.unlink_courses(tidy.withColumn("repo_type", kind))
    return tidy.join(kept.select("key").hint("shuffle_hash"), "key", "left_semi").drop("cleared", "unlinked")


def processed_papers(routes: DataFrame, texts: DataFrame, state: DataFrame, settings: dict) -> DataFrame:
    """Routed papers with the state's columns: those that need it are classified, the others bring what was landed, and what a curator set is carried over."""
    open_ = routes.where("needs_classification").hint("shuffle_hash").join(texts.hint("shuffle_hash"), "seq", "left")
    judged = D.classify(open_.drop("category", "unclassified_reason"), settings["keywords"], settings["tool"], settings["label"])
    judged = judged.withColumns({"category_confidence_band": F.col("band"), "has_classification": F.col("category") != "unclassified"})
    judged = judged.withColumn("__d", S.decided()).withColumns({"bucket": F.col("__d.bucket"), "reason": F.col("__d.reason")})
    judged = D.discard_zero_hits(judged, settings["keywords"])
    names = state.columns
    whole = lambda df: df.select("route", "matched", *((F.col(c) if c in df.columns else F.lit(None)).cast(state.schema[c].dataType).alias(c) for c in names))
    both = whole(judged).unionByName(whole(routes.where("not needs_classification")))
    held = state.select(F.col("seq").alias("matched"), F.struct(*names).alias("old"))
    carried = S.carry_curated(both.join(held.hint("shuffle_hash"), "matched", "left"))
    return carried.select(*names).withColumn("seq", F.col("seq") + settings.get("offset", 1 << 40))


def run_repos(stages: Stages, repos: DataFrame, old_repos: DataFrame, settings: dict) -> DataFrame:
    """The repos' half of ``run``: links and types over new and old ones, then routes, processing and the merge."""
    stages.source("landed_repos", repos)
    stages.source("old_repos", old_repos)
    stages.setting("repo_settings", {k: settings.get(k) for k in ("excluded_repos", "shared", "course_parents", "course_words", "as_of")})
    stages.made("typed_repos", ["landed_repos", "old_repos", "repo_settings"], lambda new, old: typed_repos(new, old, settings))
    stages.made("processed_repos", ["typed_repos", "old_repos"], lambda new, old: D.process_repos(D.route_repos(new, old)).drop("route"))
    return stages.made("repos", ["processed_repos", "old_repos", "repo_settings"], lambda new, old: M.merge_repos(new, old, F.to_date(F.lit(settings["as_of"]))))


def run(stages: Stages, sources: list[tuple[int, DataFrame]], state: DataFrame, texts: DataFrame, repos: DataFrame, old_repos: DataFrame, dim: list, settings: dict, signals: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """A full run: ``papers`` and ``repos`` of the new state, venue ``upgrades`` of old papers, and ``routes``, ``stats`` and ``buckets`` of the report.

    In order: papers are discovered and, with ``signals`` (the tables of ``enrich``), enriched; excluded
    repos go, and links and types are settled over the discovered repos and the old ones of other keys;
    what is left links papers; only then both are routed against the old state, processed and merged.

    sources: (rank, papers of the state's columns). texts: (seq, text). repos and old_repos: rows of ``merge_repos``
    with key, owner, repo, url and the columns of ``route_repos``. settings: least_year, excluded, excluded_repos,
    keywords, tool, label (a named function of the evidence), as_of (a date), course_parents, course_words, categories.
    """
    for r, df in sources:
        stages.source(f"source_{r}", df)
    both = run_repos(stages, repos, old_repos, settings)
    for name, df in {"state": state, "texts": texts, **{f"signal_{k}": v for k, v in (signals or {}).items()}}.items():
        stages.source(name, df)
    stages.setting("settings", {"dim": [repr(v) for v in dim], **settings})
    ranks = [r for r, _ in sources]
    hashed = lambda df: df.withColumn("content_hash", K.paper_hash(F.col("title"), F.col("abstract")))
    stages.made("discovered", [*(f"source_{r}" for r in ranks), "settings"], lambda *t: discover(list(zip(ranks, t, strict=True)), settings["least_year"], settings["excluded"], dim))
    found = "discovered"
    if signals:
        lacking = lambda df: df.withColumns({c: F.lit(None).cast("string") for c in ("bibtex", "openalex_id", "affiliations", "authors", "url") if c not in df.columns})
        found, given = "enriched", list(signals)
        stages.made("enriched", ["discovered", *(f"signal_{k}" for k in given), "settings"], lambda papers, *t: N.enrich(lacking(papers), dim=dim, **dict(zip(given, t, strict=True))).drop("signals"))
    tiered = lambda df: hashed(df).withColumn("linked_paper_tier", F.lit(None).cast("int"))
    linked_id = lambda df: df.withColumn("linked_arxiv_id", K.arxiv_id_from_url(F.col("linked_paper_url")))
    stages.made("linked", [found, "typed_repos"], lambda papers, kept: M.link_repos(linked_id(kept), tiered(papers)))
    routes = stages.made("routed", ["linked", "state"], M.route)
    stages.made("processed", ["routed", "texts", "state", "settings"], lambda routes, texts, state: processed_papers(routes, texts, state, settings))
    merged = stages.made("merged", ["state", "processed", "settings"], lambda state, fresh: S.merge_papers(state, fresh, dim)[0])
    papers = stages.made("papers", ["merged"], S.rebucket)
    upgrades = stages.made("upgrades", ["linked", "state", "settings"], lambda new, old: D.venue_upgrades(new, old, dim))
    stats = merged.agg(F.count_if(~F.col("added")).alias("existing"), F.count_if("added").alias("new"), F.count_if(F.col("changed") & ~F.col("added")).alias("updated"), F.count(F.lit(1)).alias("total"))
    return {"papers": papers, "repos": both, "upgrades": upgrades, "routes": P.counts_by(routes, "route"), "stats": stats, "buckets": P.bucket_report(papers, settings["categories"])}
