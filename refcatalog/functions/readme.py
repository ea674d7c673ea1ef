"""Sections, bibliography entries and linked papers of markdown texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import arxiv_year

# A header line, the opening of a bibliography entry, ids inside one, and words of headers that announce a citation.
HEADER = r"(?md)^#{1,6}[^\S\n]+(.+)$"
ENTRY = r"(?i)@(?:article|inproceedings|misc|techreport|preprint|phdthesis|mastersthesis|book|booklet|conference|proceedings)\s*\{\z"
ENTRY_IDS = [r"(?i)(?:eprint|arxiv)\s*=\s*[{\"](\d{4}\.\d{4,5})(?:v\d+)?[}\"]", r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})"]
SECTION_ID = r"https?://arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})"
CITATION_HEADERS = ["citation", "how to cite", "how to cite us", "paper", "reference", "references", "cite"]


def sections(text: Column) -> Column:
    """array<struct<header, body>>: lower-cased headers in order of their first appearance, '' before the first; of a repeated header the last body. Null for null."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    heads = F.concat(F.array(F.lit("")), F.transform(F.regexp_extract_all(unix, F.lit(HEADER), F.lit(1)), lambda h: F.lower(F.trim(h))))
    bodies = F.transform(F.split(unix, HEADER, -1), lambda b, i: F.regexp_replace(F.when(i > 0, F.regexp_replace(b, r"\A\n", "")).otherwise(b), r"\n\z", ""))
    named = F.zip_with(heads, bodies, lambda h, b: F.struct(h.alias("header"), b.alias("body")))
    return F.when(text.isNotNull(), F.transform(F.array_distinct(heads), lambda h: F.element_at(F.filter(named, lambda e: e["header"] == h), -1)))


def bibtex_ids(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bibtex_ids): ids inside entries with balanced braces, entry by entry, each once; only documents with such an entry.

    Every brace gets its depth by a running sum. The brace that follows an opening
    one on the same level closes it, so one window finds the end of every entry.
    """
    tokens = df.where(F.contains(text, F.lit("@"))).select(key, F.posexplode(F.split(text, r"(?<=[{}])")).alias("at", "token"))
    here = Window.partitionBy(key).orderBy("at")
    step = F.when(F.endswith("token", F.lit("{")), 1).when(F.endswith("token", F.lit("}")), -1).otherwise(0)
    placed = tokens.withColumn("step", step).withColumn("depth", F.sum("step").over(here)).withColumn("stop", F.sum(F.length("token")).over(here))
    level = F.when(F.col("step") > 0, F.col("depth") - 1).otherwise(F.col("depth"))
    closed = placed.where("step <> 0").withColumn("level", level).withColumn("close", F.lead("stop").over(Window.partitionBy(key, "level").orderBy("at")))
    entry = F.regexp_extract("token", ENTRY, 0)
    spans = closed.where((F.col("step") > 0) & (entry != "") & F.col("close").isNotNull()).select(key, (F.col("stop") - F.length(entry) + 1).cast("int").alias("first"), F.col("close").cast("int").alias("last"))
    listed = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    blocks = F.transform("spans", lambda s: F.substring(F.col(text), s["first"], s["last"] - s["first"] + 1))
    ids = F.flatten(F.transform(blocks, lambda b: F.concat(*(F.regexp_extract_all(b, F.lit(p), F.lit(1)) for p in ENTRY_IDS))))
    return df.select(key, text).join(listed.hint("shuffle_hash"), key).select(key, F.array_distinct(ids).alias("bibtex_ids"))


def section_id(text: Column) -> Column:
    """The first id linked in the first section that announces a citation and links one."""
    announced = F.filter(sections(text), lambda s: F.exists(F.array(*map(F.lit, CITATION_HEADERS)), lambda w: F.contains(s["header"], w)))
    return F.get(F.flatten(F.transform(announced, lambda s: F.regexp_extract_all(s["body"], F.lit(SECTION_ID), F.lit(1)))), F.lit(0))


def recent_id(ids: Column) -> Column:
    """struct(id, tier): the only id since 2020 (tier 3), or of several the one of the latest month, the first of equals (tier 4)."""
    recent = F.filter(ids, lambda x: arxiv_year(x) >= 20)
    month = F.array_max(F.transform(recent, lambda x: F.substring(x, 1, 4)))
    latest = F.get(F.filter(recent, lambda x: F.substring(x, 1, 4) == month), F.lit(0))
    return F.when(F.size(recent) > 0, F.struct(latest.alias("id"), F.when(F.size(recent) == 1, 3).otherwise(4).alias("tier")))


def linked_paper(df: DataFrame, key: str, text: str, ids: str) -> DataFrame:
    """Adds linked_paper_url and linked_paper_tier: by bibliography entry (1), citation section (2), recent ids (3, 4); null without ids."""
    found = df.join(bibtex_ids(df, key, text).hint("shuffle_hash"), key, "left")
    pick = lambda c, tier: F.when(c.isNotNull(), F.struct(c.alias("id"), F.lit(tier).alias("tier")))
    best = F.coalesce(pick(F.get("bibtex_ids", F.lit(0)), 1), pick(section_id(F.col(text)), 2), recent_id(F.col(ids)))
    known = F.when(F.size(ids) > 0, best)
    return found.withColumn("__best", known).withColumn("linked_paper_url", F.concat(F.lit("https://arxiv.org/abs/"), F.col("__best.id"))).withColumn("linked_paper_tier", F.col("__best.tier")).drop("__best", "bibtex_ids")
