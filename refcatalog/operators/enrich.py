"""Enrichment of papers: venue signals, the venue cascade, years, affiliations, urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import venues as V
from ..plans.tables import written
from .near_titles import near
from .similar import title_classes

# Signals in order of trust, and the sources whose year counts.
NAMED_SIGNALS = ["openalex", "s2", "crossref", "openreview"]
TRUSTED_YEARS = ["doi_prefix", "arxiv_comment_parsed"]


def resolved_venue(signals: Column, doi: Column, venue: Column, year: Column, identified: Column, dim: list[V.Venue], title_search: Column | None = None) -> Column:
    """struct(venue, source): the first candidate with a confident normal form.

    Order: doi prefix (trusted as it is), journal reference and comment of the feed,
    the named signals, the venue held, a title search for rows without ids; else
    ``ArXiv`` and the year. Null signals count as none.
    """
    raw = [(V.venue_from_doi(doi), "doi_prefix"), (V.venue_from_comment(signals["arxiv_journal_ref"]), "arxiv_comment_parsed"), (V.venue_from_comment(signals["arxiv_comment"]), "arxiv_comment_parsed")]
    raw += [(signals[name], name) for name in NAMED_SIGNALS] + [(venue, "existing")]
    if title_search is not None:
        raw.append((F.when(~identified, title_search), "title_search"))
    offered = F.filter(F.array(*(F.struct(K.present(v).alias("venue"), F.lit(s).alias("source")) for v, s in raw)), lambda c: c["venue"].isNotNull())
    normal = F.transform(offered, lambda c: F.struct(V.normalize_venue(c["venue"], year, dim).alias("venue"), c["source"].alias("source")))
    fit = F.filter(normal, lambda c: (c["venue"] != "") & ((c["source"] == "doi_prefix") | V.is_confident(c["venue"], dim)))
    held = F.coalesce(year, F.lit(0)) > 0
    fallback = F.struct(F.when(held, F.concat_ws(" ", F.lit("ArXiv"), year.cast("string"))).otherwise("ArXiv").alias("venue"), F.lit("fallback").alias("source"))
    return F.coalesce(F.get(fit, F.lit(0)), fallback)


def resolve_venue(papers: DataFrame, dim: list[V.Venue], title_search: Column | None = None) -> DataFrame:
    """Papers (signals, doi, venue, year, arxiv_id, openalex_id) with venue and venue_source set, and the year of a trusted venue. ``title_search``: the venue that a search for the title gave."""
    identified = F.coalesce(*(K.present(F.col(c)) for c in ("arxiv_id", "doi", "openalex_id"))).isNotNull()
    best = resolved_venue(F.col("signals"), F.col("doi"), F.col("venue"), F.col("year"), identified, dim, title_search)
    stated = F.nullif(F.regexp_extract("__v.venue", r"\b(20\d{2})\b", 1), F.lit("")).try_cast("int")
    out = papers.withColumn("__v", best)
    year = F.when(F.col("__v.source").isin(*TRUSTED_YEARS), F.coalesce(stated, F.col("year"))).otherwise(F.col("year"))
    return out.withColumn("year", year).withColumn("venue", F.col("__v.venue")).withColumn("venue_source", F.col("__v.source")).drop("__v")


def collect_signals(papers: DataFrame, registry: DataFrame, citations: DataFrame, reviews: DataFrame, feed: DataFrame) -> DataFrame:
    """Adds ``signals``, a map of source to raw venue, and refreshes authors and affiliations.

    registry (doi, venue, affiliations) counts for dois of other hosts than the
    preprint's; citations (arxiv_id, doi, venue) and reviews (title, venue) only for
    placeholder venues; feed (arxiv_id, authors, affiliations, journal_ref, comment)
    always. Of several rows of a key the smallest counts, so the result does not
    depend on the order of rows.
    """
    open_ = V.is_preprint(F.coalesce("venue", F.lit("")))
    doi = F.when(~F.contains(F.lower("doi"), F.lit("arxiv")), K.present(F.col("doi")))

    def met(left: DataFrame, table: DataFrame, key: Column, on: Column, fields: list[str], name: str) -> DataFrame:
        one = table.where(key.isNotNull()).groupBy(key.alias("__k")).agg(F.min(F.struct(*fields)).alias(name))
        return left.join(one, on == F.col("__k"), "left").drop("__k")

    low = lambda c: F.lower(F.trim(F.col(c)))
    out = met(papers, registry, K.present(F.col("doi")), doi, ["venue", "affiliations"], "__registry")
    out = met(out, citations, K.present(F.col("arxiv_id")), F.when(open_, K.present(F.col("arxiv_id"))), ["venue"], "__by_id")
    out = met(out, citations, K.present(F.col("doi")), F.when(open_ & K.present(F.col("arxiv_id")).isNull(), K.present(F.col("doi"))), ["venue"], "__by_doi")
    out = met(out, reviews, F.nullif(low("title"), F.lit("")), F.when(open_, low("title")), ["venue"], "__review")
    out = met(out, feed, K.present(F.col("arxiv_id")), K.present(F.col("arxiv_id")), ["authors", "affiliations", "journal_ref", "comment"], "__feed")
    found = {"crossref": "__registry.venue", "openreview": "__review.venue", "arxiv_journal_ref": "__feed.journal_ref", "arxiv_comment": "__feed.comment"}
    pairs = [F.struct(F.lit(n).alias("key"), K.present(F.col(c)).alias("value")) for n, c in found.items()]
    pairs.append(F.struct(F.lit("s2").alias("key"), K.present(F.coalesce("__by_id.venue", "__by_doi.venue")).alias("value")))
    signals = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
    affiliations = F.coalesce(*(K.present(F.col(c)) for c in ("affiliations", "__registry.affiliations", "__feed.affiliations")))
    out = out.withColumn("signals", signals).withColumn("affiliations", affiliations).withColumn("authors", F.coalesce(K.present(F.col("__feed.authors")), F.col("authors")))
    return out.drop("__registry", "__by_id", "__by_doi", "__review", "__feed")


def fill_affiliations(papers: DataFrame, works: DataFrame) -> DataFrame:
    """Missing affiliations from works (openalex_id, arxiv_id, doi, title, affiliations): by work id, else preprint id, else doi, else the first 100 characters of the title."""
    lacks = K.present(F.col("affiliations")).isNull()
    title = lambda: F.nullif(F.lower(F.substring(F.trim("title"), 1, 100)), F.lit(""))
    work_id = lambda: K.present(F.regexp_replace("openalex_id", "^https://openalex.org/", ""))
    keys = [work_id(), K.present(F.col("arxiv_id")), K.present(F.col("doi")), title()]
    out = papers
    for i, key in enumerate(keys):
        one = works.where(key.isNotNull()).groupBy(key.alias(f"__k{i}")).agg(F.min(K.present(F.col("affiliations"))).alias(f"__a{i}"), F.lit(True).alias(f"__f{i}"))
        out = out.join(one, F.when(lacks, key) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    first = F.when(F.lit(False), F.lit(""))
    for i in range(len(keys)):
        first = first.when(F.col(f"__f{i}"), F.col(f"__a{i}"))
    filled = F.coalesce(K.present(F.col("affiliations")), first)
    return out.withColumn("affiliations", filled).drop(*(f"__{x}{i}" for i in range(len(keys)) for x in "af"))


def match_titles(new: DataFrame, old: DataFrame, percent: int = 90) -> DataFrame:
    """(seq, matched): for new rows the old row of the most similar title, the first of equals. Equal titles are one class, and classes of new rows are compared with those of old ones."""
    named, classes = title_classes(new, "seq", "title")
    _, known = title_classes(old, "seq", "title")
    met = written(near(known, classes, percent, "closest").select(F.col("b").alias("k"), F.col("a").alias("matched")))
    best = classes.hint("shuffle_hash").join(met.hint("shuffle_hash"), "k").select("t", "matched")
    return named.hint("shuffle_hash").join(best.hint("shuffle_hash"), "t").select(F.col("key").alias("seq"), "matched")


def best_match(left: DataFrame, candidates: DataFrame, percent: int = 90) -> DataFrame:
    """(seq, venue): for rows without a venue from elsewhere the venue of the candidate of the most similar title; empty ones and submissions name none."""
    met = match_titles(left, candidates, percent)
    told = candidates.select(F.col("seq").alias("matched"), "venue")
    named = met.hint("shuffle_hash").join(told.hint("shuffle_hash"), "matched").where(K.present(F.col("venue")).isNotNull() & ~F.contains(F.lower("venue"), F.lit("submitted")))
    return named.select("seq", "venue")


def search_titles(papers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Papers without an id (key ``seq``) with ``title_search``: the venue of the candidate (title, venue, own ``seq``) of the most similar title."""
    bare = F.coalesce(*(K.present(F.col(c)) for c in ("arxiv_id", "doi", "openalex_id"))).isNull()
    found = best_match(papers.where(bare).select("seq", "title"), candidates).withColumnRenamed("venue", "title_search")
    return papers.join(found.hint("shuffle_hash"), "seq", "left")


def enrich(papers: DataFrame, registry: DataFrame, citations: DataFrame, reviews: DataFrame, feed: DataFrame, works: DataFrame, dim: list[V.Venue], candidates: DataFrame | None = None) -> DataFrame:
    """All of the above in order (``candidates`` of a title search, if there are any), then type, review flag, citation text and the best url."""
    told = collect_signals(papers, registry, citations, reviews, feed)
    searched = None if candidates is None else F.col("title_search")
    told = told if candidates is None else search_titles(told, candidates)
    out = fill_affiliations(resolve_venue(told, dim, searched), works).drop("title_search")
    v, c = F.col("venue"), F.col
    out = out.withColumn("venue_type", V.venue_type(v, dim)).withColumn("peer_reviewed", V.peer_reviewed(v, dim)).withColumn("url", K.best_url(c("url"), c("arxiv_id"), c("doi")))
    entry = K.bibtex(c("title"), c("authors"), c("year"), v, c("url"), c("arxiv_id"), c("doi"))
    return out.withColumn("bibtex", F.coalesce(K.present(c("bibtex")), entry))
