"""Landed tables (citation records, works, search results, pages, snapshots) to canonical rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.venues import Venue


def text_from_inverted_index(index: Column) -> Column:
    """The text of a map of word to positions, words in order of (position, word)."""
    each = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(each), lambda x: x["w"]), " ")


def institutions(authorships: Column) -> Column:
    names = F.flatten(F.transform(authorships, lambda a: F.transform(a["institutions"], lambda i: i["display_name"])))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))), ", ")


def citations_to_papers(raw: DataFrame) -> DataFrame:
    """One paper per record with a title."""
    pdf = F.col("openAccessPdf.url")
    doi = F.col("externalIds")["DOI"]
    return raw.where(K.present(F.col("title")).isNotNull()).select(
        "title",
        F.coalesce(K.normalize_arxiv_id(F.col("externalIds")["ArXiv"]), K.arxiv_id_from_doi(doi)).alias("arxiv_id"),
        doi.alias("doi"),
        F.col("paperId").alias("s2_paper_id"),
        F.array_join(F.transform("authors", lambda a: a["name"]), ", ").alias("authors"),
        F.coalesce(K.present(F.col("publicationVenue.name")), F.col("venue")).alias("venue"),
        F.year(F.try_to_date("publicationDate")).alias("year"),
        F.try_to_date("publicationDate").alias("publication_date"),
        F.when(K.looks_like_pdf(pdf), pdf).alias("pdf_url"),
        "abstract",
        "url",
        F.lit("s2_citation").alias("source"),
    )


def split_pub_summary(c: Column) -> Column:
    """``authors - venue, year - host`` as struct(authors, year, venue)."""
    parts = F.split(c, r"\s+-\s+")
    middle = F.when(F.size(parts) >= 2, parts[1])
    year = F.regexp_extract(middle, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    return F.struct(parts[0].alias("authors"), year.alias("year"), F.trim(F.regexp_replace(middle, r",?\s*\b(?:19|20)\d{2}\b", "")).alias("venue"))


def search_results_to_papers(raw: DataFrame) -> DataFrame:
    found = [F.coalesce(K.arxiv_id_from_url(F.col(c)), F.nullif(F.regexp_extract(c, r"\b(\d{4}\.\d{4,5})\b", 1), F.lit(""))) for c in ("link", "snippet", "publication_info.summary", "title")]
    parts = split_pub_summary(F.col("publication_info.summary"))
    doi = F.nullif(F.regexp_extract("link", r"(10\.\d{4,9}/[^\s?#]+)", 1), F.lit(""))
    return raw.where(K.present(F.col("title")).isNotNull()).select("title", F.coalesce(*found).alias("arxiv_id"), doi.alias("doi"), parts["authors"].alias("authors"), parts["year"].alias("year"), parts["venue"].alias("venue"), F.col("link").alias("url"), F.col("snippet").alias("abstract"), F.lit("scholar").alias("source"))


def links_from_pages(pages: DataFrame, pattern: str, page_id: str = "page_id", html: str = "html", named: bool = False) -> DataFrame:
    """(page_id, link, hits): what the pattern's first group finds in each page's html; with ``named`` only what reads ``owner/repo``."""
    found = pages.select(page_id, F.explode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))).alias("link"))
    found = found.where(F.col("link").rlike("^[^/\\s]+/[^/\\s]+$")) if named else found
    return found.groupBy(page_id, "link").agg(F.count(F.lit(1)).alias("hits"))


def next_page(pages: DataFrame, pattern: str, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, next): the last link of the pattern's first group, null where a page has none."""
    found = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    return pages.select(page_id, F.when(F.size(found) > 0, F.element_at(found, -1)).alias("next"))


#: What a repo takes over from its snapshot: its column, and the snapshot's.
TAKEN = {"description": "description", "stars": "stargazers_count", "forks": "forks_count", "archived": "archived", "is_fork": "fork", "language": "language", "license": "license", "topics": "topics", "last_commit": "pushed_at"}


def apply_repo_snapshot(repos: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Repos (key) with what their snapshot (key, status and any of ``TAKEN``) says, and ``removed``: why one goes (404, rename_redirect, archived), or null.

    A failed or limited request keeps the row as it is. Where the snapshot is good, its values count, though an
    empty description, licence or date leaves the old one; a licence is its spdx_id, else its name.
    """
    held = snapshot.select("key", F.struct(*(c for c in snapshot.columns if c != "key")).alias("__now"))
    out = repos.join(held, "key", "left")
    now = lambda c: F.col(f"__now.{c}")
    good = F.coalesce(now("status") == 200, F.lit(False))
    full = F.lower(K.present(now("full_name")))
    why = F.when(now("status") == 404, "404").when(good & (full != F.lower("key")), "rename_redirect").when(good & now("archived"), "archived")
    made = {}
    for c, theirs in TAKEN.items():
        if theirs not in snapshot.columns:
            continue
        value, old = now(theirs), F.col(c) if c in repos.columns else F.lit(None)
        if c == "license":
            value = F.coalesce(K.present(now("license.spdx_id")), K.present(now("license.name")), old)
        elif c == "last_commit":
            value = F.coalesce(F.to_date(F.substring(value, 1, 10)), old.cast("date"))
        elif c == "description":
            value = F.coalesce(K.present(value), old)
        elif c in ("archived", "is_fork"):
            value = F.coalesce(value, F.lit(False))
        elif c == "topics":
            value = F.coalesce(value, F.array().cast("array<string>"))
        made[c] = F.when(good, value).otherwise(old)
    return out.withColumn("removed", why).withColumns(made).drop("__now")


def removals(repos: DataFrame) -> DataFrame:
    """(reason, n) of the repos that ``apply_repo_snapshot`` removes."""
    return repos.where("removed is not null").groupBy(F.col("removed").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


#: The form of a venue dimension: a document of venues by name.
VENUES = "venues map<string, struct<type string, parent string, aliases array<string>>>"


def load_venues(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, type, parent, alias, ord): a venue dimension from a JSON document (``VENUES``), one row for each alias, and one without for a venue that has none."""
    named = spark.read.schema(VENUES).option("multiLine", True).json(path).select(F.explode("venues").alias("canonical", "v"))
    return named.select("canonical", F.col("v.type").alias("type"), F.col("v.parent").alias("parent"), F.posexplode_outer("v.aliases").alias("ord", "alias"))


def venue_list(dimension: DataFrame) -> list[Venue]:
    """The dimension as the rules take it: a table of a few hundred names, in order. Workshops count as conferences there."""
    rows = dimension.groupBy("canonical", "type").agg(F.array_sort(F.collect_list(F.when(F.col("alias").isNotNull(), F.struct("ord", "alias")))).alias("a")).orderBy("canonical").collect()
    return [Venue(r["canonical"], r["type"], tuple(x["alias"] for x in r["a"])) for r in rows]


def works_to_papers(raw: DataFrame) -> DataFrame:
    """One paper per work with a title; the venue is that of the first place that is neither a repository nor the preprint host, else of the primary one."""
    bare = K.present(F.regexp_replace("doi", "^https?://doi.org/", ""))
    name = lambda place: K.present(place["source"]["display_name"])
    real = lambda p: name(p).isNotNull() & (F.coalesce(p["source"]["type"], F.lit("")) != "repository") & ~F.contains(F.lower(name(p)), F.lit("arxiv"))
    place = F.get(F.filter("locations", real), F.lit(0))
    page, named = K.present(F.col("primary_location.landing_page_url")), F.filter(F.transform("authorships", lambda a: K.present(a["author"]["display_name"])), lambda x: x.isNotNull())
    date = F.try_to_date("publication_date")
    return raw.where(K.present(F.col("title")).isNotNull()).select(
        "title",
        F.coalesce(K.arxiv_id_from_url(page), K.arxiv_id_from_doi(bare)).alias("arxiv_id"),
        bare.alias("doi"),
        F.col("id").alias("openalex_id"),
        F.array_join(named, ", ").alias("authors"),
        institutions(F.col("authorships")).alias("affiliations"),
        F.coalesce(name(place), K.present(F.col("primary_location.source.display_name"))).alias("venue"),
        F.year(date).alias("year"),
        date.alias("publication_date"),
        F.coalesce(page, F.concat(F.lit("https://doi.org/"), bare)).alias("url"),
        F.coalesce(K.present(F.col("primary_location.pdf_url")), K.present(place["pdf_url"])).alias("pdf_url"),
        K.present(text_from_inverted_index(F.col("abstract_inverted_index"))).alias("abstract"),
        F.lit("openalex_fulltext").alias("source"),
    )


#: The entry of a feed, as the XML reader yields it (namespace prefixes left out).
FEED_ENTRY = "id string, author array<struct<name string, affiliation array<string>>>, category array<struct<_term string>>, journal_ref string, comment string"


def feed_to_papers(entries: DataFrame) -> DataFrame:
    """Entries (``FEED_ENTRY``) as arxiv_id, authors, sorted distinct affiliations, categories, journal_ref and comment; entries without id go."""
    some = lambda c: F.filter(c, lambda x: x.isNotNull())
    places = some(F.flatten(F.transform("author", lambda a: F.transform(F.coalesce(a["affiliation"], F.array().cast("array<string>")), K.present))))
    return entries.where(K.present(F.col("id")).isNotNull()).select(
        K.normalize_arxiv_id(F.trim("id")).alias("arxiv_id"),
        F.array_join(some(F.transform("author", lambda a: K.present(a["name"]))), ", ").alias("authors"),
        F.array_join(F.array_sort(F.array_distinct(places)), ", ").alias("affiliations"),
        some(F.transform("category", lambda c: K.present(c["_term"]))).alias("categories"),
        K.present(F.col("journal_ref")).alias("journal_ref"),
        K.present(F.col("comment")).alias("comment"),
    )


def feed_from_xml(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """Feed pages (one XML text a row) to papers; pages that don't parse yield none."""
    prefixed = F.regexp_replace(F.col(xml), r"(</?)(?:arxiv|atom):", "$1")
    parsed = F.from_xml(prefixed, f"entry array<struct<{FEED_ENTRY}>>")
    return feed_to_papers(pages.select(F.inline(parsed["entry"])))


def read_feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(papers, rejects) of feed files of any size: they are split between entries, and each is parsed alone; those that don't parse or have no id go to rejects (entry, reason)."""
    own = F.regexp_extract("value", r"(?s)<(?:atom:)?entry\b.*$", 0)
    entries = spark.read.option("lineSep", "</entry>").text(path).select(own.alias("entry")).where("entry <> ''")
    plain = F.regexp_replace(F.concat("entry", F.lit("</entry>")), r"(</?)(?:arxiv|atom):", "$1")
    read = entries.withColumn("e", F.from_xml(plain, f"{FEED_ENTRY}, __unread string", {"columnNameOfCorruptRecord": "__unread"}))
    why = F.when(F.col("e").isNull() | F.col("e.__unread").isNotNull(), "does not parse").when(K.present(F.col("e.id")).isNull(), "no id")
    told = read.withColumn("reason", why)
    return feed_to_papers(told.where("reason is null").select("e.*").drop("__unread")), told.where("reason is not null").select("entry", "reason")


#: The message of a registry record.
REGISTRY = "struct<DOI:string,`container-title`:array<string>,event:struct<name:string>,publisher:string,type:string,author:array<struct<affiliation:array<struct<name:string>>>>,link:array<struct<URL:string,`content-type`:string>>>"


def registry_to_signals(raw: DataFrame, body: str = "body") -> DataFrame:
    """Registry records (JSON text) as doi, venue (container title, else event), publisher, type, sorted distinct affiliations and the link of a PDF; records without a message go."""
    m = F.from_json(F.col(body), f"struct<message:{REGISTRY}>")["message"]
    rows = raw.select(m.alias("m")).where("m is not null")
    names = F.flatten(F.transform("m.author", lambda a: F.transform(F.coalesce(a["affiliation"], F.array().cast("array<struct<name:string>>")), lambda x: K.present(x["name"]))))
    pdf = F.get(F.filter("m.link", lambda x: F.contains(x["content-type"], F.lit("pdf"))), F.lit(0))["URL"]
    return rows.select(
        F.col("m.DOI").alias("doi"),
        F.coalesce(K.present(F.get("m.`container-title`", F.lit(0))), K.present(F.col("m.event.name"))).alias("venue"),
        F.col("m.publisher").alias("publisher"),
        F.col("m.type").alias("type"),
        F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))), ", ").alias("affiliations"),
        pdf.alias("pdf_url"),
    )
