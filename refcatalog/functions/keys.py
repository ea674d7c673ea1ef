"""Identifiers, urls, slugs and hashes as column expressions. Empty text counts as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier forms.
ARXIV_PREFIX = r"^https?://arxiv\.org/(abs|pdf)/"
ARXIV_IN_URL = r"arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})"
ARXIV_IN_DOI = r"10\.48550/[aA]r[Xx]iv\.(\d{4}\.\d{4,5})"
BAND_SCORES = {"certain": 1.0, "high": 0.85, "medium": 0.55, "low": 0.3, "none": 0.0}
BAND_FLOORS = [("certain", 0.95), ("high", 0.7), ("medium", 0.5)]


def present(c: Column) -> Column:
    """Null for null, empty and blank text."""
    return F.nullif(F.trim(c), F.lit(""))


def once(c: Column, f) -> Column:
    """``f(c)``, with ``c`` evaluated once however often ``f`` names it, in lambdas too."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def unless_blank(c: Column) -> Column:
    """The value as it is; null where it is empty or blank."""
    return F.when(present(c).isNotNull(), c)


def _group(c: Column, pattern: str, k: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def normalize_arxiv_id(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, ARXIV_PREFIX, ""), r"\.pdf$", "")
    return F.trim(F.regexp_replace(bare, r"v\d+$", ""))


def arxiv_id_from_url(c: Column) -> Column:
    return _group(c, ARXIV_IN_URL)


def arxiv_id_from_doi(c: Column) -> Column:
    return _group(c, ARXIV_IN_DOI)


def arxiv_ids_in(c: Column) -> Column:
    """All ids linked in a text, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(ARXIV_IN_URL), F.lit(1)))


def arxiv_year(c: Column) -> Column:
    return F.coalesce(F.substring(c, 1, 2).try_cast("int"), F.lit(0))


def looks_like_pdf(c: Column) -> Column:
    low = F.lower(c)
    direct = low.endswith(".pdf") | F.contains(low, F.lit("/pdf"))
    return F.coalesce((c != "") & (direct | ~c.rlike(r"^https?://(?:dx\.)?doi\.org/")), F.lit(False))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)[^\w\s-]", "")), r"(?U)\s+", "-")


def file_slug(c: Column, default: str = "q") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(default))


def paper_hash(title: Column, abstract: Column) -> Column:
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("::"), F.coalesce(abstract, F.lit("")))
    return F.substring(F.sha2(text, 256), 1, 16)


def repo_hash(description: Column, last_commit: Column, archived: Column) -> Column:
    text = F.concat_ws("::", F.coalesce(description, F.lit("")), F.coalesce(last_commit.cast("string"), F.lit("None")), F.initcap(archived.cast("string")))
    return F.substring(F.sha2(text, 256), 1, 16)


def record_key(arxiv_id: Column, doi: Column, title: Column) -> Column:
    return F.coalesce(F.concat(F.lit("arxiv:"), present(arxiv_id)), F.concat(F.lit("doi:"), present(doi)), F.concat(F.lit("title:"), F.lower(F.trim(title))))


def best_url(url: Column, arxiv_id: Column, doi: Column) -> Column:
    """A review page stays; else the abstract page, unless a publisher's page is known; else the doi's."""
    u, a, d = (F.coalesce(x, F.lit("")) for x in (url, arxiv_id, doi))
    publisher = F.contains(u, F.lit("aclanthology.org")) | F.contains(u, F.lit("dl.acm.org"))
    return (
        F.when(F.contains(u, F.lit("openreview.net")), u)
        .when((a != "") & ((u == "") | F.contains(u, F.lit("arxiv")) | ~publisher), F.concat(F.lit("https://arxiv.org/abs/"), a))
        .when((d != "") & (u == ""), F.concat(F.lit("https://doi.org/"), d))
        .otherwise(u)
    )


def bibtex(title: Column, authors: Column, year: Column, venue: Column, url: Column, arxiv_id: Column, doi: Column) -> Column:
    """An entry whose key is the first author's last name, the year and the first title word."""
    last = F.regexp_extract(F.split(authors, ",")[0], r"(\S+)\s*$", 1)
    key = F.lower(F.regexp_replace(F.concat(F.coalesce(last, F.lit("")), F.coalesce(year.cast("string"), F.lit("")), F.coalesce(F.split(title, r"\s+")[0], F.lit(""))), "[^A-Za-z0-9]", ""))
    line = lambda n, c: F.concat(F.lit(f"  {n} = {{"), present(c.cast("string")), F.lit("},"))
    lines = [line(n, c) for n, c in (("title", title), ("author", authors), ("year", year), ("journal", venue), ("url", url), ("eprint", arxiv_id), ("doi", doi))]
    return F.concat_ws("\n", F.concat(F.lit("@article{"), key, F.lit(",")), *lines, F.lit("}"))


def lead_sentences(text: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, n), " ")


def usable_abstract(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, r"^[\s,]+|[\s,]+$", "")) >= 20, F.lit(False))


def band_from_score(score: Column, override: Column) -> Column:
    out = F.when(F.coalesce(override, F.lit(False)), "certain")
    for name, floor in BAND_FLOORS:
        out = out.when(score >= floor, name)
    return out.when(score > 0, "low").otherwise("none")


def score_from_band(band: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for name, value in BAND_SCORES.items():
        out = out.when(band == name, F.lit(value))
    return out


def join_hyphens(c: Column) -> Column:
    """Words that a line end cuts, as in ``Col-`` and ``lege``, in one; hyphens beside anything but word characters stay."""
    return F.regexp_replace(c, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")


def distinct_ci(items: Column) -> Column:
    """Each item once, whatever its case; the first spelling stays."""
    first = lambda own, low: F.filter(own, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return once(items, lambda own: once(F.transform(own, lambda y: F.lower(y)), lambda low: first(own, low)))
