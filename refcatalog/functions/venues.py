"""Venue rules as column expressions: identifiers, placeholders, normal form, type."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import once

# The identifier prefixes of venues, in order; a year in the identifier stands for {year}.
DOI_VENUES = [
    (r"^10\.18653/v1/(\d{4})\.findings-emnlp", "Findings of EMNLP {year}"),
    (r"^10\.18653/v1/(\d{4})\.findings-acl", "Findings of ACL {year}"),
    (r"^10\.18653/v1/(\d{4})\.findings-naacl", "Findings of NAACL {year}"),
    (r"^10\.18653/v1/(\d{4})\.blackboxnlp", "BlackboxNLP {year}"),
    (r"^10\.18653/v1/(\d{4})\.acl-", "ACL {year}"),
    (r"^10\.18653/v1/(\d{4})\.naacl-", "NAACL {year}"),
    (r"^10\.18653/v1/(\d{4})\.emnlp-", "EMNLP {year}"),
    (r"^10\.18653/v1/(\d{4})\.eacl-", "EACL {year}"),
    (r"^10\.18653/v1/(\d{4})\.aacl-", "AACL {year}"),
    (r"^10\.1145/3715275", "FAccT 2025"),
    (r"^10\.1145/3630106", "FAccT 2024"),
    (r"^10\.48550/arxiv\.", "ArXiv"),
]
# The forms of a prefix, a volume, endings, a host and an article that a venue's name goes without.
PROCEEDINGS = r"(?i)^Proceedings?\s+of\s+(?:the\s+)?(?:\d+(?:st|nd|rd|th)\s+)?"
VOLUME = r"(?i)\s*\(Volume\s+\d+:[^)]*\)"
ENDINGS = ["Poster", "Spotlight", "Oral", "Conference Desk Rejected Submission", "Desk Rejected Submission"]
HOST = r"(?i)\s*\(Cornell\s+University\)\s*"
ARTICLE = r"(?i)^(?:the|a|an)\s+"
# Whole strings that name no venue.
PLACEHOLDERS = [
    r"arxiv(\.org)?(\s+\d{4})?", r"arxiv\s+e-?prints?(\s+\d{4})?", r"arxiv\s+preprint.*", r"corr(\s+\d{4})?", r"biorxiv(\s+\d{4})?", r"medrxiv(\s+\d{4})?",
    r"ssrn.*", r"available at ssrn.*", r"uva-dare.*", r"openreview\.net", r"https?://.*", r"url\s+https?://.*", r"\d{4}", r".*\b(of|on|at|in|for|the)\s+\d{4}",
    r"international conference on(\s+\d{4})?", r"conference on(\s+\d{4})?",
]
# Words by which routing tells types apart.
ROUTE_CONFERENCE = ["proceedings", "conference", "conf", "symposium", "neurips", "icml", "iclr", "aaai", "acl", "emnlp", "workshop", "coling", "naacl"]
ROUTE_JOURNAL = ["journal", "transactions", "letters", "review", "nature", "science", "ieee", "acm"]
# Fixed value: how a comment says where a paper went.
ACCEPTED = r"(?i)\b(?:Accepted (?:at|to|in)|Published (?:in|at)|Appeared (?:at|in)|Presented at|To appear (?:in|at)|Camera-ready for)\b\s+(.+?)\s+\b(20\d{2})\b"


@dataclass(frozen=True)
class Venue:
    canonical: str
    kind: str  # conference, workshop, journal or preprint
    aliases: tuple[str, ...] = ()


def _either(parts: list[str]) -> str:
    """One expression for all of ``parts``, longest first, of any number."""
    return "|".join(rf"\Q{p}\E" for p in sorted(set(parts), key=lambda p: (-len(p), p)))


def _any(low: Column, parts: list[str]) -> Column:
    return low.rlike(_either([p.lower() for p in parts])) if parts else F.lit(False)


def venue_from_doi(doi: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for form, name in DOI_VENUES:
        head, dated, tail = name.partition("{year}")
        found = F.concat(F.lit(head), F.regexp_extract(doi, f"(?i){form}", 1), F.lit(tail)) if dated else F.lit(name)
        out = out.when(doi.rlike(f"(?i){form}"), found)
    return out.otherwise("")


def is_preprint(venue: Column) -> Column:
    """No name at all (null or blank), placeholders, and names that are cut off (an open bracket) or begin with an ordinal."""
    v = F.trim(F.coalesce(venue, F.lit("")))
    cut_off = F.regexp_count(v, F.lit(r"\(")) != F.regexp_count(v, F.lit(r"\)"))
    return (v == "") | v.rlike(f"(?i)^(?:{'|'.join(PLACEHOLDERS)})$") | cut_off | v.rlike(r"(?i)^\d+(st|nd|rd|th)\b")


def has_known_venue(venue: Column, dim: list[Venue]) -> Column:
    """Whether a name of the dimension is in ``venue``: a journal's or an alias anywhere, another's as a word; one expression, however many there are."""
    anywhere = [v.canonical for v in dim if v.kind == "journal"] + [a for v in dim for a in v.aliases]
    worded = [v.canonical for v in dim if v.kind not in ("journal", "preprint")]
    parts = ([rf"\b(?:{_either(worded)})\b"] if worded else []) + ([_either(anywhere)] if anywhere else [])
    return F.coalesce(venue.rlike(f"(?iu){'|'.join(parts)}"), F.lit(False)) if parts else F.lit(False)


def is_confident(venue: Column, dim: list[Venue]) -> Column:
    return ~is_preprint(venue) & has_known_venue(venue, dim)


def _tidy(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ ,;-]+|[ ,;-]+$", "")


def normalize_venue(venue: Column, year: Column, dim: list[Venue] = ()) -> Column:
    """A short name with its year; empty for placeholders."""
    v = _tidy(F.regexp_replace(F.regexp_replace(F.trim(venue), "…", ""), r"\.{3,}", ""))
    v = F.trim(F.regexp_replace(F.trim(F.regexp_replace(v, PROCEEDINGS, "")), VOLUME, ""))
    v = F.trim(F.regexp_replace(F.regexp_replace(v, rf"(?i)\s+(?:{'|'.join(ENDINGS)})\b", ""), r"\s+", " "))
    v = F.trim(F.regexp_replace(F.trim(F.regexp_replace(v, HOST, " ")), ARTICLE, ""))
    longest = sorted(((a, d.canonical) for d in dim for a in d.aliases), key=lambda x: -len(x[0]))
    known = {}
    for n, (alias, name) in enumerate(longest):
        known.setdefault(alias.lower(), {"nth": n, "name": name})
    names = F.from_json(F.lit(json.dumps(known)), "map<string, struct<nth: int, name: string>>")
    # At each place the longest alias that begins there, without moving on: so the longest of all is among them.
    begins = rf"(?iu)(?=({_either([a for a, _ in longest])}))"

    def shorter(v: Column) -> Column:
        """With the longest alias that occurs put short."""
        if not longest:
            return v
        there = F.transform(F.regexp_extract_all(v, F.lit(begins), F.lit(1)), lambda a: F.struct(F.element_at(names, F.lower(a)).alias("own"), a.alias("alias")))
        best = F.array_min(F.filter(there, lambda x: x["own"].isNotNull()))
        put = lambda b: F.when(b.isNull(), v).otherwise(F.trim(F.regexp_replace(v, F.concat(F.lit(r"(?iu)\Q"), b["alias"], F.lit(r"\E")), b["own"]["name"])))
        return once(best, put)

    def dated(v: Column) -> Column:
        lacks = (F.coalesce(year, F.lit(0)) > 0) & ~v.rlike(r"\b20\d{2}\b")
        return F.when(is_preprint(v), "").when(lacks, F.trim(F.concat_ws(" ", v, year.cast("string")))).otherwise(v)

    v = F.regexp_replace(F.trim(F.regexp_replace(once(v, shorter), r"\b(20\d{2})\s+\1\b", "$1")), r"\s*,\s+(?=\d{4}\b)", " ")
    return F.when(F.coalesce(F.trim(venue), F.lit("")) == "", "").otherwise(once(_tidy(v), dated))


def venue_type(venue: Column, dim: list[Venue]) -> Column:
    low = F.lower(venue)
    names = lambda kind: [d.canonical for d in dim if d.kind == kind]
    return F.when(_any(low, names("preprint")), "preprint").when(F.contains(low, F.lit("workshop")), "workshop").when(_any(low, names("journal")), "journal").when(_any(low, names("conference") + names("workshop")), "conference").otherwise("preprint")


def peer_reviewed(venue: Column, dim: list[Venue]) -> Column:
    low = F.lower(venue)
    known = [d.canonical for d in dim if d.kind != "preprint"]
    return F.coalesce(~_any(low, [d.canonical for d in dim if d.kind == "preprint"]) & (_any(low, known) | F.contains(low, F.lit("workshop"))), F.lit(False))


def route_venue_type(venue: Column) -> Column:
    low = F.lower(F.coalesce(venue, F.lit("")))
    return F.when(F.contains(low, F.lit("arxiv")), "preprint").when(_any(low, ROUTE_CONFERENCE), "conference").when(_any(low, ROUTE_JOURNAL), "journal").otherwise("unknown")


def venue_upgraded(old: Column, new: Column) -> Column:
    return (route_venue_type(old) == "preprint") & route_venue_type(new).isin("conference", "journal")


def venue_from_comment(comment: Column) -> Column:
    name = F.regexp_replace(F.trim(F.regexp_extract(comment, ACCEPTED, 1)), r"[,.;:]+$", "")
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat_ws(" ", name, F.regexp_extract(comment, ACCEPTED, 2))).otherwise("")
