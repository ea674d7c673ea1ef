"""Registered queries of the catalogue operators over the given tables, each with its SQL.

The tables are shaped into papers, repos and figure pages by the same SQL text on
both engines (``SHAPES``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import keys as K
from ..functions import venues as V
from ..operators import entities as M
from ..operators import reports as R
from ..operators.similar import dedup, similar_pairs
from ..sources.landed import links_from_pages
from .resolution_sql import resolution, similar
from .tables import table

SHAPES = {
    "paper": """
select doc_id as seq, replace(substring(text,1,60),chr(10),' ') as title,
 case when doc_id % 3 = 0 then concat('2407.', lpad(cast(doc_id % 400 as string),5,'0')) end as arxiv_id,
 case when doc_id % 5 = 0 then concat('10.18653/v1/2025.acl-long.', cast(doc_id % 150 as string)) end as doi,
 case doc_id % 4 when 0 then 's2_citation' when 1 then 'openalex_fulltext' when 2 then 'github_dependent' else 'scholar' end as source,
 case when doc_id % 13 = 0 then null else cast(2021 + doc_id % 6 as int) end as year,
 case doc_id % 6 when 0 then 'International Conference on Machine Learning' when 1 then 'ICLR 2026 Poster'
   when 2 then 'arXiv (Cornell University)' when 3 then 'Handbook of Human' when 4 then 'Nature Methods' end as venue,
 text as abstract from documents""",
    "repo": """
select c_custkey as seq, concat('owner', cast(c_nationkey as string)) as owner, c_name as repo,
 case when c_acctbal < 0 then null else cast(floor(c_acctbal) as int) % 50 end as stars,
 case when c_custkey % 4 = 0 then null else concat(lower(c_mktsegment), ' project') end as description,
 case when c_custkey % 6 = 0 then concat('https://arxiv.org/abs/2407.', lpad(cast(c_nationkey as string),5,'0')) end as linked_paper_url,
 case when c_custkey % 6 = 0 then cast(1 + c_custkey % 4 as int) end as linked_paper_tier,
 case when c_custkey % 17 = 0 then 'course-org/exercises' end as parent_full_name from customer""",
    # Names, identifiers and links of many forms, each document with one of each.
    "named": """
select doc_id as seq, case when doc_id % 13 = 0 then null else cast(2021 + doc_id % 6 as int) end as year,
 case doc_id % 20 when 0 then 'Proceedings of the 41st International Conference on Machine Learning' when 1 then 'ICLR 2026 Poster' when 2 then 'arXiv (Cornell University)' when 3 then 'Handbook of Human'
   when 4 then 'Nature Methods' when 5 then 'ICML 2025 Conference Desk Rejected Submission' when 6 then 'ICLR 2025 Desk Rejected Submission' when 7 then 'The Journal of Parts (Volume 2: Long Papers)'
   when 8 then 'arXiv preprint arXiv:2401.00001' when 9 then 'ICML 2025 2025' when 10 then 'Workshop on Graphs, 2024' when 11 then 'International Conference on 2023' when 12 then 'Transactions … on   Parts...'
   when 13 then '3rd Meeting of Parts' when 14 then 'Parts (unfinished' when 15 then null when 16 then '  ' when 17 then concat('Symposium ', cast(doc_id % 97 as string), ' Oral') when 18 then 'SSRN Electronic Journal' else concat('Letters on ', cast(2000 + doc_id % 30 as string)) end as venue,
 case when doc_id % 3 = 0 then concat('2407.', lpad(cast(doc_id % 400 as string),5,'0')) end as arxiv_id,
 case doc_id % 17 when 0 then concat('10.18653/v1/', cast(2015 + doc_id % 11 as string), '.findings-emnlp.', cast(doc_id as string)) when 1 then '10.18653/v1/2024.findings-acl.7' when 2 then '10.18653/v1/2022.findings-naacl.3' when 3 then '10.18653/v1/2023.blackboxnlp-1.2'
   when 4 then concat('10.18653/v1/', cast(2015 + doc_id % 11 as string), '.acl-long.9') when 5 then '10.18653/v1/2024.naacl-long.1' when 6 then '10.18653/V1/2024.EMNLP-main.4' when 7 then '10.18653/v1/2023.eacl-main.5' when 8 then '10.18653/v1/2022.aacl-short.6'
   when 9 then '10.1145/3715275.3732001' when 10 then '10.1145/3630106.3658901' when 11 then '10.48550/arXiv.2401.00001' when 12 then '10.18653/v1/W19-4828' when 13 then '10.1145/1.2' when 14 then '10.18653/v1/2024.findings-eacl.1' when 15 then concat('10.1000/', cast(doc_id as string)) end as doi,
 case doc_id % 8 when 0 then 'https://openreview.net/forum?id=a' when 1 then 'https://aclanthology.org/2024.acl-long.1' when 2 then 'https://dl.acm.org/doi/10.1145/1' when 3 then 'https://arxiv.org/pdf/2407.1' when 4 then concat('https://x.org/', cast(doc_id as string)) when 5 then '' end as url from documents""",
    "figure": """
select doc_id, concat('Figure ', cast(1 + doc_id % 4 as string), ': ',
 case doc_id % 3 when 0 then 'circuit overview' when 1 then 'logo of sponsor' else 'attention pattern' end) as caption,
 cast(doc_id % 9 as int) as page_num, cast(1 + doc_id % 4 as int) as figure_num, source from documents""",
}
#: A small venue dimension for the queries.
DIM = [V.Venue("ICML", "conference", ("International Conference on Machine Learning",)), V.Venue("ICLR", "conference"), V.Venue("Nature Methods", "journal"), V.Venue("arXiv", "preprint")]
KEYWORDS = ["ation", "ing", "el"]


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = "customer" if name == "repo" else "documents"
    return spark.sql(SHAPES[name].replace(f"from {base}", f"from {{{base}}}"), **{base: table(spark, sf_dir, base)})


def _with(name: str, body: str) -> str:
    return f"with {name} as ({SHAPES[name]})\n{body}"


_CASES: dict[str, tuple] = {}


def _query(sql: str | None):
    def register(f):
        _CASES[f.__name__] = (f, sql)
        return f

    return register


@_query(_with("paper", """
select seq, regexp_replace(arxiv_id, 'v[0-9]+$', '') as arxiv_norm,
 coalesce(try_cast(substring(arxiv_id, 1, 2) as int), 0) as yy,
 coalesce('arxiv:' || arxiv_id, 'doi:' || doi, 'title:' || lower(trim(title))) as record_key from paper"""))  # fmt: skip
def key_normalisation(spark, sf_dir):
    p = shape(spark, sf_dir, "paper")
    url = F.concat(F.lit("https://arxiv.org/abs/"), F.col("arxiv_id"), F.lit("v2"))
    return p.select("seq", K.normalize_arxiv_id(url).alias("arxiv_norm"), K.arxiv_year(F.col("arxiv_id")).alias("yy"), K.record_key(F.col("arxiv_id"), F.col("doi"), F.col("title")).alias("record_key"))


@_query(_with("paper", """
select seq, substring(sha256(coalesce(title,'') || '::' || coalesce(abstract,'')), 1, 16) as content_hash,
 length(regexp_replace(abstract, '^[\\s,]+|[\\s,]+$', '', 'g')) >= 20 as usable from paper"""))  # fmt: skip
def paper_hashes(spark, sf_dir):
    p = shape(spark, sf_dir, "paper")
    return p.select("seq", K.paper_hash(F.col("title"), F.col("abstract")).alias("content_hash"), K.usable_abstract(F.col("abstract")).alias("usable"))


@_query(_with("named", """
select seq, case when contains(url, 'openreview.net') then url
 when arxiv_id is not null and not (regexp_matches(coalesce(url, ''), 'aclanthology[.]org|dl[.]acm[.]org') and not contains(url, 'arxiv')) then 'https://arxiv.org/abs/' || arxiv_id
 when doi is not null and coalesce(url, '') = '' then 'https://doi.org/' || doi else coalesce(url, '') end as url from named"""))  # fmt: skip
def best_urls(spark, sf_dir):
    p = shape(spark, sf_dir, "named")
    return p.select("seq", K.best_url(F.col("url"), F.col("arxiv_id"), F.col("doi")).alias("url"))


@_query("""
select doc_id, array_to_string(list_slice(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1, 2), ' ') as summary from documents""")  # fmt: skip
def lead_sentence_summaries(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", K.lead_sentences(F.col("text"), 2).alias("summary"))


@_query(_with("paper", """
select seq, regexp_replace(trim(regexp_replace(title, '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s-]', '', 'g')), '\\s+', '-', 'g') as slug,
 coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'q') as file_slug from paper"""))  # fmt: skip
def title_slugs(spark, sf_dir):
    p = shape(spark, sf_dir, "paper")
    return p.select("seq", K.slug(F.col("title")).alias("slug"), K.file_slug(F.col("title")).alias("file_slug"))


DOI_RULE = """case when lower(doi) like '10.48550/arxiv.%' then 'ArXiv' when doi like '10.1145/3715275%' then 'FAccT 2025' when doi like '10.1145/3630106%' then 'FAccT 2024'
 when x.part in ('findings-emnlp', 'findings-acl', 'findings-naacl') then 'Findings of ' || upper(substring(x.part, 10)) || ' ' || x.y when x.part = 'blackboxnlp' then 'BlackboxNLP ' || x.y
 when x.part in ('acl', 'naacl', 'emnlp', 'eacl', 'aacl') and x.dash = '-' then upper(x.part) || ' ' || x.y else '' end"""
DOI_PARTS = "regexp_extract(lower(doi), '^10[.]18653/v1/([0-9]{4})[.](findings-[a-z]+|[a-z]+)(-?)', ['y', 'part', 'dash'])"


@_query(_with("named", f"select seq, {DOI_RULE} as doi_venue from (select seq, doi, {DOI_PARTS} as x from named)"))
def doi_venues(spark, sf_dir):
    return shape(spark, sf_dir, "named").select("seq", V.venue_from_doi(F.col("doi")).alias("doi_venue"))


#: The rule step by step; DIM has one alias. RE2 knows no back references, so a doubled year is compared as two groups.
NORMAL = """, a as (select *, replace(trim(venue), '…', '') as v from named),
b as (select * replace (regexp_replace(regexp_replace(regexp_replace(v, '[.]{3,}', '', 'g'), '\\s+', ' ', 'g'), '^[ ,;-]+|[ ,;-]+$', '', 'g') as v) from a),
c as (select * replace (trim(regexp_replace(v, '(?i)^Proceedings?\\s+of\\s+(the\\s+)?([0-9]+(st|nd|rd|th)\\s+)?', '')) as v) from b),
d as (select * replace (trim(regexp_replace(v, '(?i)\\s*[(]Volume\\s+[0-9]+:[^)]*[)]', '', 'g')) as v) from c),
e as (select * replace (trim(regexp_replace(v, '(?i)\\s+(Poster|Spotlight|Oral|Conference Desk Rejected Submission|Desk Rejected Submission)\\b', '', 'g')) as v) from d),
f as (select * replace (regexp_replace(trim(regexp_replace(v, '(?i)\\s*[(]Cornell\\s+University[)]\\s*', ' ', 'g')), '(?i)^(the|a|an)\\s+', '') as v) from e),
g as (select * replace (trim(regexp_replace(v, '(?i)International Conference on Machine Learning', 'ICML', 'g')) as v) from f),
h as (select * replace (case when x.one <> '' and x.one = x.two then replace(v, x.all, x.one) else v end as v) from (select *, regexp_extract(v, '(\\b(20[0-9]{2})\\s+(20[0-9]{2})\\b)', ['all', 'one', 'two']) as x from g)),
i as (select * replace (regexp_replace(regexp_replace(v, '\\s*,\\s+([0-9]{4}\\b)', ' \\1', 'g'), '^[ ,;-]+|[ ,;-]+$', '', 'g') as v) from h),
j as (select *, regexp_full_match(v, '(?i)(""" + "|".join(V.PLACEHOLDERS) + """)') or length(replace(v, '(', '')) <> length(replace(v, ')', '')) or regexp_matches(v, '(?i)^[0-9]+(st|nd|rd|th)\\b') as junk, lower(venue) as low from i)"""
NORMAL_NAME = "case when coalesce(trim(venue), '') = '' or junk then '' when year > 0 and not regexp_matches(v, '\\b20[0-9]{2}\\b') then trim(v || ' ' || year) else v end"
_TYPES = """
 case when contains(low, 'arxiv') then 'preprint' when contains(low, 'workshop') then 'workshop' when contains(low, 'nature methods') then 'journal' when contains(low, 'icml') or contains(low, 'iclr') then 'conference' else 'preprint' end as kind,
 coalesce(not contains(low, 'arxiv') and regexp_matches(low, 'icml|iclr|nature methods|workshop'), false) as reviewed,
 case when contains(low, 'arxiv') then 'preprint' when regexp_matches(low, '""" + "|".join(V.ROUTE_CONFERENCE) + """') then 'conference' when regexp_matches(low, '""" + "|".join(V.ROUTE_JOURNAL) + """') then 'journal' else 'unknown' end as route_kind from j"""


@_query(_with("named", f"{NORMAL} select seq, {NORMAL_NAME} as venue, {_TYPES}"))
def venue_normal_forms(spark, sf_dir):
    p, v = shape(spark, sf_dir, "named"), F.col("venue")
    return p.select("seq", V.normalize_venue(v, F.col("year"), DIM).alias("venue"), V.venue_type(v, DIM).alias("kind"), V.peer_reviewed(v, DIM).alias("reviewed"), V.route_venue_type(v).alias("route_kind"))


@_query("".join(["with k as (", " union all ".join(f"select doc_id, '{k}' as keyword, (length(text) - length(replace(lower(text), '{k}', ''))) // {len(k)} as hits, strpos(lower(text), '{k}') - 1 as first_pos from documents" for k in KEYWORDS), ") select doc_id, keyword, cast(hits as int) as hits, cast(first_pos as int) as first_pos from k where hits > 0"]))
def evidence_keyword_hits(spark, sf_dir):
    return E.keyword_hits(table(spark, sf_dir, "documents"), "doc_id", "text", KEYWORDS)


@_query("""
select doc_id, case when contains(lower(text), 'stupid') or contains(lower(text), 'licensed under') then 'strong'
 when contains(lower(text), 'ation') then 'weak' else 'none' end as label,
 contains(lower(text), 'ing') as mentioned from documents""")
def evidence_labels(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", E.first_label(t, [("strong", ["stupid", "Licensed under"]), ("weak", ["ation"])], "none").alias("label"), E.mentions(t, ["ING"]).alias("mentioned"))


@_query(_with("paper", """
select seq, band, case when year is null or not usable or not named then 'pending' when band in ('medium', 'low') then 'pending' else 'verified' end as bucket,
 case when year is null or not usable or not named then 'stub_metadata' when band = 'medium' then 'medium_confidence' when band = 'low' then 'low_confidence' end as reason
from (select seq, year, length(regexp_replace(abstract, '^[\\s,]+|[\\s,]+$', '', 'g')) >= 20 as usable, arxiv_id is not null or doi is not null as named,
  case when seq % 7 = 0 then 'certain' when seq % 7 = 1 then 'low' when seq % 4 <= 2 and seq % 4 > 0 then 'high' when seq % 3 >= 2 then 'high' else 'medium' end as band from paper)"""))  # fmt: skip
def confidence_and_buckets(spark, sf_dir):
    p, s = shape(spark, sf_dir, "paper"), F.col("seq")
    signal = F.when(s % 7 == 0, E.NEGATIVE).when(s % 7 == 1, "keyword_fallback").otherwise("llm")
    band = E.confidence_band(F.lit("referencing"), signal, F.when(s % 4 > 0, s % 4), s % 3)
    named = F.col("arxiv_id").isNotNull() | F.col("doi").isNotNull()
    both = p.withColumn("band", band).withColumn("d", E.decide_bucket(F.col("year"), K.usable_abstract(F.col("abstract")), named, F.lit("referencing"), F.lit(None).cast("string"), F.col("band")))
    return both.select("seq", "band", F.col("d.bucket").alias("bucket"), F.col("d.reason").alias("reason"))


@_query(_with("figure", """
select source, caption, page_num, cast(score as double) as score from (
 select source, caption, page_num, score, row_number() over (partition by source order by score desc, page_num, doc_id) as nth from (
  select *, greatest(0, case doc_id % 3 when 0 then 40 when 1 then -40 else 20 end - 2 * page_num + case figure_num when 1 then 35 when 2 then 35 when 3 then 15 else 0 end) as score from figure)
 where score > 0) where nth = 1"""))  # fmt: skip
def best_captions(spark, sf_dir):
    f = shape(spark, sf_dir, "figure").withColumn("score", E.caption_score(F.col("caption"), F.col("page_num"), F.col("figure_num"))).withColumn("ord", F.col("doc_id"))
    return R.best_caption(f, "source").select("source", "caption", "page_num", "score")


@_query(_with("paper", """
select seq, lower(trim(title)) as t from paper where (year is null or year >= 2023) and lower(trim(title)) not in ('of the', 'the')"""))  # fmt: skip
def year_and_exclusion_filters(spark, sf_dir):
    p = M.exclude(M.min_year(shape(spark, sf_dir, "paper"), 2023), "title", ["Of the", " the "])
    return p.select("seq", F.lower(F.trim("title")).alias("t"))


_ROUTE_SQL = _with("paper", """, old as (
 select *, seq % 23 = 0 as kept, seq % 5 <> 0 as s, seq % 6 <> 0 as c, true as th, true as af, substring(sha256(title || '::' || abstract), 1, 16) as h from paper where seq % 10 <> 0),
new as (
 select seq, arxiv_id, doi, case when seq % 11 = 0 then 'ICML 2025' else venue end as venue,
  substring(sha256(title || '::' || case when seq % 7 = 0 then abstract || ' more' else abstract end), 1, 16) as h from paper),
a as (select arxiv_id as k, max(seq) as m from old where arxiv_id is not null group by 1),
d as (select doi as k, max(seq) as m from old where doi is not null group by 1),
x as (select h as k, max(seq) as m from old group by 1),
met as (select new.*, coalesce(a.m, d.m, x.m) as matched from new left join a on arxiv_id = a.k left join d on doi = d.k left join x on new.h = x.k),
paired as (select met.*, old.kept, old.h as old_h, old.s and old.c and old.th and old.af as full_, old.s, old.c,
  coalesce(lower(old.venue) like '%arxiv%', false) and (lower(met.venue) like '%conf%' or lower(met.venue) like '%icml%' or lower(met.venue) like '%iclr%' or lower(met.venue) like '%nature%') as up
  from met left join old on met.matched = old.seq),
r as (select *, case when matched is null then 'new' when kept and full_ then 'protected' when kept then 'fill_gaps' when up or old_h <> h then 'reprocess' when not full_ then 'fill_gaps' else 'skip' end as route from paired)
select seq, matched, route, route in ('new', 'reprocess') or (route = 'fill_gaps' and not s) as needs_summary,
 route in ('new', 'reprocess') or (route = 'fill_gaps' and not c) as needs_classification from r""")  # fmt: skip


def _snapshots(spark, sf_dir):
    p, s = shape(spark, sf_dir, "paper"), F.col("seq")
    text = lambda a: K.paper_hash(F.col("title"), a)
    old = p.where(s % 10 != 0).select("*", (s % 23 == 0).alias("manual_override"), (s % 5 != 0).alias("has_summary"), (s % 6 != 0).alias("has_classification"), F.lit(True).alias("has_thumbnail"), F.lit(True).alias("has_affiliations"), text(F.col("abstract")).alias("content_hash"))
    changed = F.when(s % 7 == 0, F.concat("abstract", F.lit(" more"))).otherwise(F.col("abstract"))
    new = p.select("seq", "arxiv_id", "doi", F.when(s % 11 == 0, "ICML 2025").otherwise(F.col("venue")).alias("venue"), text(changed).alias("content_hash"))
    return old, new


@_query(_ROUTE_SQL)
def route_papers(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return M.route(new, old).select("seq", "matched", "route", "needs_summary", "needs_classification")


@_query(f"select route, count(*) as n from ({_ROUTE_SQL}) group by route")
def route_counts(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return R.counts_by(M.route(new, old), "route")


@_query(_with("paper", """
select arxiv_id, min(seq) as seq, arg_min(doi, seq) filter (where doi is not null) as doi, arg_min(year, seq) filter (where year is not null) as year
from paper where arxiv_id is not null group by arxiv_id"""))  # fmt: skip
def cluster_fill_gaps(spark, sf_dir):
    p = shape(spark, sf_dir, "paper").where("arxiv_id is not null")
    return M.coalesce_cluster(p, "arxiv_id", ["doi", "year"])


@_query(_with("paper", """
select arxiv_id, coalesce(arg_min(venue, seq) filter (where seq % 6 in (0, 1, 4)), arg_min(venue, seq) filter (where venue is not null)) as venue
from paper where arxiv_id is not null group by arxiv_id"""))  # fmt: skip
def cluster_venues(spark, sf_dir):
    return M.venue_survivor(shape(spark, sf_dir, "paper").where("arxiv_id is not null"), "arxiv_id", DIM)


_UNLINK_SQL = """, shared as (select linked_paper_url as u from repo where linked_paper_url is not null group by 1 having count(*) >= 5),
ranked as (select repo.*, u, row_number() over (partition by linked_paper_url order by coalesce(stars, 0) desc, seq) as nth from repo left join shared on linked_paper_url = u),
cleaned as (select seq, repo, description, stars, parent_full_name, u is not null and nth > 1 as unlinked, case when u is null or nth = 1 then linked_paper_url end as linked_paper_url from ranked)
"""


@_query(_with("repo", _UNLINK_SQL + """
select seq, unlinked, linked_paper_url, case when parent_full_name = 'course-org/exercises' then 'course'
 when unlinked and coalesce(stars, 0) = 0 and description is null then 'course' when contains(lower(repo || ' ' || coalesce(description, '')), 'machinery') then 'course'
 when linked_paper_url is not null then 'research' when coalesce(stars, 0) >= 6 and description is not null then 'research' else 'experiment' end as kind from cleaned"""))  # fmt: skip
def repo_types(spark, sf_dir):
    r = M.unlink_shared(shape(spark, sf_dir, "repo"), 5)
    kind = M.repo_type(F.col("repo"), F.col("description"), F.col("stars"), F.col("linked_paper_url"), F.col("parent_full_name"), F.col("unlinked"), F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("string"), ["course-org/exercises"], ["machinery"])
    return r.select("seq", "unlinked", "linked_paper_url", kind.alias("kind"))


@_query(f"""with paper as ({SHAPES['paper']}), repo as ({SHAPES['repo']}),
l as (select substring(linked_paper_url, 23) as id, arg_min(owner || '/' || repo, seq) as url, min(linked_paper_tier) as tier from repo where linked_paper_url is not null group by 1)
select seq, l.url as project_url, tier as linked_paper_tier from paper left join l on arxiv_id = id""")
def link_repos_to_papers(spark, sf_dir):
    r = shape(spark, sf_dir, "repo").select("seq", F.concat_ws("/", "owner", "repo").alias("url"), "linked_paper_tier", K.arxiv_id_from_url(F.col("linked_paper_url")).alias("linked_arxiv_id"))
    p = shape(spark, sf_dir, "paper").select("seq", "arxiv_id", F.lit(None).cast("string").alias("project_url"), F.lit(None).cast("int").alias("linked_paper_tier"))
    return M.link_repos(r, p).select("seq", "project_url", "linked_paper_tier")


@_query(_with("repo", """, o as (select repo as key, stars, date '2025-01-01' as first_seen, date '2025-05-20' + cast(seq % 60 as int) - 30 as last_seen, seq % 23 = 0 as kept from repo where seq % 10 <> 0),
n as (select repo as key, stars + 1 as stars from repo where seq % 3 <> 0)
select coalesce(n.key, o.key) as key, case when n.key is not null and not coalesce(kept, false) then n.stars else o.stars end as stars,
 coalesce(first_seen, date '2025-06-01') as first_seen, case when n.key is not null then date '2025-06-01' else last_seen end as last_seen, coalesce(kept, false) as manual_override
from n full join o on n.key = o.key where n.key is not null or kept or date '2025-06-01' - last_seen <= 30"""))  # fmt: skip
def merge_repo_state(spark, sf_dir):
    r, s = shape(spark, sf_dir, "repo"), F.col("seq")
    old = r.where(s % 10 != 0).select(F.col("repo").alias("key"), "stars", F.to_date(F.lit("2025-01-01")).alias("first_seen"), F.date_add(F.to_date(F.lit("2025-05-20")), (s % 60 - 30).cast("int")).alias("last_seen"), (s % 23 == 0).alias("manual_override"))
    new = r.where(s % 3 != 0).select(F.col("repo").alias("key"), (F.col("stars") + 1).alias("stars"))
    return M.merge_repos(new, old, F.to_date(F.lit("2025-06-01")))


@_query(_with("repo", """, a as (select seq, stars, description from repo where seq % 10 <> 0), b as (select seq, case when seq % 7 = 0 then stars + 1 else stars end as stars, description from repo where seq % 9 <> 0),
j as (select coalesce(a.seq, b.seq) as seq, cast(a.stars as string) as s0, cast(b.stars as string) as s1, a.description as d0, b.description as d1 from a full join b on a.seq = b.seq)
select seq, 'stars' as field, s0 as old, s1 as new from j where s0 is distinct from s1 union all select seq, 'description', d0, d1 from j where d0 is distinct from d1"""))  # fmt: skip
def state_diff(spark, sf_dir):
    r, s = shape(spark, sf_dir, "repo"), F.col("seq")
    before = r.where(s % 10 != 0)
    after = r.where(s % 9 != 0).withColumn("stars", F.when(s % 7 == 0, F.col("stars") + 1).otherwise(F.col("stars")))
    return M.diff(before, after, "seq", ["stars", "description"])


@_query(_with("repo", """
select seq, case when seq % 12 = 0 then 'discarded' when seq % 4 = 0 then 'verified' when seq % 3 = 0 then 'pending' else 'pending' end as bucket,
 case when seq % 12 = 0 then 'spam' when seq % 4 = 0 then null when seq % 3 = 0 then 'checked' else 'low_confidence' end as reason, seq % 4 = 0 or seq % 3 = 0 as manual_override from repo"""))  # fmt: skip
def curation(spark, sf_dir):
    r, s = shape(spark, sf_dir, "repo"), F.col("seq")
    state = r.select(s.alias("key"), F.lit("pending").alias("bucket"), F.lit("low_confidence").alias("reason"), F.lit(False).alias("manual_override"))
    act = lambda cond, n, name, why: r.where(cond).select(s.alias("key"), F.lit(n).alias("seq"), F.lit(name).alias("action"), F.lit(why).cast("string").alias("reason"))
    actions = act(s % 3 == 0, 1, "demote", "checked").unionByName(act(s % 4 == 0, 2, "promote", None)).unionByName(act(s % 12 == 0, 3, "discard", "spam"))
    return M.apply_curation(state, actions).withColumnRenamed("key", "seq")


@_query(_with("paper", """select coalesce(source, 'unknown') as source, coalesce(cast(year as string), 'unknown') as year, count(*) as n from paper group by 1, 2"""))
def source_report(spark, sf_dir):
    return R.counts_by(shape(spark, sf_dir, "paper"), "source", "year")


@_query(_with("repo", """, t as (select owner, repo, stars, row_number() over (partition by owner order by stars desc nulls last, seq) as position, count(*) over (partition by owner) as total from repo)
select owner, repo, stars, position, greatest(total - 15, 0) as more from t where position <= 15"""))  # fmt: skip
def top_repos_by_owner(spark, sf_dir):
    top = R.head_with_rest(shape(spark, sf_dir, "repo"), "owner", [F.desc_nulls_last("stars"), "seq"], 15)
    return top.select("owner", "repo", "stars", "position", "more")


@_query(_with("paper", "select seq, title, year from paper order by year desc nulls last, lower(title), seq"))
def paper_listing(spark, sf_dir):
    return R.listing(shape(spark, sf_dir, "paper")).select("seq", "title", "year")


@_query("""select page_id, link, count(*) as hits from (select page_id, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) as link from pages) group by 1, 2""")
def page_links(spark, sf_dir):
    return links_from_pages(table(spark, sf_dir, "pages"), r'href="/([^"]+)"')


@_query("""with l as (select user_id, max(ts) as last from events group by 1)
select e.event_id, e.user_id from events e join l on e.user_id = l.user_id and e.ts = l.last where l.last > (select max(ts) from events) - interval 48 hour""")
def latest_event_batches(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    as_of = events.agg(F.max("ts")).first()[0]
    return M.latest_batch(events, "user_id", "ts", 48, F.lit(as_of)).select("event_id", "user_id")


@_query(_with("paper", """, old as (select seq, source from paper where seq % 2 = 0), new as (select seq, 'fresh' as source from paper where seq % 3 = 0)
select * from old where seq not in (select seq from new) union all select * from new"""))  # fmt: skip
def overlay_state(spark, sf_dir):
    p, s = shape(spark, sf_dir, "paper"), F.col("seq")
    return M.overlay(p.where(s % 2 == 0).select("seq", "source"), p.where(s % 3 == 0).select("seq", F.lit("fresh").alias("source")), "seq")


@_query(_with("paper", f""", rows as (select seq as k, lower(trim(title)) as t from paper), {similar('s', 'rows')}
select a, b, score from s union all select r.k, c.k, 100.0 from rows r join s_c c using (t) where r.k <> c.k"""))
def similar_titles(spark, sf_dir):
    return similar_pairs(shape(spark, sf_dir, "paper").select("seq", "title"))


@_query("with recursive " + _with("paper", f", {resolution('g', 'paper')} select seq, leader from g").removeprefix("with "))
def dedup_papers(spark, sf_dir):
    return dedup(shape(spark, sf_dir, "paper").select("seq", "title", "arxiv_id", "doi"), ["arxiv_id", "doi"])


def queries() -> dict:
    return {name: f for name, (f, _) in _CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _CASES.items() if sql}
