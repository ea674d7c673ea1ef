"""Registered queries of enrichment, linking and the curated state, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import affiliations as A
from ..functions import evidence as E
from ..functions import figures as G
from ..functions import keys as K
from ..functions import readme as R
from ..operators import decisions as D
from ..operators import enrich as N
from ..operators import entities as M
from ..operators import reports as P
from ..operators import state as S
from ..sources import landed as L
from .catalogue import DIM, DOI_PARTS, DOI_RULE, NORMAL, NORMAL_NAME, _with, shape
from .resolution_sql import resolution, similar
from .runs import Stages, discover, run, run_repos
from .tables import shared_dir, table, written

_CASES: dict[str, tuple] = {}


def _query(sql: str | None):
    def register(f):
        _CASES[f.__name__] = (f, sql)
        return f

    return register


#: A readme per document, the same text on both engines: a section, an entry, links of several years.
_README = """concat('intro ', substring(text, 1, 40), chr(10), '# Usage', chr(10), 'see https://arxiv.org/abs/18', lpad(cast(1 + doc_id % 12 as string), 2, '0'), '.00001',
 case when doc_id % 4 >= 1 then concat(' and https://arxiv.org/abs/23', lpad(cast(1 + doc_id % 12 as string), 2, '0'), '.10001') else '' end,
 case when doc_id % 4 >= 2 then ' and https://arxiv.org/pdf/2401.20002' else '' end, chr(10),
 case when doc_id % 5 = 0 then concat('## How to Cite', chr(10), 'https://arxiv.org/abs/2105.30003', chr(10)) else '' end,
 case when doc_id % 7 = 0 then concat('@misc{key,', chr(10), ' title = {A {nested} one},', chr(10), ' eprint = {2207.40004v2}', chr(10), '}', chr(10)) else '' end,
 case when doc_id % 11 = 0 then '@article{open, eprint = {2209.50005}' else '' end)"""
README = f"select doc_id as seq, {_README} as readme from documents"


def _readmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.expr(_README).alias("readme"))


@_query("""
select doc_id as seq, case when doc_id % 7 = 0 then 'https://arxiv.org/abs/2207.40004' when doc_id % 5 = 0 then 'https://arxiv.org/abs/2105.30003'
 when doc_id % 4 >= 2 then 'https://arxiv.org/abs/2401.20002' when doc_id % 4 = 1 then 'https://arxiv.org/abs/23' || lpad(cast(1 + doc_id % 12 as varchar), 2, '0') || '.10001' end as linked_paper_url,
 case when doc_id % 7 = 0 then 1 when doc_id % 5 = 0 then 2 when doc_id % 4 >= 2 then 4 when doc_id % 4 = 1 then 3 end as linked_paper_tier from documents where text is not null""")  # fmt: skip
def linked_papers(spark, sf_dir):
    r = _readmes(spark, sf_dir).where("readme is not null").withColumn("ids", K.arxiv_ids_in(F.col("readme")))
    return R.linked_paper(r, "seq", "readme", "ids").select("seq", "linked_paper_url", "linked_paper_tier")


@_query(f"""with r as ({README}), l as (select seq, unnest(string_split(readme, chr(10))) as line, generate_subscripts(string_split(readme, chr(10)), 1) as nth from r where readme is not null),
h as (select *, nullif(regexp_extract(line, '^#{{1,6}}[ \\t]+(.+)$', 1), '') as head from l),
g as (select *, count(head) over (partition by seq order by nth) as part from h)
select seq, coalesce(lower(trim(max(head))), '') as header, coalesce(sum(length(line)) filter (where head is null), 0) + greatest(count(*) filter (where head is null) - 1, 0)
 - case when part = max(part) over (partition by seq) and right(max(readme), 1) = chr(10) then 1 else 0 end as n_chars
from g join r using (seq) group by seq, part""")  # fmt: skip
def readme_sections(spark, sf_dir):
    r = _readmes(spark, sf_dir).select("seq", F.inline(R.sections(F.col("readme"))))
    return r.select("seq", "header", F.length("body").cast("long").alias("n_chars"))


@_query("""
select doc_id, case when regexp_matches(h, '\\b(abstract)\\b') then 'abstract' when regexp_matches(h, '\\b(introduction)\\b') then 'introduction' when regexp_matches(h, '\\b(related work|background|prior work)\\b') then 'related'
 when regexp_matches(h, '\\b(method|methodology|approach|model|architecture)\\b') then 'method' when regexp_matches(h, '\\b(experiment|evaluation|result)\\b') then 'results' else 'unknown' end as section,
 cast(case when w * v < 15000 then 0 else case when w * v > 500000 then -20 when w * v > 50000 and w * v < 300000 then 10 else 0 end
  + case when greatest(w, v) > 5 * least(w, v) then -15 when greatest(w, v) > 3 * least(w, v) then -5 else 5 end + case when doc_id % 2 = 0 then 20 + doc_id % 40 else 0 end
  + case when doc_id % 3 = 0 then 25 when doc_id % 3 = 1 then 15 else 0 end + case when doc_id % 9 <= 2 then 5 else 0 end end as double) as score
from (select doc_id, lower(substring(text, 1, 2000)) as h, 40 + doc_id % 900 as w, 60 + (doc_id * 7) % 800 as v from documents)""")  # fmt: skip
def image_scores(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    kind = F.when(i % 3 == 0, "method").when(i % 3 == 1, "results").otherwise("unknown")
    score = G.image_score(F.lit(40) + i % 900, F.lit(60) + (i * 7) % 800, F.when(i % 2 == 0, i % 40), kind, i % 9)
    return d.select("doc_id", G.page_section(F.col("text")).alias("section"), score.alias("score"))


#: What is offered, in order, put into normal form; the first that is known counts.
_CASCADE = _with("named", f""", told as (select *, case seq % 7 when 1 then 'Accepted at ICLR 2024.' when 4 then 'To appear in Nature Methods, 2025' when 5 then '12 pages' end as comment,
  case seq % 11 when 2 then 'ICML' when 3 then 'corr 2023' when 4 then 'Some Meeting' end as s2, case seq % 5 when 3 then 'A series of notes' when 4 then 'Nature Methods' end as crossref, {DOI_PARTS} as x from named),
said as (select *, regexp_extract(comment, '(?i)\\b(Accepted (at|to|in)|Published (in|at)|Appeared (at|in)|Presented at|To appear (in|at)|Camera-ready for)\\b\\s+(.+?)\\s+\\b(20[0-9]{{2}})\\b', ['a', 'b', 'c', 'd', 'e', 'name', 'dated']) as n from told),
offers as (select seq, year, unnest([{{'at': 1, 'source': 'doi_prefix', 'raw': {DOI_RULE}}}, {{'at': 2, 'source': 'arxiv_comment_parsed', 'raw': case when n.name <> '' then regexp_replace(trim(n.name), '[,.;:]+$', '') || ' ' || n.dated end}},
  {{'at': 3, 'source': 's2', 'raw': s2}}, {{'at': 4, 'source': 'crossref', 'raw': crossref}}, {{'at': 5, 'source': 'existing', 'raw': venue}}]) as o from said),
offered as (select seq, year, o.at as nth, o.source as source, o.raw as venue from offers where trim(o.raw) <> '')
""" + NORMAL.replace("from named)", "from offered)", 1) + f""", normal as (select seq, nth, source, {NORMAL_NAME} as name from j),
best as (select seq, arg_min(name, nth) as name, arg_min(source, nth) as source from normal where name <> '' and (source = 'doi_prefix' or regexp_matches(name, '(?i)\\b(ICML|ICLR)\\b|nature methods')) group by seq)
select seq, coalesce(name, trim('ArXiv ' || coalesce(cast(year as varchar), ''))) as venue, coalesce(source, 'fallback') as venue_source,
 case when source in ('doi_prefix', 'arxiv_comment_parsed') then coalesce(try_cast(nullif(regexp_extract(name, '\\b20[0-9]{{2}}\\b'), '') as int), year) else year end as year from named left join best using (seq)""")  # fmt: skip


@_query(_CASCADE)
def venue_cascade(spark, sf_dir):
    s = F.col("seq")
    comment = F.when(s % 7 == 1, "Accepted at ICLR 2024.").when(s % 7 == 4, "To appear in Nature Methods, 2025").when(s % 7 == 5, "12 pages")
    s2 = F.when(s % 11 == 2, "ICML").when(s % 11 == 3, "corr 2023").when(s % 11 == 4, "Some Meeting")
    crossref = F.when(s % 5 == 3, "A series of notes").when(s % 5 == 4, "Nature Methods")
    told = F.create_map(F.lit("arxiv_comment"), comment, F.lit("s2"), s2, F.lit("crossref"), crossref)
    p = shape(spark, sf_dir, "named").withColumns({"signals": told, "openalex_id": F.lit(None).cast("string")})
    return N.resolve_venue(p, DIM).select("seq", "venue", "venue_source", "year")


@_query(_with("paper", """, q as (select *, venue is null or seq % 9 in (0, 3) as open_ from paper),
reg as (select doi as k, min(seq) as m from paper where doi is not null and seq % 2 = 0 group by 1), feed as (select arxiv_id as k, min('author ' || lpad(cast(seq as varchar), 9, '0')) as a from paper where arxiv_id is not null and seq % 2 = 1 group by 1),
cit as (select arxiv_id as k from paper where arxiv_id is not null and seq % 4 = 0 group by 1), citd as (select doi as k from paper where doi is not null and seq % 4 = 0 group by 1),
rev as (select lower(trim(title)) as k, min('ICLR ' || lpad(cast(seq as varchar), 9, '0')) as v from paper where seq % 5 = 0 and lower(trim(title)) <> '' group by 1)
select q.seq, reg.k is not null as crossref, cit.k is not null or citd.k is not null as s2, feed.k is not null as noted, feed.a as authors, rev.v as review from q left join rev on lower(trim(title)) = rev.k and open_ left join reg on doi = reg.k left join cit on arxiv_id = cit.k and open_ left join citd on doi = citd.k and open_ and arxiv_id is null left join feed on arxiv_id = feed.k"""))  # fmt: skip
def venue_signals(spark, sf_dir):
    p, s = shape(spark, sf_dir, "paper"), F.col("seq")
    held = F.when(s % 9 == 0, F.lit(None).cast("string")).when(s % 9 == 3, "arXiv preprint 2401").otherwise(F.col("venue"))
    papers = p.withColumns({"venue": held, "affiliations": F.lit(None).cast("string"), "authors": F.lit(None).cast("string")})
    registry = p.where(s % 2 == 0).select("doi", F.lit("ACL").alias("venue"), F.lit("First Lab").alias("affiliations"))
    citations = p.where(s % 4 == 0).select("arxiv_id", "doi", F.lit("ICML").alias("venue"))
    reviews = p.where(s % 5 == 0).select("title", F.concat(F.lit("ICLR "), F.lpad(s.cast("string"), 9, "0")).alias("venue"))
    feed = p.where(s % 2 == 1).select("arxiv_id", F.concat(F.lit("author "), F.lpad(s.cast("string"), 9, "0")).alias("authors"), F.lit(None).cast("string").alias("affiliations"), F.lit(None).cast("string").alias("journal_ref"), F.lit("Accepted at ICML 2024").alias("comment"))
    out = N.collect_signals(papers, registry, citations, reviews, feed)
    there = lambda k: F.map_contains_key("signals", F.lit(k))
    return out.select("seq", there("crossref").alias("crossref"), there("s2").alias("s2"), there("arxiv_comment").alias("noted"), "authors", F.try_element_at("signals", F.lit("openreview")).alias("review"))


@_query(_with("paper", """, w as (select seq, arxiv_id, doi, case when seq % 3 = 0 then 'Lab ' || lpad(cast(seq as varchar), 9, '0') end as a from paper where seq % 2 = 0),
x as (select arxiv_id as k, min(a) as a from w where arxiv_id is not null group by 1), y as (select doi as k, min(a) as a from w where doi is not null group by 1),
t as (select lower(trim(title)) as k, min(a) as a from w join paper using (seq) where seq % 4 = 0 and trim(title) <> '' group by 1), z as (select 'W' || seq as k, a from w where seq % 4 = 0)
select seq, case when seq % 5 = 1 then 'own' when z.k is not null then z.a when x.k is not null then x.a when y.k is not null then y.a else t.a end as affiliations
from paper left join x on arxiv_id = x.k left join y on doi = y.k left join t on lower(trim(title)) = t.k left join z on seq % 9 = 0 and 'W' || seq = z.k"""))  # fmt: skip
def affiliation_backfill(spark, sf_dir):
    p, s, none = shape(spark, sf_dir, "paper"), F.col("seq"), F.lit(None).cast("string")
    works = p.where(s % 2 == 0).select("arxiv_id", "doi", F.when(s % 4 == 0, F.col("title")).alias("title"), F.when(s % 4 == 0, F.concat(F.lit("W"), s)).alias("openalex_id"), F.when(s % 3 == 0, F.concat(F.lit("Lab "), F.lpad(s.cast("string"), 9, "0"))).alias("affiliations"))
    papers = p.withColumns({"affiliations": F.when(s % 5 == 1, "own"), "openalex_id": F.when(s % 9 == 0, F.concat(F.lit("https://openalex.org/W"), s))})
    return N.fill_affiliations(papers, works).select("seq", "affiliations")


_PAGE = """'A Title' || chr(10) || 'Ann Bee, Cy Dow' || chr(10) || case doc_id % 4 when 0 then '1First University 2Second Institute' when 1 then 'Third Lab♡, Fourth Center♣' || chr(10) when 2 then 'University of Fifth' || chr(10) || 'a@b.org' else 'nowhere' end || chr(10) || 'Abstract' || chr(10) || substring(text, 1, 100)"""


@_query("""select doc_id, case doc_id % 4 when 0 then 'First University; Second Institute' when 1 then 'Third Lab; Fourth Center' when 2 then 'University of Fifth' else '' end as affiliations from documents where text is not null""")
def page_affiliations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    pages = d.select("doc_id", F.lit(1).alias("page_num"), F.expr(_PAGE).alias("text"))
    return A.first_pages(pages, "doc_id").select("doc_id", F.array_join(A.affiliations(F.col("text"), F.lit("Ann Bee, Cy Dow")), "; ").alias("affiliations"))


@_query("""
select 'work ' || cast(doc_id as varchar) as title, '10.1/' || cast(doc_id as varchar) as doi, 'A. One, B. Two' as authors, 'Inst A, Inst B' as affiliations,
 case when doc_id % 2 = 0 then 'ICML' else 'arXiv (host)' end as venue, 2024 as year, 'https://doi.org/10.1/' || cast(doc_id as varchar) as url, case when doc_id % 2 = 0 then 'http://x/y.pdf' end as pdf_url, 'one two one' as abstract from documents""")  # fmt: skip
def works_records(spark, sf_dir):
    place = lambda n, t, pdf: f"named_struct('pdf_url', {pdf}, 'source', named_struct('display_name', {n}, 'type', {t}))"
    inst = lambda x: f"array(named_struct('display_name', '{x}'))"
    author = lambda n, i: f"named_struct('author', named_struct('display_name', '{n}'), 'institutions', {inst(i)})"
    raw = table(spark, sf_dir, "documents").selectExpr(
        "concat('work ', doc_id) as title", "concat('W', doc_id) as id", "concat('https://doi.org/10.1/', doc_id) as doi", "'2024-02-03' as publication_date",
        f"array({author('A. One', 'Inst B')}, {author('B. Two', 'Inst A')}) as authorships",
        "named_struct('landing_page_url', cast(null as string), 'pdf_url', cast(null as string), 'source', named_struct('display_name', 'arXiv (host)')) as primary_location",
        f"array({place(repr('Store'), repr('repository'), 'cast(null as string)')}, {place('if(doc_id % 2 = 0, ' + repr('ICML') + ', null)', repr('conference'), repr('http://x/y.pdf'))}) as locations",
        "map('one', array(0, 2), 'two', array(1)) as abstract_inverted_index",
    )
    return L.works_to_papers(raw).select("title", "doi", "authors", "affiliations", "venue", "year", "url", "pdf_url", "abstract")


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with every field of the state."""
    s, none = F.col("seq"), F.lit(None).cast("string")
    empty = "authors affiliations pdf_url s2_paper_id openalex_id url project_url image reason_detail description unclassified_reason venue_source".split()
    band = F.when(s % 3 == 0, "high").when(s % 3 == 1, "medium").otherwise("low")
    return shape(spark, sf_dir, "paper").withColumns({c: none for c in empty} | {"category": F.lit("referencing"), "category_confidence_band": band, "bucket": F.when(s % 2 == 0, "pending").otherwise("verified"), "reason": none, "manual_override": s % 23 == 0, "peer_reviewed": F.lit(False), **{f"has_{x}": F.lit(False) for x in ("summary", "classification", "thumbnail", "affiliations")}})


_STATE = _with("paper", """, st as (select *, seq % 23 = 0 as kept, case when seq % 3 = 0 then 'high' when seq % 3 = 1 then 'medium' else 'low' end as band, case when seq % 2 = 0 then 'pending' else 'verified' end as bucket,
 year is null or length(regexp_replace(abstract, '^[\\s,]+|[\\s,]+$', '', 'g')) < 20 or (arxiv_id is null and doi is null) as stub from paper),
de as (select *, case when stub or band <> 'high' then 'pending' else 'verified' end as now, case when stub then 'stub_metadata' when band = 'medium' then 'medium_confidence' when band = 'low' then 'low_confidence' end as why from st)
""")


@_query(_STATE + """select seq, case when kept then bucket else now end as bucket, case when not kept and bucket <> now then why end as reason,
 case when not kept and bucket = 'pending' and now = 'verified' then 'promoted' when not kept and bucket = 'verified' and now = 'pending' then 'demoted' end as moved from de""")  # fmt: skip
def bucket_moves(spark, sf_dir):
    return S.rebucket(_papers(spark, sf_dir)).select("seq", "bucket", "reason", "moved")


@_query(_with("paper", """, n as (select seq, arxiv_id as k, case when seq % 2 = 0 then 'ICML 2025' else 'arXiv preprint' end as venue, case when seq % 2 = 0 then 2025 end as year, repeat('a', cast(seq % 30 as int)) as authors, seq % 2 = 0 as solid from paper where arxiv_id is not null),
g as (select k, arg_max(venue, seq) filter (where solid) as v, max(seq) filter (where solid) as vs, max(seq) filter (where not solid) as js, arg_max(year, seq) filter (where solid) as y, max(length(authors)) as la, count(*) as c from n group by 1)
select p.seq, case when p.seq % 23 = 0 or k is null then p.venue when v is null then case when coalesce(p.venue, '') = 'International Conference on Machine Learning' then trim('ICML ' || coalesce(cast(p.year as varchar), '')) when p.venue = 'ICLR 2026 Poster' then 'ICLR 2026' when p.venue = 'Nature Methods' then trim('Nature Methods ' || coalesce(cast(p.year as varchar), '')) else 'arXiv preprint' end else v end as venue,
 case when p.seq % 23 = 0 or k is null then p.year else coalesce(y, p.year) end as year, case when p.seq % 23 = 0 or k is null or la = 0 then 0 else la end as n_authors from paper p left join g on p.arxiv_id = k"""))  # fmt: skip
def paper_updates(spark, sf_dir):
    old, s = _papers(spark, sf_dir), F.col("seq")
    new = old.where("arxiv_id is not null").withColumns({"solid": s % 2 == 0, "authors": F.repeat(F.lit("a"), (s % 30).cast("int"))}).withColumns({"venue": F.when(F.col("solid"), "ICML 2025").otherwise("arXiv preprint"), "year": F.when(F.col("solid"), 2025), "venue_source": F.when(F.col("solid"), "doi_prefix").otherwise("fallback")}).withColumns({"abstract": F.lit(None).cast("string"), "doi": F.lit(None).cast("string")})
    out = S.apply_updates(old, new.withColumn("matched", F.col("arxiv_id")).drop("solid"), DIM, on="arxiv_id")
    return out.select("seq", "venue", "year", F.coalesce(F.length("authors"), F.lit(0)).alias("n_authors"))


@_query(_STATE + """select seq, case when seq % 10 = 0 then 'edited ' || cast(seq as varchar) else title end as title, case when seq % 10 = 5 then 2020 else year end as year,
 case when seq % 10 = 0 and seq % 20 = 0 then 'discarded' when seq % 10 = 0 then now when seq % 10 = 5 then case when band <> 'high' or length(regexp_replace(abstract, '^[\\s,]+|[\\s,]+$', '', 'g')) < 20 or (arxiv_id is null and doi is null) then 'pending' else 'verified' end else bucket end as bucket, kept or seq % 5 = 0 as manual_override from de""")  # fmt: skip
def field_edits(spark, sf_dir):
    p, s = _papers(spark, sf_dir), F.col("seq")
    edit = lambda where, n, f, v: p.where(where).select("seq", F.lit(n).alias("ord"), F.lit(f).alias("field"), v.alias("value"))
    edits = edit(s % 10 == 0, 1, "title", F.lit("first try")).unionByName(edit(s % 10 == 0, 2, "Title", F.concat(F.lit("edited "), s))).unionByName(edit(s % 10 == 5, 1, "year", F.lit(" 2020 "))).unionByName(edit(s % 20 == 0, 3, "bucket", F.lit("DISCARDED")))
    return S.apply_edits(p, edits).select("seq", "title", "year", "bucket", "manual_override")


@_query(_with("paper", """, v as (select seq, 'category' as field, 'referencing' as old, 'uses_library' as new from paper where seq % 23 <> 0 and seq % 4 = 0
 union all select seq, 'category_confidence_band', case when seq % 3 = 0 then 'high' when seq % 3 = 1 then 'medium' else 'low' end, 'high' from paper where seq % 23 <> 0 and seq % 4 = 0 and seq % 3 <> 0) select * from v"""))  # fmt: skip
def reclassified(spark, sf_dir):
    p, s = _papers(spark, sf_dir), F.col("seq")
    verdicts = p.where(s % 4 == 0).select("seq", F.lit("uses_library").alias("category"), F.lit("high").alias("category_confidence_band"))
    return S.reclassify(p, verdicts)[1]


@_query(_with("paper", """
select seq, case when seq % 3 = 1 and seq % 23 = 0 then 'old ' || title else title end as title, case when seq % 3 = 0 or (seq % 3 = 1 and seq % 23 = 0) then 'uses_library' else 'referencing' end as category from paper"""))  # fmt: skip
def carried_curation(spark, sf_dir):
    p, s = _papers(spark, sf_dir), F.col("seq")
    was = {"title": F.concat(F.lit("old "), "title"), "category": F.lit("uses_library")}
    old = F.struct(*(was.get(c, F.col(c)).alias(c) for c in p.columns))
    rows = p.withColumns({"route": F.when(s % 3 == 0, "protected").when(s % 3 == 1, "fill_gaps").otherwise("new"), "old": old})
    return S.carry_curated(rows).select("seq", "title", "category")


@_query(_with("paper", """select title, coalesce(venue, '') as venue, year, coalesce(arxiv_id, '') as arxiv_id, coalesce(doi, '') as doi, source, '' as reason, seq % 23 = 0 as manual_override from paper where seq % 2 = 0"""))
def pending_sheet(spark, sf_dir):
    return S.sheet(_papers(spark, sf_dir), "pending").select("title", "venue", "year", "arxiv_id", "doi", "source", "reason", "manual_override")


@_query("""with k as (select unnest(['ation', 'ing']) as name), s as (select unnest(['text', 'abstract']) as section)
select doc_id as seq, section, name, cast((length(text) - length(replace(lower(text), name, ''))) // length(name) as varchar) as value from documents, k, s where text is not null
union all select doc_id, 'text', 'length', cast(length(text) as varchar) from documents where text is not null""")
def record_traces(spark, sf_dir):
    p = _papers(spark, sf_dir).where("abstract is not null").withColumn("linked_paper_tier", F.lit(None).cast("int"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")
    return S.trace(p, texts, ["ation", "ing"]).where("section in ('text', 'abstract')")


@_query(_with("repo", """select owner, repo, owner || '/' || repo as url, description, stars, cast(null as varchar) as forks, '2025-01-02' as last_commit, cast(null as varchar) as language, linked_paper_url,
 seq % 5 = 0 as is_course, seq % 2 = 0 as is_fork, parent_full_name from repo"""))  # fmt: skip
def public_repo_rows(spark, sf_dir):
    r, s = shape(spark, sf_dir, "repo"), F.col("seq")
    kind = F.when(s % 5 == 0, "course").when(s % 5 == 1, "research")
    return S.public_repos(r.withColumns({"url": F.concat_ws("/", "owner", "repo"), "last_commit": F.to_date(F.lit("2025-01-02")), "repo_type": kind, "is_fork": s % 2 == 0}))


@_query(_with("paper", """select count(*) filter (where source = 's2_citation') as s2_citation_found, count(*) filter (where source = 'scholar') as scholar_found, count(*) as total, count(*) filter (where seq % 5 = 0) as new,
 count(*) filter (where seq % 3 = 0 and seq % 5 <> 0) as updated, count(*) filter (where seq % 5 <> 0) as existing, count(*) filter (where seq % 4 = 0) as thumbnails, count(*) filter (where seq % 4 <> 0) as thumbnails_missing from paper"""))  # fmt: skip
def run_metrics_row(spark, sf_dir):
    p, s = shape(spark, sf_dir, "paper"), F.col("seq")
    state = p.select((s % 5 == 0).alias("added"), (s % 3 == 0).alias("changed"), F.when(s % 4 == 0, "a.png").when(s % 4 == 1, "").alias("image"))
    return P.run_metrics(p, state, ["s2_citation", "scholar"])


_DISCOVERED = f""", r as (select *, case when seq % 2 = 0 then 1::bigint << 52 else 0 end + seq as ord from paper where title is null or lower(trim(title)) <> 'the'),
k as (select ord as seq, title, arxiv_id, doi from r), {resolution('g', 'k')},
c as (select r.*, leader, venue in ('International Conference on Machine Learning', 'ICLR 2026 Poster', 'Nature Methods') as sure from r join g on r.ord = g.seq)
select max(seq) filter (where ord = leader) as seq, arg_min(title, ord) filter (where trim(title) <> '') as title, arg_min(arxiv_id, ord) filter (where arxiv_id is not null) as arxiv_id, arg_min(doi, ord) filter (where doi is not null) as doi,
 arg_min(year, ord) filter (where year is not null) as year, coalesce(arg_min(venue, ord) filter (where sure), arg_min(venue, ord) filter (where venue is not null)) as venue, arg_min(source, ord) as source
from c group by leader having coalesce(arg_min(year, ord) filter (where year is not null), 2022) >= 2022"""


@_query("with recursive " + _with("paper", _DISCOVERED).removeprefix("with "))
def discovery_run(spark, sf_dir):
    p, s = shape(spark, sf_dir, "paper"), F.col("seq")
    return discover([(1, p.where(s % 2 == 0)), (0, p.where(s % 2 == 1))], 2022, ["the"], DIM).select("seq", "title", "arxiv_id", "doi", "year", "venue", "source")


_MERGED = f""", o as (select *, seq % 23 = 0 as kept from paper where seq % 10 <> 9), n as (select * replace (seq + 1000000000000 as seq), seq % 23 = 0 as kept from paper where seq % 3 = 0),
k as (select seq, title, arxiv_id, doi from o union all select seq, title, arxiv_id, doi from n), {resolution('g', 'k', 'o.seq < 1000000000000')},
ups as (select n.*, leader as m from n join g using (seq) where leader <> seq),
base as (select *, false as added from o union all select n.*, true from n join g using (seq) where leader = seq),
u as (select m, arg_max(venue, seq) filter (where venue is not null) as venue, arg_min(year, seq) filter (where year > 0) as year, arg_min(doi, seq) filter (where doi is not null) as doi,
 arg_min(arxiv_id, seq) filter (where arxiv_id is not null) as arxiv_id, arg_min(abstract, seq) filter (where trim(abstract) <> '') as abstract from ups group by m)
select seq, title, case when kept then b.venue else coalesce(u.venue, b.venue) end as venue, added,
 not kept and (coalesce(u.venue, b.venue) is distinct from b.venue or coalesce(b.year, u.year) is distinct from b.year or coalesce(b.doi, u.doi) is distinct from b.doi
  or coalesce(b.arxiv_id, u.arxiv_id) is distinct from b.arxiv_id or (coalesce(trim(b.abstract), '') = '' and coalesce(u.abstract, b.abstract) is distinct from b.abstract)) as changed
from base b left join u on b.seq = u.m"""


@_query("with recursive " + _with("paper", _MERGED).removeprefix("with "))
def merged_papers(spark, sf_dir):
    old, new = (x.where(F.col("seq") % 10 != 9) if i == 0 else x.where(F.col("seq") % 3 == 0) for i, x in enumerate([_papers(spark, sf_dir)] * 2))
    shifted = new.withColumn("seq", F.col("seq") + 10**12)
    return S.merge_papers(old, shifted, DIM)[0].select("seq", "title", "venue", "changed", "added")

_ROUTES = """, o as (select *, seq % 23 = 0 as kept, seq % 5 <> 0 as done, substring(sha256(coalesce(description, '') || '::2025-01-02::False'), 1, 16) as h from repo where seq % 10 <> 0),
n as (select *, substring(sha256(coalesce(description, '') || case when seq % 7 = 0 then '::2025-01-03::False' else '::2025-01-02::False' end), 1, 16) as h from repo),
r as (select n.*, o.stars as was, case when o.seq is null then 'new' when o.kept then 'protected' when o.h <> n.h then 'reprocess' when not o.done then 'fill_gaps' else 'skip' end as route from n left join o on n.owner = o.owner and n.repo = o.repo)
"""


@_query(_with("repo", _ROUTES + """select seq, route, case when route in ('skip', 'protected') then was else stars + 1 end as stars, case route when 'fill_gaps' then 'filled' when 'skip' then 'held' when 'protected' then 'held' end as category from r"""))
def processed_repos(spark, sf_dir):
    r, s, none = shape(spark, sf_dir, "repo"), F.col("seq"), F.lit(None).cast("string")
    r = r.withColumns({"archived": F.lit(False), "last_commit": F.lit("2025-01-02")})
    hashed = lambda df: df.withColumn("content_hash", K.repo_hash(F.col("description"), F.col("last_commit"), F.col("archived")))
    old = hashed(r).where(s % 10 != 0).withColumns({"manual_override": s % 23 == 0, "has_classification": s % 5 != 0, "category": F.lit("held")})
    new = hashed(r.withColumns({"last_commit": F.when(s % 7 == 0, "2025-01-03").otherwise(F.col("last_commit")), "stars": F.col("stars") + 1})).withColumns({"has_classification": F.lit(False), "category": none})
    return D.process_repos(D.route_repos(new, old), F.lit("filled")).select("seq", "route", "stars", "category")


@_query(_with("repo", """select seq, seq % 5 = 0 and seq % 23 <> 0 and linked_paper_url is not null as cleared, case when seq % 5 <> 0 or seq % 23 = 0 then linked_paper_url end as linked_paper_url,
 case when seq % 5 <> 0 or seq % 23 = 0 then linked_paper_tier end as linked_paper_tier from repo"""))  # fmt: skip
def course_links(spark, sf_dir):
    s = F.col("seq")
    r = shape(spark, sf_dir, "repo").withColumns({"repo_type": F.when(s % 5 == 0, "course").when(s % 5 == 1, "research"), "manual_override": s % 23 == 0})
    return D.unlink_courses(r).select("seq", "cleared", "linked_paper_url", "linked_paper_tier")


@_query(_with("paper", """, h as (select k, max(seq) as seq from (select 'a' || arxiv_id as k, seq from paper where arxiv_id is not null union all select 'd' || doi, seq from paper where doi is not null) group by 1),
n as (select coalesce('a' || arxiv_id, 'd' || doi) as k, min(seq) as m from paper where seq % 2 = 0 and (arxiv_id is not null or doi is not null) group by 1),
u as (select h.seq, min(m) as m from h join n using (k) group by 1)
select p.seq, p.venue as old_venue, 'ICML ' || cast(m as varchar) as venue from u join paper p on p.seq = u.seq where p.venue is null or p.seq % 6 in (0, 2, 3, 5)"""))  # fmt: skip
def venue_upgrade_rows(spark, sf_dir):
    p, s = shape(spark, sf_dir, "paper"), F.col("seq")
    new = p.where(s % 2 == 0).withColumn("venue", F.concat(F.lit("ICML "), s))
    return D.venue_upgrades(new, p, DIM).select("seq", "old_venue", "venue")


_IDS = """select '2407.00003v2' as id union all select 'https://arxiv.org/abs/2407.00006' union all select '10.18653/v1/2025.acl-long.10' union all select 'https://x.org/7' union all select '10.1/none' union all select 'http://x.org/none'"""


@_query(_with("paper", f""", i as ({_IDS}), k as (select id, case id when '2407.00003v2' then '2407.00003' when 'https://arxiv.org/abs/2407.00006' then '2407.00006' end as a from i)
select id, seq from k left join paper on arxiv_id = a or doi = id or 'https://x.org/' || cast(seq as varchar) = id"""))  # fmt: skip
def found_ids(spark, sf_dir):
    p = shape(spark, sf_dir, "paper").withColumn("url", F.concat(F.lit("https://x.org/"), F.col("seq")))
    ids = spark.sql(_IDS)
    return D.find(p, ids).unionByName(D.missing_ids(p, ids), allowMissingColumns=True)


@_query("""
select doc_id, case when gone then 'discarded' else 'pending' end as bucket, case when gone then 'zero_pdf_hits' end as reason, case when gone then 'Extracted ' || cast(length(text) as varchar) || ' chars; 0 matches for any of [stupid, license].' end as reason_detail
from (select *, coalesce(length(text) >= 1000 and not contains(lower(text), 'stupid') and not contains(lower(text), 'license'), false) as gone from documents)""")  # fmt: skip
def zero_hit_discards(spark, sf_dir):
    none = F.lit(None).cast("string")
    d = table(spark, sf_dir, "documents").withColumns({"bucket": F.lit("pending"), "reason": none, "reason_detail": none})
    return D.discard_zero_hits(d, ["stupid", "license"]).select("doc_id", "bucket", "reason", "reason_detail")


_EVIDENCE = """case doc_id % 6 when 0 then 'We used GridTool to run all. ' when 1 then 'We removed gridtool. ' when 5 then 'We thank gridtool for help. ' else '' end || case when doc_id % 6 = 4 then '' else coalesce(text, '') end"""


@_query("""
select doc_id, case doc_id % 6 when 0 then 'uses' when 1 then 'referencing' when 2 then 'other' when 5 then 'referencing' else 'unclassified' end as category,
 case doc_id % 6 when 0 then 'low' when 1 then 'certain' when 2 then 'low' when 5 then 'medium' else 'none' end as band,
 case doc_id % 6 when 3 then 'no_keywords_anywhere' when 4 then 'no_evidence_extractable' end as unclassified_reason, cast(case when doc_id % 6 in (0, 2) then 1 else 0 end as int) as windows from documents""")  # fmt: skip
def evidence_classes(spark, sf_dir):
    i = F.col("doc_id")
    abstract = F.when(i % 6 == 2, "Mentions GRIDTOOL only").when(i % 6 == 3, "nothing of it")
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_EVIDENCE).alias("text"), abstract.alias("abstract"), F.lit(None).cast("int").alias("linked_paper_tier"))
    out = D.classify(d, ["gridtool"], "(?i:gridtool)", lambda t: E.first_label(t, [("uses", ["used gridtool"])], "other"))
    return out.select("doc_id", "category", "band", "unclassified_reason", "windows")


_FIGURES = """'Figure in the intro' || chr(10) || 'figure ' || cast(1 + doc_id % 4 as string) || ': attention  ' || chr(10) || 'as Figure 9: said' || chr(10) || case when doc_id % 2 = 0 then 'Fig. ' || cast(doc_id % 7 as string) || ' a pipeline' || chr(10) else '' end || coalesce(text, '')"""


@_query(f"""
with c as (select doc_id, unnest(regexp_extract_all({_FIGURES}, '{D.CAPTION}', 1)) as c from documents)
select doc_id, cast(regexp_extract(c, '{D.CAPTION_NUMBER}', 1) as int) as figure_num, regexp_replace(c, '^\\s+|\\s+$', '', 'g') as caption from c""")  # fmt: skip
def figure_captions(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_num"), F.expr(_FIGURES).alias("text"))
    return D.captions(pages, "doc_id").select("doc_id", "figure_num", "caption")



def _uses(evidence):
    return E.first_label(evidence, [("uses_library", ["ing"])], "referencing")


#: Settings of the full run over the given tables.
RUN = {"least_year": 2022, "excluded": ["the"], "excluded_repos": ["owner3/Customer#000000008"], "keywords": ["ation"], "tool": "ation", "label": _uses, "as_of": "2025-06-01", "course_parents": ["course-org/exercises"], "course_words": ["machinery"], "categories": ["uses_library", "referencing"]}


def _stages(spark: SparkSession) -> Stages:
    return Stages(spark, f"{shared_dir(spark)}/runs/{uuid.uuid4().hex}")


def _run_repos(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(discovered, old) repos; a third of the old ones have changed since."""
    s, none = F.col("seq"), F.lit(None).cast("string")
    r = shape(spark, sf_dir, "repo").withColumns({"key": F.concat_ws("/", "owner", "repo"), "archived": F.lit(False), "last_commit": F.lit("2025-01-02"), "url": F.concat_ws("/", "owner", "repo"), "category": F.lit("uses_library"), "manual_override": s % 23 == 0, "repo_type": none, "first_seen": F.to_date(F.lit("2025-01-01")), "last_seen": F.date_add(F.to_date(F.lit("2025-05-20")), (s % 60 - 30).cast("int")), "has_classification": F.lit(True)})
    r = r.withColumn("content_hash", K.repo_hash(F.col("description"), F.col("last_commit"), F.col("archived")))
    return r.where(s % 3 != 0), r.where(s % 10 != 0).withColumn("content_hash", F.when(s % 3 == 1, "changed").otherwise(F.col("content_hash")))


@_query(None)
def full_run(spark, sf_dir):
    s, none = F.col("seq"), F.lit(None).cast("string")
    state = _papers(spark, sf_dir).withColumns({"content_hash": K.paper_hash(F.col("title"), F.col("abstract")), "linked_paper_tier": none.cast("int")})
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")
    landed = state.drop("bucket", "reason", "manual_override", "category", "has_classification")
    repos, old = _run_repos(spark, sf_dir)
    return run(_stages(spark), [(0, landed.where(s % 3 == 0)), (1, landed.where(s % 3 == 1))], state.where(s % 2 == 0), texts, repos, old, DIM, RUN)["buckets"]


@_query(_with("repo", """, r as (select *, owner || '/' || repo as key, seq % 23 = 0 as kept from repo), n as (select * from r where seq % 3 <> 0 and key <> 'owner3/Customer#000000008'), o as (select * from r where seq % 10 <> 0),
b as (select * from o where key not in (select key from n) union all select * from n),
u as (select b.*, count(linked_paper_url) over (partition by linked_paper_url) >= 5 and linked_paper_url is not null and row_number() over (partition by linked_paper_url order by coalesce(stars, 0) desc, seq) > 1 as unlinked from b),
t as (select * replace (case when not unlinked then linked_paper_url end as linked_paper_url, case when not unlinked then linked_paper_tier end as linked_paper_tier) from u),
k as (select *, case when kept then null when parent_full_name = 'course-org/exercises' or (unlinked and coalesce(stars, 0) = 0 and description is null) or contains(lower(repo || ' ' || coalesce(description, '')), 'machinery') then 'course'
  when linked_paper_url is not null or (coalesce(stars, 0) >= 6 and description is not null) then 'research' else 'experiment' end as repo_type from t),
c as (select * replace (case when repo_type = 'course' and not kept then null else linked_paper_url end as linked_paper_url, case when repo_type = 'course' and not kept then null else linked_paper_tier end as linked_paper_tier) from k where key in (select key from n)),
p as (select c.key, case when o.key is null then 'new' when o.kept then 'protected' when o.seq % 3 = 1 then 'reprocess' else 'skip' end as route, o.key is not null as known, o.kept as was_kept,
  c.linked_paper_url as url, c.linked_paper_tier as tier, c.repo_type, o.linked_paper_url as old_url, o.linked_paper_tier as old_tier from c left join o using (key)),
m as (select key, case when route in ('skip', 'protected') or was_kept then old_url else url end as linked_paper_url, case when route in ('skip', 'protected') or was_kept then old_tier else tier end as linked_paper_tier,
  case when route in ('skip', 'protected') or was_kept then null else repo_type end as repo_type, date '2025-06-01' as last_seen from p)
select * from m union all
select key, linked_paper_url, linked_paper_tier, null, date '2025-05-20' + cast(seq % 60 - 30 as int) from o where key not in (select key from m) and (kept or date '2025-06-01' - (date '2025-05-20' + cast(seq % 60 - 30 as int)) <= 30)"""))  # fmt: skip
def full_run_repos(spark, sf_dir):
    return run_repos(_stages(spark), *_run_repos(spark, sf_dir), RUN).select("key", "linked_paper_url", "linked_paper_tier", "repo_type", "last_seen")


@_query(_with("paper", """select bucket, part, name, count(*) as n from (
 select bucket, unnest([('all', 'all'), case when bucket = 'verified' then case when category in ('a', 'b') then ('category', category) end else ('reason', coalesce(reason, 'unknown')) end]) as x, x[1] as part, x[2] as name
 from (select case seq % 3 when 0 then 'verified' when 1 then 'pending' else 'discarded' end as bucket, case seq % 4 when 0 then 'a' when 1 then 'b' else 'c' end as category, case when seq % 5 = 0 then null else source end as reason from paper)) where x is not null group by all"""))  # fmt: skip
def bucket_report(spark, sf_dir):
    s = F.col("seq")
    p = shape(spark, sf_dir, "paper").withColumns({"bucket": F.when(s % 3 == 0, "verified").when(s % 3 == 1, "pending").otherwise("discarded"), "category": F.when(s % 4 == 0, "a").when(s % 4 == 1, "b").otherwise("c"), "reason": F.when(s % 5 != 0, F.col("source"))})
    return P.bucket_report(p, ["a", "b"])


@_query(_with("repo", """, m as (select seq, case when seq % 7 = 0 then 404 when seq % 7 = 1 then 403 else 200 end as status, seq % 11 = 0 as renamed, seq % 13 = 0 as archived, description from repo where seq % 2 = 0),
v as (select r.seq, r.description as was, case when status = 404 then '404' when status = 200 and renamed then 'rename_redirect' when status = 200 and m.archived then 'archived' end as removed,
 case when status = 200 then seq * 3 end as forks, case when status = 200 and seq % 3 = 0 then 'MIT' when status = 200 and seq % 3 = 1 then 'Own terms' end as license from repo r left join m using (seq))
select 'removed' as part, coalesce(removed, 'none') as name, count(*) as n from v group by all union all select 'forks', cast(coalesce(forks, -1) % 10 as varchar), count(*) from v group by all union all select 'license', coalesce(license, 'unknown'), count(*) from v group by all"""))  # fmt: skip
def repo_snapshots(spark, sf_dir):
    s = F.col("seq")
    r = shape(spark, sf_dir, "repo").withColumn("key", F.concat_ws("/", "owner", "repo"))
    license_ = F.when(s % 3 == 0, F.struct(F.lit("MIT").alias("spdx_id"), F.lit("x").alias("name"))).when(s % 3 == 1, F.struct(F.lit(None).cast("string").alias("spdx_id"), F.lit("Own terms").alias("name")))
    snap = r.where(s % 2 == 0).select("key", F.when(s % 7 == 0, 404).when(s % 7 == 1, 403).otherwise(200).alias("status"), F.when(s % 11 == 0, "other/name").otherwise(F.upper("key")).alias("full_name"), (s % 13 == 0).alias("archived"), (s * 3).alias("forks_count"), license_.alias("license"))
    out = L.apply_repo_snapshot(r, snap)
    named = out.select(F.coalesce("removed", F.lit("none")).alias("removed"), (F.coalesce("forks", F.lit(-1)) % 10).alias("forks"), "license")
    return P.repo_report(named, None, ("removed", "forks", "license")).where("part <> 'all'")


@_query("""select doc_id, case when a and not b then 'library prompt' when b and not a then 'infrastructure prompt' else 'unified prompt' end || case doc_id % 4 when 1 then ' [1 entry]' when 2 then ' [2 section]' else '' end as prompt,
 case doc_id % 5 when 0 then 'uses' when 1 then 'referencing' when 4 then null else 'unclassified' end as category, case doc_id % 5 when 2 then 'llm_returned_unclassified' when 3 then 'llm_unparseable' end as why
from (select doc_id, contains(lower(text), 'ation') as a, contains(lower(text), 'stupid') or contains(lower(text), 'licen') as b from documents where text is not null)""")
def prompts_and_replies(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents").where("text is not null"), F.col("doc_id")
    family = E.prompt_family(F.col("text"), ["ation"], ["stupid", "licen"])
    prompts = {x: f"{x} prompt" for x in ("library", "infrastructure", "unified")}
    prompt = E.build_prompt(family, prompts, i % 4, {1: "entry", 2: "section"}, " [{tier} {descriptor}]")
    reply = F.when(i % 5 == 0, "It USES the tool").when(i % 5 == 1, " referencing ").when(i % 5 == 2, "unclassified").when(i % 5 == 3, "no idea")
    label = E.parse_label(reply, ["uses", "referencing"])
    return d.select("doc_id", prompt.alias("prompt"), label["category"].alias("category"), label["reason"].alias("why"))


@_query("""with k as (select doc_id, text, lower(text) as low, (length(text) - length(replace(lower(text), 'ation', ''))) // 5 as n, strpos(lower(text), 'ation') - 1 as p from documents)
select doc_id, cast(least(n, 5) as int) as windows, p as first_pos, substring(text, greatest(p - 500, 0) + 1, least(p, 500) + 505) as first_text from k where n > 0""")
def keyword_windows(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", E.keyword_windows(F.col("text"), ["ation"]).alias("w")).where(F.size("w") > 0)
    return w.select("doc_id", F.size("w").alias("windows"), F.col("w")[0]["pos"].cast("long").alias("first_pos"), F.col("w")[0]["text"].alias("first_text"))


@_query("""select doc_id, regexp_matches(text, 'ation') as plain, regexp_matches(replace(replace(text, 'tation ', ''), 'nation ', ''), 'ation') as own from documents where text is not null""")
def usage_classes(spark, sf_dir):
    t = F.col("text")
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", E.usage_class(t, "ation").alias("plain"), E.usage_class(F.regexp_replace(F.regexp_replace(t, "(?i)TATION ", "tation "), "(?i)NATION ", "nation "), "ation", [("t", " "), ("n", " ")]).alias("own"))


@_query(_with("paper", """select seq, '@article{' || 'bee' || coalesce(cast(year as varchar), '') || lower(regexp_replace(regexp_extract(title, '^(\\S*)', 1), '[^A-Za-z0-9]', '', 'g')) || ',' || chr(10) || '  title = {' || trim(title) || '},' || chr(10) || '  author = {Ann Bee, Cy Dow},' || chr(10)
 || case when year is null then '' else '  year = {' || year || '},' || chr(10) end || case when venue is null then '' else '  journal = {' || venue || '},' || chr(10) end || case when arxiv_id is null then '' else '  eprint = {' || arxiv_id || '},' || chr(10) end || case when doi is null then '' else '  doi = {' || doi || '},' || chr(10) end || '}' as bibtex,
 case when seq % 4 = 0 then 'certain' when seq % 10 / 10.0 >= 0.95 then 'certain' when seq % 10 / 10.0 >= 0.7 then 'high' when seq % 10 / 10.0 >= 0.5 then 'medium' when seq % 10 > 0 then 'low' else 'none' end as band from paper where coalesce(title, '') <> ''"""))  # fmt: skip
def entry_texts(spark, sf_dir):
    p, s, none = shape(spark, sf_dir, "paper"), F.col("seq"), F.lit(None).cast("string")
    p = p.where("coalesce(title, '') <> ''")
    band = K.band_from_score((s % 10) / 10.0, s % 4 == 0)
    return p.select("seq", K.bibtex(F.col("title"), F.lit("Ann Bee, Cy Dow"), F.col("year"), F.col("venue"), none, F.col("arxiv_id"), F.col("doi")).alias("bibtex"), band.alias("band"))


@_query("""select 'cited ' || doc_id as title, case when doc_id % 3 = 0 then '2407.' || lpad(cast(doc_id % 400 as varchar), 5, '0') when doc_id % 3 = 1 then '2301.00001' end as arxiv_id, 'A, B' as authors,
 case when doc_id % 2 = 0 then 'ICML' else 'raw venue' end as venue, 2024 as year, case when doc_id % 5 = 0 then 'https://x.org/a.pdf' end as pdf_url from documents where doc_id % 7 <> 0""")
def cited_records(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").selectExpr("case when doc_id % 7 = 0 then '' else concat('cited ', doc_id) end as title", "concat('P', doc_id) as paperId",
        "case when doc_id % 3 = 0 then map('ArXiv', concat('2407.', lpad(cast(doc_id % 400 as string), 5, '0'))) when doc_id % 3 = 1 then map('DOI', '10.48550/arXiv.2301.00001') else map('DOI', '10.1/x') end as externalIds",
        "array(named_struct('name', 'A'), named_struct('name', 'B')) as authors", "'raw venue' as venue", "case when doc_id % 2 = 0 then named_struct('name', 'ICML') end as publicationVenue", "'2024-05-06' as publicationDate",
        "named_struct('url', case when doc_id % 5 = 0 then 'https://x.org/a.pdf' else 'https://doi.org/10.1/x' end) as openAccessPdf", "text as abstract", "'u' as url")
    return L.citations_to_papers(raw).select("title", "arxiv_id", "authors", "venue", "year", "pdf_url")


@_query("""select 'hit ' || doc_id as title, case doc_id % 3 when 0 then '2401.00002' when 1 then '2402.00003' end as arxiv_id, 'A One, B Two' as authors, case when doc_id % 2 = 0 then 2023 end as year, case when doc_id % 2 = 0 then 'Journal of Parts' else 'Only a venue' end as venue from documents""")
def search_records(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").selectExpr("concat('hit ', doc_id) as title", "case when doc_id % 3 = 0 then 'https://arxiv.org/abs/2401.00002' else 'https://x.org/p' end as link", "case when doc_id % 3 = 1 then 'see 2402.00003 here' else 'nothing' end as snippet", "named_struct('summary', concat('A One, B Two - ', case when doc_id % 2 = 0 then 'Journal of Parts, 2023' else 'Only a venue' end, ' - host.org')) as publication_info")
    return L.search_results_to_papers(raw).select("title", "arxiv_id", "authors", "year", "venue")


@_query(_STATE + """select seq, title, bucket from (select *, seq % 3 as k from de) where bucket = 'pending' and k <> 0 and coalesce(trim(title), '') <> ''""")
def state_round_trip(spark, sf_dir):
    p = _papers(spark, sf_dir)
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    S.write_state(p, path)
    # The second write leaves out whole buckets and reads what it replaces.
    S.write_state(S.read_state(spark, path).where("bucket = 'pending' and seq % 3 <> 0"), path)
    return S.read_state(spark, path).select("seq", "title", "bucket")


@_query(_with("paper", """select title, authors, venue, year, url, description, category, case when seq % 4 = 0 then 'a.png' end as image, case when seq % 5 = 0 then 'o/r' end as project_url
 from (select seq, title, cast(null as varchar) as authors, venue, year, cast(null as varchar) as url, cast(null as varchar) as description, 'referencing' as category from paper where seq % 2 = 1)"""))
def public_paper_rows(spark, sf_dir):
    s = F.col("seq")
    return P.public_papers(_papers(spark, sf_dir).withColumns({"image": F.when(s % 4 == 0, "a.png").otherwise(""), "project_url": F.when(s % 5 == 0, "o/r")}))


@_query(_with("repo", "select seq, stars, owner, repo from repo order by stars desc nulls last, lower(owner), lower(repo)"))
def repo_listing(spark, sf_dir):
    return P.repo_listing(shape(spark, sf_dir, "repo")).select("seq", "stars", "owner", "repo")


@_query(_with("paper", """, f as (select distinct regexp_replace(trim(regexp_replace(title, '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s-]', '', 'g')), '\\s+', '-', 'g') || '.png' as name from paper where seq % 4 = 0)
select seq, case when name is not null then '/images/' || name end as image, name is null as missing from (select seq, regexp_replace(trim(regexp_replace(title, '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s-]', '', 'g')), '\\s+', '-', 'g') || '.png' as want from paper) left join f on want = name"""))  # fmt: skip
def reconciled_images(spark, sf_dir):
    p = shape(spark, sf_dir, "paper")
    files = p.where("seq % 4 = 0").select(F.concat(K.slug(F.col("title")), F.lit(".png")).alias("name"))
    return P.reconcile_files(p.select("seq", "title"), files).select("seq", "image", "missing")


def queries() -> dict:
    return {name: f for name, (f, _) in _CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _CASES.items() if sql}
