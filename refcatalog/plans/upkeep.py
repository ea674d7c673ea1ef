"""Registered queries of readers, ingestion, labels and enrichment, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import affiliations as A
from ..functions import evidence as E
from ..functions import keys as K
from ..operators import decisions as D
from ..operators import enrich as N
from ..operators import entities as M
from ..operators import reports as P
from ..operators import state as S
from ..sources import landed as L
from ..streaming import ingest
from .catalogue import DIM, NORMAL, NORMAL_NAME, _with, shape
from .resolution_sql import similar
from .tables import shared_dir, table

_CASES: dict[str, tuple] = {}


def _query(sql: str | None):
    def register(f):
        _CASES[f.__name__] = (f, sql)
        return f

    return register


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@_query(_with("repo", "select seq, owner, repo from repo where lower(owner || '/' || repo) not in ('owner3/customer#000000008', 'owner1/customer#000000003', 'owner20/customer#000000100')"))
def excluded_repo_rows(spark, sf_dir):
    r = shape(spark, sf_dir, "repo").withColumn("key", F.concat_ws("/", "owner", "repo"))
    return M.exclude(r, "key", ["owner3/Customer#000000008", " Owner1/Customer#000000003", "owner20/Customer#000000100"]).select("seq", "owner", "repo")


@_query(_with("paper", """select seq, band, category from (select seq, case seq % 5 when 0 then 'certain' when 1 then 'high' when 2 then 'medium' when 3 then 'low' else 'none' end as band, case when seq % 7 = 0 then 'unclassified' when seq % 11 <> 0 then 'referencing' end as category from paper)
where band in ('low', 'medium') and category <> 'unclassified'"""))  # fmt: skip
def low_confidence_papers(spark, sf_dir):
    s = F.col("seq")
    band = F.when(s % 5 == 0, "certain").when(s % 5 == 1, "high").when(s % 5 == 2, "medium").when(s % 5 == 3, "low").otherwise("none")
    p = shape(spark, sf_dir, "paper").withColumns({"category_confidence_band": band, "category": F.when(s % 7 == 0, "unclassified").when(s % 11 != 0, "referencing")})
    return P.low_confidence(p).select("seq", F.col("category_confidence_band").alias("band"), "category")


_BEST = f""", l as (select * from paper where seq % 2 = 0), cand as (select seq, title, case when seq % 5 = 1 then 'Submitted to ICLR' else venue end as venue from paper where seq % 2 = 1),
tt as (select seq as k, lower(trim(title)) as t from l union all select seq, lower(trim(title)) from cand), {similar('s', 'tt')},
oc as (select lower(trim(title)) as t, min(seq) as o from cand where trim(title) <> '' group by 1), cls as (select s_c.k, s_c.t, oc.o from s_c left join oc using (t)),
near as (select a as k, b as other, score from s union all select b, a, score from s union all select k, k, 100.0 from s_c),
best as (select near.k, arg_min(x.o, (-near.score, x.o)) as o from near join cls x on near.other = x.k where x.o is not null group by near.k),
hit as (select l.seq, cand.venue from l join cls on cls.t = lower(trim(l.title)) join best using (k) join cand on cand.seq = best.o where trim(cand.venue) <> '' and not contains(lower(cand.venue), 'submitted'))
"""


@_query(_with("paper", _BEST + "select seq, venue from hit"))
def best_title_venues(spark, sf_dir):
    p, s = shape(spark, sf_dir, "paper"), F.col("seq")
    candidates = p.where(s % 2 == 1).select("seq", "title", F.when(s % 5 == 1, "Submitted to ICLR").otherwise(F.col("venue")).alias("venue"))
    return N.best_match(p.where(s % 2 == 0).select("seq", "title"), candidates)


@_query(_with("paper", _BEST + f""", offered as (select seq, year, 1 as nth, 'existing' as source, case when seq % 3 = 0 then venue end as venue from l union all select l.seq, year, 2, 'title_search', hit.venue from l join hit using (seq)),
named as (select * from offered where trim(venue) <> '')
""" + NORMAL + f""", normal as (select seq, nth, source, {NORMAL_NAME} as name from j),
win as (select seq, arg_min(name, nth) as name, arg_min(source, nth) as source from normal where name <> '' and regexp_matches(name, '(?i)\\b(ICML|ICLR)\\b|nature methods') group by seq)
select l.seq, coalesce(name, trim('ArXiv ' || coalesce(cast(year as varchar), ''))) as venue, coalesce(win.source, 'fallback') as venue_source from l left join win using (seq)"""))  # fmt: skip
def title_search_venues(spark, sf_dir):
    p, s, none = shape(spark, sf_dir, "paper"), F.col("seq"), F.lit(None).cast("string")
    papers = p.where(s % 2 == 0).withColumns({"arxiv_id": none, "doi": none, "openalex_id": none, "venue": F.when(s % 3 == 0, F.col("venue")), "signals": F.lit(None).cast("map<string,string>")})
    candidates = p.where(s % 2 == 1).select("seq", "title", F.when(s % 5 == 1, "Submitted to ICLR").otherwise(F.col("venue")).alias("venue"))
    return N.resolve_venue(N.search_titles(papers, candidates), DIM, F.col("title_search")).select("seq", "venue", "venue_source")


@_query(_with("paper", """, reg as (select distinct doi as k from paper where doi is not null and seq % 2 = 0), feed as (select distinct arxiv_id as k from paper where arxiv_id is not null and seq % 2 = 1),
cit as (select distinct arxiv_id as k from paper where arxiv_id is not null and seq % 4 = 0), rev as (select distinct lower(trim(title)) as k from paper where seq % 5 = 0 and lower(trim(title)) <> ''),
wrk as (select distinct lower(substring(trim(title), 1, 100)) as k from paper where seq % 7 = 0 and trim(title) <> ''),
v as (select paper.*, reg.k is not null as known, wrk.k is not null as worked,
  case when doi is not null then ['ACL 2025', 'doi_prefix'] when feed.k is not null then ['ICML 2024', 'arxiv_comment_parsed'] when venue is null and cit.k is not null then ['ICML' || coalesce(' ' || year, ''), 's2'] when venue is null and rev.k is not null then ['ICLR 2025', 'openreview']
   when venue like 'International%' then ['ICML' || coalesce(' ' || year, ''), 'existing'] when venue like 'ICLR%' then ['ICLR 2026', 'existing'] when venue like 'Nature%' then ['Nature Methods' || coalesce(' ' || year, ''), 'existing'] else ['ArXiv' || coalesce(' ' || year, ''), 'fallback'] end as x
 from paper left join reg on doi = reg.k left join feed on arxiv_id = feed.k left join cit on arxiv_id = cit.k left join rev on lower(trim(title)) = rev.k left join wrk on lower(substring(trim(title), 1, 100)) = wrk.k)
select seq, x[1] as venue, x[2] as venue_source, case x[2] when 'doi_prefix' then 2025 when 'arxiv_comment_parsed' then 2024 else year end as year, case when known then 'First Lab' when worked then 'Works Lab' end as affiliations,
 case when x[1] like 'ICML%' or x[1] like 'ICLR%' then 'conference' when x[1] like 'Nature%' then 'journal' else 'preprint' end as venue_type, x[1] like 'IC%' or x[1] like 'Nature%' as peer_reviewed from v"""))  # fmt: skip
def enriched_papers(spark, sf_dir):
    p, s, none = shape(spark, sf_dir, "paper"), F.col("seq"), F.lit(None).cast("string")
    papers = p.withColumns({c: none for c in ("affiliations", "authors", "openalex_id", "url", "bibtex")})
    registry = p.where(s % 2 == 0).select("doi", F.lit("ACL").alias("venue"), F.lit("First Lab").alias("affiliations"))
    citations = p.where(s % 4 == 0).select("arxiv_id", "doi", F.lit("ICML").alias("venue"))
    reviews = p.where(s % 5 == 0).select("title", F.lit("ICLR 2025").alias("venue"))
    feed = p.where(s % 2 == 1).select("arxiv_id", none.alias("authors"), none.alias("affiliations"), none.alias("journal_ref"), F.lit("Accepted at ICML 2024").alias("comment"))
    works = p.where(s % 7 == 0).select(none.alias("arxiv_id"), none.alias("doi"), "title", none.alias("openalex_id"), F.lit("Works Lab").alias("affiliations"))
    return N.enrich(papers, registry, citations, reviews, feed, works, DIM).select("seq", "venue", "venue_source", "year", "affiliations", "venue_type", "peer_reviewed")


@_query("""select '2407.' || lpad(cast(doc_id % 100000 as varchar), 5, '0') as arxiv_id, case when doc_id % 3 = 0 then 'Ann Bee' else 'Ann Bee, ' || source end as authors, case when doc_id % 3 <> 0 then 'Lab ' || lang else '' end as affiliations, 'cs.' || upper(lang) as category,
 case when doc_id % 4 = 0 then 'Journal ' || n_chars end as journal_ref, case when doc_id % 4 = 1 then 'Accepted at ICML 2024 & more' end as comment from documents where doc_id % 10 <> 0""")  # fmt: skip
def feed_entries(spark, sf_dir):
    d, at = table(spark, sf_dir, "documents"), _folder(spark, "feed")
    tag = lambda t, *x: F.concat(F.lit(f"<{t}>"), *(F.lit(y) if isinstance(y, str) else y for y in x), F.lit(f"</{t.split()[0]}>"))
    i, second = F.col("doc_id"), F.col("doc_id") % 3 != 0
    entry = tag("entry", F.when(i % 10 == 0, F.lit("<id/>")).otherwise(tag("id", "http://arxiv.org/abs/2407.", F.lpad((i % 100_000).cast("string"), 5, "0"), "v1")), tag("author", tag("name", " Ann Bee ")), F.when(second, tag("author", tag("name", F.col("source")), tag("arxiv:affiliation", "Lab ", F.col("lang")))).otherwise(""), F.lit('<category term="cs.'), F.upper("lang"), F.lit('"/>'),
        F.when(i % 4 == 0, tag("arxiv:journal_ref", "Journal ", F.col("n_chars").cast("string"))).when(i % 4 == 1, tag("arxiv:comment", "Accepted at ICML 2024 &amp; more")).otherwise(""))
    d.select(entry.alias("value")).write.text(at)
    papers, _ = L.read_feed(spark, at)
    return papers.select("arxiv_id", "authors", "affiliations", F.array_join("categories", ",").alias("category"), "journal_ref", "comment")


@_query("""select '10.1/' || doc_id as doi, case when doc_id % 3 = 0 then 'Meeting of ' || source else 'Journal of ' || source end as venue, 'P' as publisher, case when doc_id % 2 = 0 then 'Lab A, Lab ' || upper(lang) end as affiliations, case when doc_id % 5 = 0 then 'https://x.org/' || doc_id || '.pdf' end as pdf_url
from documents where doc_id % 7 <> 0""")  # fmt: skip
def registry_records(spark, sf_dir):
    i, none = F.col("doc_id"), F.lit(None)
    names = F.array(*(F.struct(x.alias("name")) for x in (F.concat(F.lit("Lab "), F.upper("lang")), F.lit("Lab A"), F.lit("Lab A"), F.lit(" "))))
    link = lambda url, kind: F.struct(url.alias("URL"), F.lit(kind).alias("content-type"))
    message = F.struct(F.concat(F.lit("10.1/"), i).alias("DOI"), F.when(i % 3 != 0, F.array(F.concat(F.lit("Journal of "), "source"))).alias("container-title"), F.struct(F.concat(F.lit("Meeting of "), "source").alias("name")).alias("event"), F.lit("P").alias("publisher"), F.lit("t").alias("type"),
        F.when(i % 2 == 0, F.array(F.struct(names.alias("affiliation")))).alias("author"), F.array(link(F.lit("h"), "text/html"), link(F.concat(F.lit("https://x.org/"), i, F.lit(".pdf")), "application/pdf")).alias("link"))
    message = message.withField("link", F.when(i % 5 == 0, message["link"]).otherwise(F.slice(message["link"], 1, 1)))
    raw = table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.when(i % 7 != 0, message).otherwise(none).alias("message"))).alias("body"))
    return L.registry_to_signals(raw).select("doi", "venue", "publisher", "affiliations", "pdf_url")


@_query("""with n as (select source, cast(count(*) as int) as n, min(lang) as lang from documents group by source)
select source as canonical, case when n % 2 = 0 then 'conference' else 'journal' end as type, case when n % 3 = 0 then lang end as parent, unnest(case when n % 5 = 4 then [null] else ['Meeting ' || source, 'Notes ' || lang] end) as alias from n""")  # fmt: skip
def venue_dimension(spark, sf_dir):
    n = F.col("n")
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("lang").alias("lang"))
    venue = F.struct(F.when(n % 2 == 0, "conference").otherwise("journal").alias("type"), F.when(n % 3 == 0, F.col("lang")).alias("parent"), F.when(n % 5 == 4, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Meeting "), "source"), F.concat(F.lit("Notes "), "lang"))).alias("aliases"))
    at = _folder(spark, "venues")
    # One document of a row for each source of the table.
    rows.groupBy().agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("source", venue))).alias("venues"))).alias("value")).write.text(at)
    return L.load_venues(spark, at).select("canonical", "type", "parent", "alias")


@_query(_with("repo", "select seq, owner, repo, stars from repo where seq % 6 <> 0 and seq % 10 <> 0"))
def repo_state_round_trip(spark, sf_dir):
    s, at = F.col("seq"), _folder(spark, "repos")
    r = shape(spark, sf_dir, "repo").withColumns({"owner": F.when(s % 10 != 0, F.col("owner")), "repo": F.when(s % 6 != 0, F.col("repo")).otherwise(" ")})
    first = S.write_repo_state(r.where("seq % 2 = 0"), at)
    S.write_repo_state(r, at, first)
    return S.read_repo_state(spark, at).select("seq", "owner", "repo", "stars")


@_query("""select doc_id as seq, case doc_id % 10 when 3 then 'not of the declared form' when 4 then 'not of the declared form' when 5 then 'no title' when 6 then 'no title' end as reason,
 case when doc_id % 10 not in (3, 4, 5, 6) then text end as title, case when doc_id % 10 not in (3, 4, 5, 6) then cast(n_chars as int) end as year from documents where text is not null and trim(text) <> ''""")  # fmt: skip
def checked_items(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").where("text is not null and trim(text) <> ''")
    whole = F.to_json(F.struct(F.when(i % 10 == 6, " ").when(i % 10 != 5, F.col("text")).alias("title"), F.when(i % 10 == 3, F.lit("soon")).otherwise(F.col("n_chars").cast("string")).alias("year")))
    item = F.when(i % 10 == 4, F.concat(F.lit("{"), whole)).when(i % 10 == 3, whole).otherwise(F.regexp_replace(whole, r'"year":"(\d+)"', '"year":$1'))
    rows, rejects = S.checked(d.select(i.alias("seq"), item.alias("item")), StructType.fromDDL("title string, year int"), ["title"])
    none = F.lit(None).cast("string")
    return rows.select("seq", none.alias("reason"), "title", "year").unionByName(rejects.select("seq", "reason", none.alias("title"), none.cast("int").alias("year")))


@_query("""with p as (select 'list ' || page_id // 7 as listing, cast(page_id % 7 as int) as page, page_id, url, page_id // 7 as k from pages where page_id % 35 <> 3),
done as (select listing from p group by listing having count(*) = max(page) + 1 and max(page) = 6)
select listing, page, cast(unnest([0, 1]) as int) as place, unnest(['page ' || page_id, 'again']) as name, url from p join done using (listing)""")  # fmt: skip
def ingested_listings(spark, sf_dir):
    """Listings of seven pages, of which every fifth lacks one, as they come in through the stream."""
    i, at = F.col("page_id"), _folder(spark, "listings")
    item = lambda name: F.struct(name.alias("name"), F.col("url").alias("url"))
    pages = table(spark, sf_dir, "pages").where("page_id % 35 <> 3").select(F.concat(F.lit("list "), F.expr("page_id div 7")).alias("listing"), (i % 7).cast("int").alias("page"), F.when(i % 7 != 6, "more").alias("next_url"), F.array(item(F.concat(F.lit("page "), i)), item(F.lit("again"))).alias("items"))
    pages.repartition(6).write.option("ignoreNullFields", False).json(f"{at}/in")
    ingest.ingest_pages(spark, f"{at}/in", f"{at}/out", f"{at}/known", files=4)
    return ingest.listings(spark, f"{at}/out").select("listing", "page", "place", "name", "url")


def _answer(prompts: list[str]) -> list[str | None]:
    """A labeller as a caller would bring one: it fails on some prompts and has no reply to others."""
    if any("[fail]" in p for p in prompts):
        raise RuntimeError("no service")
    return [None if "[none]" in p else "It uses it." if "ation" in p.lower() else "referencing" for p in prompts]


@_query("""select doc_id as seq, case when doc_id % 9 = 0 then null when doc_id % 50 = 1 then 'rule' when doc_id % 11 = 2 then 'rule' when contains(lower(text), 'ation') then 'uses' else 'referencing' end as category,
 case when doc_id % 9 = 0 then null when doc_id % 50 = 1 or doc_id % 11 = 2 then 'keyword_fallback' else 'llm' end as signal, doc_id % 9 <> 0 and doc_id % 50 = 1 as failed from documents where text is not null""")  # fmt: skip
def labelled_prompts(spark, sf_dir):
    """Labels of whole texts, asked for in two runs: the second one finds the first one's replies."""
    i, at = F.col("doc_id"), _folder(spark, "replies")
    d = table(spark, sf_dir, "documents").where("text is not null").select(i.alias("seq"), F.concat("text", F.when(i % 50 == 1, " [fail]").when(i % 11 == 2, " [none]").otherwise("")).alias("prompt"))
    label = lambda rows: D.with_labels(rows, F.col("prompt"), _answer, ["uses", "referencing"], F.lit("rule"), F.col("seq") % 9 != 0, replies=at)
    label(d.where("seq % 2 = 0"))
    return label(d).select("seq", "category", F.col("classification_signal").alias("signal"), F.col("label_error").isNotNull().alias("failed"))


#: Blocks of a page: a title, the abstract, a footer of two places in two blocks, and a block that is too high; places are made of the row.
_BLOCKS = """array(named_struct('x0', 0d, 'y0', 10d, 'x1', 500d, 'y1', 40d, 'text', '1 University of Titles'),
 named_struct('x0', 0d, 'y0', cast(700 + doc_id % 7 as double), 'x1', 250d, 'y1', cast(740 + doc_id % 7 as double), 'text', concat('2 Institute of ', source, ' studies')),
 named_struct('x0', 0d, 'y0', 690d, 'x1', 250d, 'y1', 699d, 'text', concat('1 University of ', upper(lang), ' north')),
 named_struct('x0', 0d, 'y0', cast(300 + doc_id % 11 as double), 'x1', 500d, 'y1', cast(300 + doc_id % 11 + 20 * (doc_id % 9) as double), 'text', concat('3 Laboratory of ', source)),
 named_struct('x0', 0d, 'y0', 200d, 'x1', 500d, 'y1', 600d, 'text', concat(if(doc_id % 3 = 0, 'Abstract ', ''), coalesce(text, ''))))"""


@_query("""with p as (select doc_id, (doc_id % 3 <> 0 and not contains(substring(coalesce(text, ''), 1, 60), 'Abstract') and not contains(substring(coalesce(text, ''), 1, 60), 'ABSTRACT')) as open_, 20 * (doc_id % 9) < 80 as low, source, upper(lang) as lang from documents)
select doc_id, array_to_string(list_filter([case when open_ then 'University of Titles' end, case when low then 'Laboratory of ' || source end, 'University of ' || lang || ' north', 'Institute of ' || source || ' studies'], lambda x: x is not null), '; ') as affiliations from p""")  # fmt: skip
def footer_affiliations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_BLOCKS).alias("blocks"))
    return d.select("doc_id", F.array_join(A.affiliations(F.lit(None).cast("string"), F.lit(None).cast("string"), A.footer_block(F.col("blocks"))), "; ").alias("affiliations"))


@_query(_with("paper", """, s as (select ['papers', coalesce(title, ''), coalesce(venue, ''), cast(year as varchar), coalesce(arxiv_id, '')] as x from paper where seq % 3 = 0 union all select ['pending', coalesce(title, ''), coalesce(venue, ''), cast(year as varchar), coalesce(arxiv_id, '')] from paper where seq % 3 = 1
 union all select ['discarded', coalesce(title, ''), coalesce(venue, ''), cast(year as varchar), coalesce(arxiv_id, '')] from paper where seq % 3 = 2) select x[1] as sheet, x[2] as name, x[3] as venue, coalesce(x[4], '') as year, x[5] as own_id from s
union all select 'repos', c_name, coalesce(case when c_custkey % 4 = 0 then null else lower(c_mktsegment) || ' project' end, ''), coalesce(cast(case when c_acctbal < 0 then null else cast(floor(c_acctbal) as int) % 50 end as varchar), ''), 'owner' || c_nationkey from customer"""))  # fmt: skip
def sheets_as_csv(spark, sf_dir):
    """All four sheets as they are read back from their files."""
    s, at = F.col("seq"), _folder(spark, "sheets")
    p = shape(spark, sf_dir, "paper").withColumn("bucket", F.when(s % 3 == 0, "verified").when(s % 3 == 1, "pending").otherwise("discarded"))
    out = None
    for name in S.write_sheets(p, shape(spark, sf_dir, "repo"), at):
        fields = ["repo", "description", "stars", "owner"] if name == "repos" else ["title", "venue", "year", "arxiv_id"]
        rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{at}/{name}")
        one = rows.select(F.lit(name).alias("sheet"), *(F.coalesce(c, F.lit("")).alias(n) for c, n in zip(fields, ["name", "venue", "year", "own_id"], strict=True)))
        out = one if out is None else out.unionByName(one)
    return out


@_query(_with("paper", """select seq, 'title' as field, title as old, 'edited ' || seq as new from paper where seq % 10 = 0
 union all select seq, 'venue', venue, 'New venue ' || source from paper where seq % 10 in (0, 5) and venue is distinct from 'New venue ' || source"""))  # fmt: skip
def edit_change_rows(spark, sf_dir):
    p, s, none = shape(spark, sf_dir, "paper"), F.col("seq"), F.lit(None).cast("string")
    empty = ["authors", "affiliations", "description", "url", "pdf_url", "project_url", "image", "reason_detail", "category", "reason", "category_confidence_band", "unclassified_reason"]
    p = p.withColumns({c: none for c in empty} | {"bucket": F.lit("pending"), "manual_override": F.lit(False), "peer_reviewed": F.lit(False), **{f"has_{x}": F.lit(False) for x in ("summary", "classification", "thumbnail", "affiliations")}})
    edit = lambda where, n, f, v: p.where(where).select("seq", F.lit(n).alias("ord"), F.lit(f).alias("field"), v.alias("value"))
    edits = edit(s % 10 == 0, 1, " Title", F.concat(F.lit("edited "), s)).unionByName(edit(s % 5 == 0, 2, "venue", F.concat(F.lit("New venue "), "source")))
    return S.edit_changes(p, S.apply_edits(p, edits)).where("field in ('title', 'venue')")


@_query(_with("figure", """select source, caption, page_num, cast(score as double) as score from (
 select source, caption, page_num, score, row_number() over (partition by source order by score desc, page_num, doc_id) as nth from (
  select *, greatest(0, case doc_id % 3 when 0 then 40 when 1 then -40 else 20 end - 2 * page_num + case figure_num when 1 then 35 when 2 then 35 when 3 then 15 else 0 end) as score from figure where doc_id % 40 >= 20 or doc_id % 50 = 1)
 where score > 0) where nth = 1"""))  # fmt: skip
def gated_captions(spark, sf_dir):
    i = F.col("doc_id")
    f = shape(spark, sf_dir, "figure").withColumns({"score": E.caption_score(F.col("caption"), F.col("page_num"), F.col("figure_num")), "ord": i, "n_drawings": (i % 40).cast("int"), "n_images": F.when(i % 50 == 1, 1)})
    return P.best_caption(P.pages_with_figures(f), "source").select("source", "caption", "page_num", "score")


@_query(_with("paper", "select seq, cast(case seq % 6 when 0 then 1.0 when 1 then 0.85 when 2 then 0.55 when 3 then 0.3 when 4 then 0.0 end as double) as score from paper"))
def band_scores(spark, sf_dir):
    s = F.col("seq")
    band = F.when(s % 6 == 0, "certain").when(s % 6 == 1, "high").when(s % 6 == 2, "medium").when(s % 6 == 3, "low").when(s % 6 == 4, "none")
    return shape(spark, sf_dir, "paper").select("seq", K.score_from_band(band).cast("double").alias("score"))


def queries() -> dict:
    return {name: f for name, (f, _) in _CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _CASES.items() if sql}
