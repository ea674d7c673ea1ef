"""The queries that bind each operator to its table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curve_packing, decontam, near_dup, packing, quality, secrets, shards, token_count, topk, toxicity, url_filter, vector_codes, whitening
from .shared import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.fit(toxicity.training_rows(docs, labels.where(~held_out), "doc_id", "text", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(table(spark, sf_dir, "documents"), k=4, percent=80)


#: The url rules (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2048, 0)


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), 16)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), 4096)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), pieces=4, entries=256, rounds=4, scale=1024)
    return vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2048, 1)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), components=32, scale=64)
    each = white.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "own"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "own.whitened", "own.explained", "identity_error")


_OP4_SQL = """
with split as (
  select page_id,
         case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest
  from pages),
parts as (
  select page_id,
         translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from split),
judged as (
  select page_id, host, path,
         case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
              when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
              when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
              when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from parts)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict
from judged
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as ws from documents),
sets as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
         else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as shingles
  from w),
sizes as (select doc_id, len(shingles) as n from sets),
each as (select doc_id, unnest(shingles) as shingle from sets),
met as (
  select x.doc_id as a, y.doc_id as b, count(*) as both_have
  from each x join each y on x.shingle = y.shingle and x.doc_id < y.doc_id group by all),
links as (
  select a, b from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * both_have >= 80 * (x.n + y.n - both_have)),
ways as (select a, b from links union select b, a from links),
reach as (select doc_id as node, doc_id as found from documents union select node, b from reach join ways on found = a)
select s.doc_id, s.n as n_shingles, min(found) as component_id, s.doc_id = min(found) as kept
from sizes s join reach on node = s.doc_id group by s.doc_id, s.n
"""

_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP9_SQL = f"""
with d as (select doc_id, {_WORDS} as ws from documents),
i as (select item_id, {_WORDS} as ws from benchmark),
windows as (
  select distinct item_id, size, array_to_string(ws[start_at:start_at + size - 1], ' ') as passage
  from (select *, least(len(ws), 10) as size, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as start_at from i where len(ws) > 0)),
met as (
  select doc_id, start_at, size, array_to_string(ws[start_at:start_at + size - 1], ' ') as passage
  from (select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) as start_at from d, (select distinct size from windows) where len(ws) >= size)),
found as (select doc_id, start_at, m.size, item_id from met m join windows w on m.size = w.size and m.passage = w.passage),
hits as (select doc_id, count(distinct pos) as n from (select doc_id, unnest(range(start_at, start_at + size)) as pos from found) group by 1),
items as (select doc_id, list(distinct cast(item_id as varchar)) as ids from found group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n, 0) as n_hit, cast(coalesce(len(ids), 0) as bigint) as n_items,
       sha256(coalesce(array_to_string(list_sort(ids), ','), '')) as items_sha256, coalesce(n, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""

_OP10_SQL = """
with whole as (
  select vec_id, row_number() over () as row_at, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.row_at, q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as score
  from whole q join whole c on q.row_at <> c.row_at where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by row_at order by score desc, vec_id) as nth from pairs)
select query_id, cast(nth as int) as "rank", vec_id, cast(score as bigint) as score from ranked where nth <= 5
"""


def _op11_sql() -> str:
    """Product codebooks by all distances: the four rounds follow one another as named steps."""
    steps = ["""kept as materialized (
  select vec_id, label, row_number() over () as row_at, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        "first as (select *, row_number() over (order by vec_id, v) - 1 as entry from kept where vec_id is not null)",
        "parts as materialized (select row_at, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] as w from kept, range(4) as p(part))",
        "book0 as materialized (select part, entry, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] as w from first, range(4) as p(part) where entry < 256)",
    ]
    assign = """own{r} as materialized (
  select row_at, part, w, least_far.far as far, least_far.entry as entry from (
    select row_at, part, p.w as w, min(struct_pack(far := list_sum(list_transform(range(1, len(p.w) + 1), lambda i: (p.w[i] - b.w[i]) * (p.w[i] - b.w[i]))), entry := entry)) as least_far
    from parts p join book{r} b using (part) group by row_at, part, p.w))"""
    update = """book{n} as materialized (
  select b.part, b.entry, coalesce(m.w, b.w) as w from book{r} b left join (
    select part, entry, list(mean order by i) as w from (
      select part, entry, i, cast((sum(w[i]) - ((sum(w[i]) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as mean
      from own{r}, range(1, (select max(len(w)) from parts) + 1) as d(i) group by part, entry, i) group by part, entry) m using (part, entry))"""
    for r in range(4):
        steps += [assign.format(r=r), update.format(r=r, n=r + 1)]
    steps.append(assign.format(r=4))
    steps.append("coded as (select row_at, string_agg(format('{:02x}', entry), '' order by part) as code, cast(sum(far) as bigint) as error from own4 group by row_at)")
    steps.append("sha as (select sha256(string_agg(array_to_string(w, ','), ',' order by part, entry)) as codebooks_sha256 from book4)")
    return f"with {', '.join(steps)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from kept join coded using (row_at), sha"


def queries() -> dict:
    return {f.__name__: f for f in (op1_cotraining_quality, op2_compression_toxicity, op3_near_duplicates, op4_url_filter, op5_best_fit_packing, op6_histogram_shards, op7_secret_scan, op8_token_counts, op9_decontamination, op10_exact_top_k, op11_vector_codes, op12_curve_packing, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op3_near_duplicates": _OP3_SQL, "op4_url_filter": _OP4_SQL, "op9_decontamination": _OP9_SQL, "op10_exact_top_k": _OP10_SQL, "op11_vector_codes": _op11_sql()}
