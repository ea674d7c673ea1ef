"""DuckDB SQL of the title rules: similar pairs and the sequential resolution, row by row in order."""

#: 200 * LCS / (|a| + |b|) of two texts by the textbook table, a row a character; the coarser Levenshtein of single bytes can only be smaller than the distance, and rejects most pairs first.
_SIMILAR = """
{name}_c as (select t, min(k) as k, length(t) as n, regexp_replace(t, '[^ -~]', '?', 'g') as low, string_split(t, '') as cs from {rows} where t <> '' group by t),
{name}_near as materialized (select a.k as a, b.k as b, a.cs as x, b.cs as y, a.n + b.n as total from {name}_c a join {name}_c b on a.k > b.k and a.n * 90 <= b.n * 110 and b.n * 90 <= a.n * 110
 where levenshtein(a.low, b.low) <= (a.n + b.n) * 10 // 100),
{name}_lcs as (select a, b, total, list_reduce(list_transform(x, lambda c: list_transform(y, lambda d: cast(c = d as int))),
  lambda p, m: list_transform(range(1, len(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(p[i], m[i] + case when m[i] = 1 and i > 1 then p[i - 1] else 0 end)))),
  list_transform(y, lambda d: 0))[-1] as lcs from {name}_near),
{name} as (select a, b, 200.0::double * lcs / total as score from {name}_lcs where 200 * lcs >= 90 * total)"""


def similar(name: str, rows: str) -> str:
    """CTEs up to ``name`` (a, b, score) over the classes of ``rows`` (k, t), named by their smallest k."""
    return _SIMILAR.format(name=name, rows=rows)


def resolution(name: str, rows: str, seeds: str = "false") -> str:
    """CTEs up to ``name`` (seq, leader) over ``rows`` (seq, title, arxiv_id, doi): a row joins the earlier leader of the same arxiv_id, else doi (the last of several), else a similar title (the first); recursive. Rows where ``seeds`` holds all lead."""
    return f"""
{name}_t as (select seq as k, lower(trim(title)) as t from {rows}),{similar(f'{name}_s', f'{name}_t')},
{name}_v as (select seq, 0 as rank, arxiv_id as v from {rows} where arxiv_id <> '' union all select seq, 1, doi from {rows} where doi <> ''
 union all select {name}_t.k, 2, cast(c.k as varchar) from {name}_t join {name}_s_c c using (t)),
{name}_l as (select distinct rank, v, v as w from {name}_v union all select 2, cast(a as varchar), cast(b as varchar) from {name}_s union all select 2, cast(b as varchar), cast(a as varchar) from {name}_s),
{name}_e as (select x.seq, list(distinct {{'rank': x.rank, 'nth': case when x.rank < 2 then -y.seq else y.seq end, 'to': y.seq}}) as earlier from {name}_v x join {name}_l l on x.rank = l.rank and x.v = l.v join {name}_v y on y.rank = l.rank and y.v = l.w where y.seq < x.seq group by x.seq),
{name}_o as materialized (select row_number() over (order by r.seq) as nth, r.seq, list_sort(coalesce(earlier, [])) as earlier from {rows} r left join {name}_e e on r.seq = e.seq),
{name}_r as (select 0::bigint as nth, null::bigint as seq, null::bigint as leader, []::bigint[] as leaders
 union all select nth, seq, leader, case when leader = seq then list_append(leaders, seq) else leaders end
 from (select o.nth, o.seq, r.leaders, case when {seeds} then o.seq else coalesce(list_filter(o.earlier, lambda e: list_contains(r.leaders, e.to))[1].to, o.seq) end as leader from {name}_r r join {name}_o o on o.nth = r.nth + 1)),
{name} as (select seq, leader from {name}_r where nth > 0)"""
