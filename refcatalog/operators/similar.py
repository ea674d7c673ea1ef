"""Exact title similarity joins and greedy de-duplication.

Similarity is 200 * LCS / (|a| + |b|) over lower-cased, trimmed titles.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import written
from .near_titles import near

#: Rows of the first run that is settled, about, and how many times larger each next run is.
RUN, GROWTH = 8_192, 8
#: Open rows, their values and links that one task settles in order, about.
AT_ONCE = 200_000


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - bin(v).count("1")


def title_classes(rows: DataFrame, key: str, title: str) -> tuple[DataFrame, DataFrame]:
    """(key, t) of the rows with a title, and (t, k): the smallest key of each title; both written."""
    named = written(rows.select(F.col(key).alias("key"), F.lower(F.trim(F.col(title))).alias("t")).where("t <> ''"))
    return named, written(named.groupBy("t").agg(F.min("key").alias("k")))


def similar_pairs(rows: DataFrame, key: str = "seq", title: str = "title", percent: int = 90) -> DataFrame:
    """(a, b, score) with a > b: all pairs of different keys whose titles reach ``percent``; equal titles score 100 and are not expanded beyond their class' smallest key.

    Classes of equal titles come first, and only classes are compared (``near``).
    Empty titles match nothing. No pair is lost and nothing is capped.
    """
    named, classes = title_classes(rows, key, title)
    same = named.hint("shuffle_hash").join(classes.withColumnRenamed("k", "b").hint("shuffle_hash"), "t").where("key <> b").select(F.col("key").alias("a"), "b", F.lit(100.0).alias("score"))
    return same.unionByName(near(classes, percent=percent))


def greedy_leaders(rows: DataFrame, values: DataFrame, links: DataFrame, key: str = "seq", seeds: DataFrame | None = None, last_of: list[int] | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """(seq, leader): each row in order joins the earlier leader it shares the first value with, or leads itself.

    values: (seq, rank, v), a row's own values, those of lower rank first. links:
    (rank, v, w), the values w that a row with v looks at besides its own. Of
    several leaders of one rank the first counts, but for the ranks ``last_of``,
    where it is the last seed if there is one. ``seeds`` (seq) lead from the start, whatever they share;
    they come before all other rows. A row leads if no earlier leader has such a
    value, which is the sequential rule.

    Each round settles the rows before which nothing of theirs is open; of each
    value only the first open row and the first leader are needed, so equal values
    are never paired. From the second round on, the components of the rows still
    open that have up to ``at_once`` rows, values and links are settled in order,
    some to a task; in larger ones, runs of rows that wait for just one other are
    followed by pointer doubling. So a chain of any length takes a few rounds;
    more are needed only by a component beyond ``at_once`` whose rows wait for
    several others in a long succession.
    """
    state = rows.select(F.col(key).alias("seq")).distinct()
    known = seeds.select("seq", F.lit(True).alias("seed")).distinct() if seeds is not None else state.where("false").withColumn("seed", F.lit(True))
    state = written(state.hint("shuffle_hash").join(known.hint("shuffle_hash"), "seq", "left").select("seq", F.coalesce("seed", F.lit(False)).alias("seed"), F.when(F.col("seed"), True).alias("leads")))
    looks = written(links.select("rank", "v", "w").unionByName(values.select("rank", "v", F.col("v").alias("w"))).distinct())

    def told(state: DataFrame) -> DataFrame:
        """(rank, v, open, lead, last) of each value: the first open row, the first leader and the last seed among what it looks at."""
        known = values.hint("shuffle_hash").join(state.where("leads is null or leads").hint("shuffle_hash"), "seq")
        leads = F.when(F.col("leads"), F.col("seq"))
        own = known.groupBy("rank", "v").agg(F.min(F.when(F.col("leads").isNull(), F.col("seq"))).alias("open"), F.min(leads).alias("lead"), F.max(F.when(F.col("seed"), F.col("seq"))).alias("last"))
        seen = looks.hint("shuffle_hash").join(own.withColumnRenamed("v", "w").hint("shuffle_hash"), ["rank", "w"])
        return seen.groupBy("rank", "v").agg(F.min("open").alias("open"), F.min("lead").alias("lead"), F.max("last").alias("last"))

    def before_each(state: DataFrame) -> DataFrame:
        """(seq, led, waits): whether an earlier leader, and whether an earlier open row, has a value of the row's."""
        met = values.hint("shuffle_hash").join(told(state).hint("shuffle_hash"), ["rank", "v"])
        return met.groupBy("seq").agg(*(F.bool_or(F.coalesce(F.col(c) < F.col("seq"), F.lit(False))).alias(n) for c, n in (("lead", "led"), ("open", "waits"))))

    rounds, open_ = 0, F.col("leads").isNull()
    led, free = F.when(F.coalesce("led", F.lit(False)), False), ~F.coalesce("waits", F.lit(False))
    while state.where(open_).limit(1).count():
        before, rounds = state, rounds + 1
        seen = before_each(state)
        state = written(state.hint("shuffle_hash").join(seen.hint("shuffle_hash"), "seq", "left").select("seq", "seed", F.coalesce("leads", led.when(free, True)).alias("leads")))
        if rounds > 1 and state.where(open_).limit(1).count():
            state = _along_runs(state, before, values, looks)
            if rounds & (rounds - 1) == 0:  # the second, fourth, eighth round
                state = _decided(state, before_each(state).select("seq", led.alias("now")))
                state = _at_once(state, values, looks, at_once)
    met = values.hint("shuffle_hash").join(told(state).hint("shuffle_hash"), ["rank", "v"]).where("lead < seq")
    latest = F.col("rank").isin(*(last_of or []))
    best = met.groupBy("seq").agg(F.min_by(F.when(latest, F.coalesce("last", "lead")).otherwise(F.col("lead")), "rank").alias("leader"))
    return state.hint("shuffle_hash").join(best.hint("shuffle_hash"), "seq", "left").select("seq", F.when(F.col("leads"), F.col("seq")).otherwise(F.col("leader")).alias("leader"))


def _decided(state: DataFrame, found: DataFrame) -> DataFrame:
    """``state`` with what is ``found`` (seq, now) of open rows."""
    return written(state.hint("shuffle_hash").join(found.hint("shuffle_hash"), "seq", "left").select("seq", "seed", F.coalesce("leads", "now").alias("leads")))


def _along_runs(state: DataFrame, before: DataFrame, values: DataFrame, looks: DataFrame) -> DataFrame:
    """``state`` with the rows settled that waited, in ``before``, for one row only which is settled now, or waited for one only, and so on: each leads if that one doesn't."""
    two = lambda df, by, o: df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(o))).where("nth <= 2").drop("nth")
    waiting = before.where("leads is null").select("seq")
    own = two(values.hint("shuffle_hash").join(waiting.hint("shuffle_hash"), "seq"), ["rank", "v"], "seq").select("rank", F.col("v").alias("w"), F.col("seq").alias("o"))
    seen = two(looks.hint("shuffle_hash").join(own.hint("shuffle_hash"), ["rank", "w"]).select("rank", "v", "o").distinct(), ["rank", "v"], "o")
    still = state.where("leads is null").select("seq")
    met = values.hint("shuffle_hash").join(still.hint("shuffle_hash"), "seq").hint("shuffle_hash").join(seen.hint("shuffle_hash"), ["rank", "v"]).where("o < seq")
    lone = met.groupBy("seq").agg(F.min("o").alias("to"), F.max("o").alias("most")).where("to = most")
    run = written(lone.select("seq", "to", F.lit(True).alias("odd")))
    while True:
        ahead = run.select(F.col("seq").alias("to"), F.col("to").alias("next"), F.col("odd").alias("turn"))
        if not run.join(ahead.hint("shuffle_hash"), "to", "left_semi").limit(1).count():
            break
        moved = run.hint("shuffle_hash").join(ahead.hint("shuffle_hash"), "to", "left")
        run = written(moved.select("seq", F.coalesce("next", "to").alias("to"), (F.col("odd") != F.coalesce("turn", F.lit(False))).alias("odd")))
    ends = state.where("leads is not null").select(F.col("seq").alias("to"), "leads")
    return _decided(state, run.hint("shuffle_hash").join(ends.hint("shuffle_hash"), "to").select("seq", (F.col("leads") != F.col("odd")).alias("now")))


def _open_components(own: DataFrame, looks: DataFrame) -> DataFrame:
    """(seq, c): the smallest open row that can be reached over shared values and links. Labels hook onto smaller neighbours' and are halved in each round, so rounds grow with the logarithm of a component's reach."""
    labels = written(own.select("seq").distinct().withColumn("c", F.col("seq")))
    while True:
        tops = labels.select(F.col("seq").alias("c"), F.col("c").alias("top"))
        grand = written(labels.hint("shuffle_hash").join(tops.hint("shuffle_hash"), "c"))
        least = own.hint("shuffle_hash").join(grand.hint("shuffle_hash"), "seq").groupBy("rank", F.col("v").alias("w")).agg(F.min("top").alias("top"))
        seen = looks.hint("shuffle_hash").join(least.hint("shuffle_hash"), ["rank", "w"]).groupBy("rank", "v").agg(F.min("top").alias("top"))
        near = written(own.hint("shuffle_hash").join(seen.hint("shuffle_hash"), ["rank", "v"]).groupBy("seq").agg(F.min("top").alias("c")))
        hooked = grand.select("seq", F.col("c").alias("own")).hint("shuffle_hash").join(near.hint("shuffle_hash"), "seq").select(F.col("own").alias("seq"), "c")
        after = written(near.unionByName(hooked).unionByName(grand.select("seq", F.col("top").alias("c"))).groupBy("seq").agg(F.min("c").alias("c")))
        moved = after.hint("shuffle_hash").join(labels.withColumnRenamed("c", "was").hint("shuffle_hash"), "seq").where("c <> was").limit(1).count()
        labels = after
        if not moved:
            return labels


def _at_once(state: DataFrame, values: DataFrame, looks: DataFrame, at_once: int) -> DataFrame:
    """``state`` with all rows settled that lie in components of open rows with at most ``at_once`` rows, values and links."""
    own = written(values.hint("shuffle_hash").join(state.where("leads is null").select("seq").hint("shuffle_hash"), "seq"))
    both = looks.hint("shuffle_hash").join(own.select("rank", "v").distinct().hint("shuffle_hash"), ["rank", "v"])
    held = written(both.hint("shuffle_hash").join(own.select("rank", F.col("v").alias("w")).distinct().hint("shuffle_hash"), ["rank", "w"]))
    labels = _open_components(own, held)
    placed = own.hint("shuffle_hash").join(labels.hint("shuffle_hash"), "seq")
    where = placed.groupBy("rank", "v").agg(F.min("c").alias("c"))
    links = held.where("v <> w").hint("shuffle_hash").join(where.hint("shuffle_hash"), ["rank", "v"])
    records = written(placed.select("c", "rank", "v", "seq", F.lit(None).cast("string").alias("w")).unionByName(links.select("c", "rank", "v", F.lit(None).cast("long").alias("seq"), "w")))
    small = written(records.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= at_once))
    total = small.agg(F.sum("n")).first()[0] or 0
    if not total:
        return state
    tasks = max(-(-2 * total // at_once), 1)
    dealt = records.hint("shuffle_hash").join(small.drop("n").hint("shuffle_hash"), "c").withColumn("task", F.pmod(F.xxhash64("c"), F.lit(tasks)))
    return _decided(state, dealt.groupBy("task").applyInPandas(_in_order, "seq long, now boolean"))


def _in_order(records: pd.DataFrame) -> pd.DataFrame:
    """(seq, now): the sequential rule over whole components, about ``AT_ONCE`` records."""
    looked: dict[tuple, list[tuple]] = {}
    linked = records[records.seq.isna()]
    for r, v, w in zip(linked["rank"], linked.v, linked.w, strict=True):
        looked.setdefault((r, v), []).append((r, w))
    own: dict[int, list[tuple]] = {}
    rows = records[records.seq.notna()]
    for seq, r, v in zip(rows.seq.astype("int64"), rows["rank"], rows.v, strict=True):
        own.setdefault(seq, []).append((r, v))
    taken: set[tuple] = set()
    out = []
    for seq in sorted(own):
        leads = not any(x in taken or any(y in taken for y in looked.get(x, ())) for x in own[seq])
        if leads:
            taken.update(own[seq])
        out.append(leads)
    return pd.DataFrame({"seq": sorted(own), "now": out})


def _in_turn(rows: DataFrame, ids: list[str], percent: int) -> DataFrame:
    """(seq, leader) of ``rows`` (seq, t and ids) among themselves."""
    named, classes = title_classes(rows, "seq", "t")
    pairs = written(similar_pairs(classes.select(F.col("k").alias("seq"), F.col("t").alias("title")), percent=percent).select(F.col("a").cast("string").alias("v"), F.col("b").cast("string").alias("w")))
    own = named.hint("shuffle_hash").join(classes.hint("shuffle_hash"), "t").select(F.col("key").alias("seq"), F.lit(len(ids)).alias("rank"), F.col("k").cast("string").alias("v"))
    links = pairs.unionByName(pairs.select(F.col("w").alias("v"), F.col("v").alias("w"))).withColumn("rank", F.lit(len(ids)))
    return greedy_leaders(rows, written(own.unionByName(_id_values(rows, ids))), links, last_of=list(range(len(ids))))


def _id_values(rows: DataFrame, ids: list[str]) -> DataFrame:
    """(seq, rank, v) of each id that a row has."""
    each = F.array(*(F.struct(F.lit(r).alias("rank"), F.when(F.col(c) != "", F.col(c)).alias("v")) for r, c in enumerate(ids)))
    return rows.select("seq", F.inline(F.filter(each, lambda x: x["v"].isNotNull())))


def _followers(leaders: DataFrame, rows: DataFrame, ids: list[str], percent: int) -> DataFrame:
    """(seq, leader) of the later ``rows`` that share an id with a leader or have a similar title; leader is the first one of a similar title, if there is any."""
    named, classes = title_classes(rows, "seq", "t")
    firsts = written(leaders.where("t <> ''").groupBy("t").agg(F.min("seq").alias("k")))
    met = written(near(firsts, classes, percent, "first").select(F.col("b").alias("k"), F.col("a").alias("leader")))
    told = classes.hint("shuffle_hash").join(met.hint("shuffle_hash"), "k").select("t", "leader")
    by_title = named.hint("shuffle_hash").join(told.hint("shuffle_hash"), "t").select(F.col("key").alias("seq"), "leader")
    held = _id_values(leaders, ids).select("rank", "v").distinct()
    by_id = _id_values(rows, ids).hint("shuffle_hash").join(held.hint("shuffle_hash"), ["rank", "v"], "left_semi").select("seq", F.lit(None).cast("long").alias("leader"))
    return by_title.unionByName(by_id).groupBy("seq").agg(F.min("leader").alias("leader"))


def dedup(rows: DataFrame, ids: list[str], title: str = "title", percent: int = 90, key: str = "seq", seeds: DataFrame | None = None) -> DataFrame:
    """(seq, leader) by shared ids, in their order of priority, else by similar titles; only a leader's own ids and title count.

    ``key`` orders the rows; ``seeds`` (seq), which come first, all lead. Rows are
    settled in runs of consecutive ones, each ``GROWTH`` times the size of the one before. Once a
    run is settled, all later rows that share something with a leader of it follow,
    and only the rest goes on: so a large group of similar titles, whose first ones
    come early, is never paired within.
    """
    low = F.nullif(F.lower(F.trim(F.col(title))), F.lit(""))
    base = written(rows.select(F.col(key).alias("seq"), low.alias("t"), *(F.col(c) for c in ids)))
    leads, told = [], []
    left = base

    def follow(leaders: DataFrame, rest: DataFrame) -> DataFrame:
        found = written(_followers(leaders, rest, ids, percent))
        told.append(found)
        return written(rest.hint("shuffle_hash").join(found.select("seq").hint("shuffle_hash"), "seq", "left_anti"))

    if seeds is not None:
        first = seeds.select("seq").distinct()
        old = written(base.hint("shuffle_hash").join(first.hint("shuffle_hash"), "seq", "left_semi"))
        leads.append(old.select("seq", F.lit(True).alias("seed")))
        left = follow(old, base.hint("shuffle_hash").join(first.hint("shuffle_hash"), "seq", "left_anti"))
    size = RUN
    while n := left.count():
        last = n <= 2 * size
        bound = None if last else left.agg(F.percentile_approx("seq", size / n, max(10_000, 20 * n // size))).first()[0]
        run = left if last else left.where(F.col("seq") <= bound)
        got = written(_in_turn(run, ids, percent))
        told.append(got.where("seq <> leader"))
        leads.append(got.where("seq = leader").select("seq", F.lit(False).alias("seed")))
        if last:
            break
        left = follow(written(run.hint("shuffle_hash").join(leads[-1].select("seq").hint("shuffle_hash"), "seq", "left_semi")), left.where(F.col("seq") > bound))
        size *= GROWTH
    leading, told = reduce(DataFrame.unionByName, leads), reduce(DataFrame.unionByName, told)
    values = _id_values(base, ids)
    of = values.hint("shuffle_hash").join(leading.hint("shuffle_hash"), "seq").groupBy("rank", "v").agg(F.min("seq").alias("lead"), F.max(F.when(F.col("seed"), F.col("seq"))).alias("last"))
    by_id = values.hint("shuffle_hash").join(of.hint("shuffle_hash"), ["rank", "v"]).where("lead < seq").groupBy("seq").agg(F.min_by(F.coalesce("last", "lead"), "rank").alias("by_id"))
    following = told.hint("shuffle_hash").join(by_id.hint("shuffle_hash"), "seq", "left").select("seq", F.coalesce("by_id", "leader").alias("leader"))
    return leading.select("seq", F.col("seq").alias("leader")).unionByName(following)
