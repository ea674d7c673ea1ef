"""Resolution, routing and merging of records. Order always comes from a ``seq`` column of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import present
from ..functions.venues import Venue, is_confident, venue_upgraded


def min_year(df: DataFrame, least: int) -> DataFrame:
    """Rows of a known year before ``least`` go; unknown years stay."""
    return df.where(F.col("year").isNull() | (F.col("year") == 0) | (F.col("year") >= least))


def exclude(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Rows whose lower-cased, trimmed value is listed go; null values stay."""
    low = F.lower(F.trim(column))
    return df.where(low.isNull() | ~low.isin(*(k.strip().lower() for k in keys)))


def union_sources(*ranked: tuple[int, DataFrame]) -> DataFrame:
    """One table of all sources; ``order`` puts the rows of a source before those of a higher ``rank``, each by its ``seq`` (0 to 2^52)."""
    first, *rest = [df.withColumn("order", F.lit(r << 52) + F.col("seq")) for r, df in ranked]
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def overlay(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and old rows of other keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def match_by_priority(new: DataFrame, old: DataFrame, keys: list[str], id_column: str, order: str = "seq") -> DataFrame:
    """Adds ``matched``: the id of the old row that shares the first key possible; of several the last in order. Missing keys match nothing."""
    out = new
    for i, k in enumerate(keys):
        last = old.where(present(F.col(k)).isNotNull()).groupBy(F.col(k).alias(f"__k{i}")).agg(F.max_by(id_column, order).alias(f"__m{i}"))
        out = out.join(last, present(F.col(k)) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    found = [f"__m{i}" for i in range(len(keys))]
    return out.withColumn("matched", F.coalesce(*found)).drop(*found)


def coalesce_cluster(df: DataFrame, cluster: str, columns: list[str], order: str = "seq") -> DataFrame:
    """Of each cluster and column the first value present, in order; partial aggregation only."""
    first = lambda c: F.min_by(F.col(c), F.when(present(F.col(c).cast("string")).isNotNull(), F.col(order))).alias(c)
    some = lambda c: F.max(present(F.col(c).cast("string")).isNotNull()).alias(f"__{c}")
    out = df.groupBy(cluster).agg(*(first(c) for c in columns), *(some(c) for c in columns), F.min(order).alias(order))
    return out.select(cluster, order, *(F.when(F.col(f"__{c}"), F.col(c)).alias(c) for c in columns))


def venue_survivor(df: DataFrame, cluster: str, dim: list[Venue], order: str = "seq") -> DataFrame:
    """Of each cluster the first confident venue, else the first one present."""
    v = present(F.col("venue"))
    rank = F.when(v.isNull(), 2).when(is_confident(v, dim), 0).otherwise(1)
    return df.groupBy(cluster).agg(F.min_by(v, F.struct(rank, F.col(order))).alias("venue"))


def route(new: DataFrame, old: DataFrame) -> DataFrame:
    """Adds route, matched and the four needs to new rows (arxiv_id, doi, content_hash, venue).

    old: those columns, seq, manual_override and the ``has_*`` flags. A row that
    matches none is ``new``; an override with all parts is ``protected``, with
    gaps ``fill_gaps``; a published preprint or changed content is ``reprocess``;
    gaps alone ``fill_gaps``; the rest ``skip``.
    """
    flags = ["has_summary", "has_classification", "has_thumbnail", "has_affiliations"]
    met = match_by_priority(new, old, ["arxiv_id", "doi", "content_hash"], "seq")
    held = old.select(F.col("seq").alias("matched"), F.col("venue").alias("old_venue"), F.col("content_hash").alias("old_hash"), F.coalesce("manual_override", F.lit(False)).alias("kept"), *(F.coalesce(f, F.lit(False)).alias(f"old_{f}") for f in flags))
    both = met.join(held, "matched", "left")
    complete = F.lit(True)
    for f in flags:
        complete = complete & F.col(f"old_{f}")
    how = (
        F.when(F.col("matched").isNull(), "new")
        .when(F.col("kept") & complete, "protected")
        .when(F.col("kept"), "fill_gaps")
        .when(venue_upgraded(F.col("old_venue"), F.col("venue")) | ~F.col("old_hash").eqNullSafe(F.col("content_hash")), "reprocess")
        .when(~complete, "fill_gaps")
        .otherwise("skip")
    )
    both = both.withColumn("route", how)
    for f in flags:
        need = F.col("route").isin("new", "reprocess") | ((F.col("route") == "fill_gaps") & ~F.col(f"old_{f}"))
        both = both.withColumn(f.replace("has_", "needs_"), need)
    return both.drop("old_venue", "old_hash", "kept", *(f"old_{f}" for f in flags))


def unlink_shared(repos: DataFrame, least: int = 5) -> DataFrame:
    """Links that ``least`` repos or more share stay only with the repo of most stars (the first of equals); adds ``unlinked``."""
    url = present(F.col("linked_paper_url"))
    shared = repos.where(url.isNotNull()).groupBy(url.alias("__url")).agg(F.count(F.lit(1)).alias("__n"), F.max(F.struct(F.coalesce("stars", F.lit(0)).alias("stars"), (-F.col("seq")).alias("first"))).alias("__best")).where(F.col("__n") >= least)
    out = repos.join(shared, url == F.col("__url"), "left")
    gone = F.col("__n").isNotNull() & (-F.col("seq") != F.col("__best.first"))
    out = out.withColumn("unlinked", gone)
    return out.withColumn("linked_paper_url", F.when(~gone, F.col("linked_paper_url"))).withColumn("linked_paper_tier", F.when(~gone, F.col("linked_paper_tier"))).drop("__url", "__n", "__best")


def repo_type(name: Column, description: Column, stars: Column, url: Column, parent: Column, unlinked: Column, category: Column, override: Column, current: Column, course_parents: list[str], course_words: list[str]) -> Column:
    text = F.lower(F.concat_ws(" ", name, F.coalesce(description, F.lit(""))))
    course = F.exists(F.array(*(F.lit(w.lower()) for w in course_words)), lambda w: F.contains(text, w))
    bare = (F.coalesce(stars, F.lit(0)) == 0) & present(description).isNull()
    research = (F.coalesce(category, F.lit("")) == "uses_infrastructure") | present(url).isNotNull() | ((F.coalesce(stars, F.lit(0)) >= 6) & present(description).isNotNull())
    return F.when(F.coalesce(override, F.lit(False)), current).when(F.coalesce(parent.isin(*course_parents), F.lit(False)) | (unlinked & bare) | course, "course").when(research, "research").otherwise("experiment")


def link_repos(repos: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers with ``project_url`` of the first repo that links their id, if they had none, and the lowest tier."""
    links = repos.where(present(F.col("linked_arxiv_id")).isNotNull()).groupBy(F.col("linked_arxiv_id").alias("__id")).agg(F.min_by("url", "seq").alias("__url"), F.min("linked_paper_tier").alias("__tier"))
    out = papers.join(links, present(F.col("arxiv_id")) == F.col("__id"), "left")
    return out.withColumn("project_url", F.coalesce(present(F.col("project_url")), F.col("__url"))).withColumn("linked_paper_tier", F.least("linked_paper_tier", "__tier")).drop("__id", "__url", "__tier")


def merge_repos(new: DataFrame, old: DataFrame, as_of: Column, grace_days: int = 30) -> DataFrame:
    """Whole repo rows by key: one seen again takes the new row and keeps first_seen; an override keeps its old row.

    Unseen ones stay if overridden or last seen within ``grace_days``; a missing date ages out. Every column of
    either side is kept; where one side lacks it, the other's value counts.
    """
    sides = {}
    for side, df in (("new", new), ("old", old)):
        sides[side] = df.select("key", F.struct(*(F.col(c) for c in df.columns if c != "key")).alias(f"__{side}"))
    both = sides["new"].join(sides["old"], "key", "full")
    at = lambda side, df, c: F.col(f"__{side}.{c}") if c in df.columns else F.lit(None)
    here, kept = F.col("__new").isNotNull(), F.coalesce(at("old", old, "manual_override"), F.lit(False))
    both = both.where(here | kept | (F.datediff(as_of, at("old", old, "last_seen")) <= grace_days))
    dates = {"first_seen": F.coalesce(at("old", old, "first_seen"), as_of), "last_seen": F.when(here, as_of).otherwise(at("old", old, "last_seen")), "manual_override": kept}

    def value(c: str) -> Column:
        if c not in new.columns or c not in old.columns:
            return F.coalesce(at("new", new, c), at("old", old, c))
        return F.when(here & ~kept, at("new", new, c)).otherwise(at("old", old, c))

    names = [c for c in dict.fromkeys([*new.columns, *old.columns]) if c != "key"]
    return both.select("key", *((dates[c] if c in dates else value(c)).alias(c) for c in [*names, *(d for d in dates if d not in names)]))


def diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, old, new) of every changed value, added and removed rows included."""
    a = before.select(key, *(F.col(c).cast("string").alias(f"a_{c}") for c in columns))
    b = after.select(key, *(F.col(c).cast("string").alias(f"b_{c}") for c in columns))
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("old"), F.col(f"b_{c}").alias("new")) for c in columns))
    return a.join(b, key, "full").select(key, F.inline(F.filter(each, lambda x: ~x["old"].eqNullSafe(x["new"]))))


def apply_curation(state: DataFrame, actions: DataFrame, reasons: list[str] | None = None) -> DataFrame:
    """State with promote, demote and discard of an actions table (key, action, reason, and detail if there is one) applied; touched rows are frozen.

    Of several actions the last by seq counts. A promotion clears reason and detail. Unknown actions, and
    reasons that are not among ``reasons`` (if given), are errors.
    """
    said = F.struct("action", "reason", (F.col("detail") if "detail" in actions.columns else F.lit(None).cast("string")).alias("detail"))
    last = actions.groupBy("key").agg(F.max_by(said, "seq").alias("__do"))
    out = state.join(last, "key", "left")
    act, why = F.col("__do.action"), F.col("__do.reason")
    known = act.isin("promote", "demote", "discard")
    bucket = F.when(act == "promote", "verified").when(act == "demote", "pending").when(act == "discard", "discarded").otherwise(F.col("bucket"))
    checked = F.when(act.isNotNull() & ~known, F.raise_error(F.concat(F.lit("unknown action "), act))).otherwise(bucket)
    if reasons is not None:
        why = F.when((act != "promote") & ~F.coalesce(why.isin(*reasons), F.lit(False)), F.raise_error(F.concat(F.lit("unknown reason "), F.coalesce(why, F.lit("null"))))).otherwise(why)
    made = {
        "bucket": checked,
        "reason": F.when(act == "promote", F.lit(None)).when(known, why).otherwise(F.col("reason")),
        "manual_override": F.coalesce("manual_override", F.lit(False)) | F.coalesce(known, F.lit(False)),
    }
    if "reason_detail" in state.columns:
        made["reason_detail"] = F.when(act == "promote", F.lit(None)).when(known, F.col("__do.detail")).otherwise(F.col("reason_detail"))
    return out.select(*(c for c in state.columns if c not in made), *(v.alias(c) for c, v in made.items()))


def latest_batch(df: DataFrame, key: str, ts: str, ttl_hours: int, as_of: Column) -> DataFrame:
    """Rows of each key's latest batch, while that is younger than the time to live."""
    last = df.groupBy(key).agg(F.max(ts).alias("__last")).where(F.col("__last") > as_of - F.make_interval(hours=F.lit(ttl_hours)))
    return df.join(last, key).where(F.col(ts) == F.col("__last")).drop("__last")
