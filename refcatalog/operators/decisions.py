"""Decisions on rows: repo routes, course links, lookups by id, venue upgrades, and the evidence a paper is classified by."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import keys as K
from ..functions import venues as V
from ..plans.tables import written
from . import versions


def route_repos(new: DataFrame, old: DataFrame) -> DataFrame:
    """Adds ``route`` and ``old`` to new repos: the old row of the same owner and repo as a struct, the last by ``seq``.

    A repo that is not there is ``new``, an override ``protected``, a changed
    content_hash ``reprocess``, a missing classification ``fill_gaps``, the rest ``skip``.
    """
    held = old.groupBy("owner", "repo").agg(F.max_by(F.struct(*old.columns), "seq").alias("old"))
    o = lambda c: F.col(f"old.{c}")
    how = (
        F.when(F.col("old").isNull(), "new")
        .when(F.coalesce(o("manual_override"), F.lit(False)), "protected")
        .when(~o("content_hash").eqNullSafe(F.col("content_hash")), "reprocess")
        .when(~F.coalesce(o("has_classification"), F.lit(False)), "fill_gaps")
        .otherwise("skip")
    )
    return new.join(held, ["owner", "repo"], "left").select(*new.columns, how.alias("route"), "old")


def process_repos(decisions: DataFrame, category: Column | None = None) -> DataFrame:
    """Rows of ``route_repos`` by their route: skip and protected give the old row, others the new one with a new content_hash.

    ``category`` fills the gaps of rows that have no classification yet.
    """
    stays = F.col("route").isin("skip", "protected") & F.col("old").isNotNull()
    gap = (F.col("route") == "fill_gaps") & ~F.coalesce("has_classification", F.lit(False)) & (F.lit(False) if category is None else category.isNotNull())
    made = {"content_hash": K.repo_hash(F.col("description"), F.col("last_commit"), F.col("archived"))}
    if category is not None:
        made |= {"category": F.when(gap, category).otherwise(F.col("category")), "has_classification": gap | F.coalesce("has_classification", F.lit(False))}
    fields = decisions.schema["old"].dataType.names
    columns = [c for c in decisions.columns if c not in ("route", "old")]
    each = [F.when(stays, F.col(f"old.{c}")).otherwise(made.get(c, F.col(c))) if c in fields else made.get(c, F.col(c)) for c in columns]
    rest = [F.when(stays, F.col(f"old.{c}")).alias(c) for c in fields if c not in columns]
    return decisions.select("route", *(x.alias(c) for x, c in zip(each, columns, strict=True)), *rest)


def unlink_courses(repos: DataFrame) -> DataFrame:
    """Course repos without their paper link and its tier, unless overridden; ``cleared`` marks them."""
    gone = (F.col("repo_type") == "course") & K.present(F.col("linked_paper_url")).isNotNull() & ~F.coalesce("manual_override", F.lit(False))
    out = repos.withColumn("cleared", F.coalesce(gone, F.lit(False)))
    return out.withColumns({c: F.when(~F.col("cleared"), F.col(c)) for c in ("linked_paper_url", "linked_paper_tier")})


def venue_upgrades(new: DataFrame, old: DataFrame, dim: list[V.Venue]) -> DataFrame:
    """One row per old preprint that a new row shows to be published: seq (the old one), title, old_venue, venue, venue_type, peer_reviewed, message.

    New rows are looked up by preprint id, or by doi where they have none; of several
    old rows of a key the last, of several upgrades of an old row the first counts.
    """
    key = F.coalesce(F.concat(F.lit("arxiv:"), K.present(F.col("arxiv_id"))), F.concat(F.lit("doi:"), K.present(F.col("doi"))))
    both = F.array(F.concat(F.lit("arxiv:"), K.present(F.col("arxiv_id"))), F.concat(F.lit("doi:"), K.present(F.col("doi"))))
    held = old.select(F.explode(F.array_compact(both)).alias("k"), F.struct("seq", "title", F.col("venue").alias("old_venue")).alias("o")).groupBy("k").agg(F.max("o").alias("o"))
    better = new.select(key.alias("k"), F.col("seq").alias("at"), "venue").where(V.venue_type(F.col("venue"), dim).isin("conference", "workshop", "journal"))
    # The first upgrade of a key is enough: later ones meet a row that is a preprint no more.
    first = better.where("k is not null").groupBy("k").agg(F.min(F.struct("at", "venue")).alias("n"))
    met = first.hint("shuffle_hash").join(held.hint("shuffle_hash"), "k").where(V.venue_type(F.col("o.old_venue"), dim) == "preprint").groupBy("o.seq").agg(F.min(F.struct("n", "o")).alias("b"))
    rows = met.select("seq", F.col("b.o.title").alias("title"), F.col("b.o.old_venue").alias("old_venue"), F.col("b.n.venue").alias("venue"))
    arrow = F.concat(F.lit('"'), F.coalesce("title", F.lit("")), F.lit('": '), F.coalesce("old_venue", F.lit("")), F.lit(" → "), F.col("venue"))
    return rows.select("*", V.venue_type(F.col("venue"), dim).alias("venue_type"), V.peer_reviewed(F.col("venue"), dim).alias("peer_reviewed"), arrow.alias("message"))


def find(df: DataFrame, ids: DataFrame, key: str = "seq") -> DataFrame:
    """(id, key) of all rows that an id (a preprint id, doi or url, column ``id``) names."""
    tag = lambda t, c: F.concat(F.lit(t), K.present(c))
    i, trimmed = F.col("id"), F.trim("id")
    preprint = F.when(trimmed.startswith("http"), K.arxiv_id_from_url(trimmed)).otherwise(K.normalize_arxiv_id(trimmed))
    asked = ids.select(i, F.explode(F.array_compact(F.array(tag("a:", preprint), F.when(trimmed.startswith("10."), tag("d:", trimmed)), tag("u:", trimmed)))).alias("__k"))
    held = df.select(key, F.explode(F.array_compact(F.array(tag("a:", F.col("arxiv_id")), tag("d:", F.col("doi")), tag("u:", F.col("url"))))).alias("__k"))
    return asked.hint("shuffle_hash").join(held, "__k").select("id", key).distinct()


def missing_ids(df: DataFrame, ids: DataFrame, key: str = "seq") -> DataFrame:
    """The ids that name no row."""
    return ids.join(find(df, ids, key).select("id").distinct().hint("shuffle_hash"), "id", "left_anti")


def discard_zero_hits(df: DataFrame, keywords: list[str], text: str = "text", least: int = 1000) -> DataFrame:
    """Rows with a text of ``least`` characters or more and no keyword in it get bucket, reason and reason_detail of a discard; others stay."""
    named = ", ".join(keywords[:5]) + ("..." if len(keywords) > 5 else "")
    gone = F.coalesce((F.length(text) >= least) & ~E.mentions(F.col(text), keywords), F.lit(False))
    detail = F.concat(F.lit("Extracted "), F.length(text).cast("string"), F.lit(f" chars; 0 matches for any of [{named}]."))
    made = {"bucket": F.lit("discarded"), "reason": F.lit("zero_pdf_hits"), "reason_detail": detail}
    return df.withColumns({c: F.when(gone, x).otherwise(F.col(c)) for c, x in made.items()})


def classify(df: DataFrame, keywords: list[str], tool: str, label: Callable[[Column], Column], signal: str = "keyword_fallback") -> DataFrame:
    """Papers (text, abstract, linked_paper_tier) with category, classification_signal, unclassified_reason, band and windows.

    The keyword windows of the text are the evidence, else an abstract that
    mentions a keyword; windows that the filters drop don't count, and where they
    drop all the first one's reason decides. ``label`` gives the category of the
    remaining evidence, joined, and ``signal`` names what gave it.
    """
    own = E.keyword_windows(F.col("text"), keywords)
    told = F.coalesce(F.col("abstract") != "", F.lit(False))
    none = F.filter(own, lambda w: F.lit(False))
    lone = F.array(F.struct(F.lit(0).alias("kw_ord"), F.lit(0).alias("pos"), F.col("abstract").alias("text")))
    out = df.withColumn("__w", own)
    out = out.withColumn("__w", F.when(F.size("__w") > 0, F.col("__w")).when(E.mentions(F.col("abstract"), keywords), lone).otherwise(none))
    out = out.withColumn("__f", E.prefilter(F.col("__w"), tool)).withColumn("__n", F.size("__f.surviving"))
    bare = F.size("__w") == 0
    joined = F.array_join(F.transform("__f.surviving", lambda w: w["text"]), "\n---\n")
    category = F.when(bare, "unclassified").when(F.col("__n") == 0, "referencing").otherwise(label(joined))
    how = F.when(bare & told, "no_keywords").when(bare, "no_evidence").when(F.col("__n") == 0, F.col("__f.signal")).otherwise(signal)
    why = F.when(bare & told, "no_keywords_anywhere").when(bare, "no_evidence_extractable")
    out = out.withColumns({"category": category, "classification_signal": how, "unclassified_reason": why, "windows": F.col("__n")})
    return out.withColumn("band", E.confidence_band(F.col("category"), F.col("classification_signal"), F.col("linked_paper_tier"), F.col("windows"))).drop("__w", "__f", "__n")


_REPLIES = "prompt_hash string, reply string, error string"


def ask(prompts: DataFrame, fn: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """(prompt_hash, reply, error) of ``prompts`` (prompt_hash, prompt); ``fn`` maps a batch of prompts to replies inside the tasks.

    Where it fails on a batch, that batch is asked prompt by prompt, and only
    those that fail alone go without a reply; ``error`` says what was raised.
    """

    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            return fn([prompt])[0], None
        except Exception as e:  # the caller's function: told in ``error``
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked = b["prompt"].tolist()
            try:
                got = [(r, None) for r in (fn(asked) if asked else [])]
                if len(got) != len(asked):
                    raise ValueError(f"{len(got)} replies to {len(asked)} prompts")
            except Exception:  # asked again one by one, where errors are kept
                got = [one(p) for p in asked]
            yield pd.DataFrame({"prompt_hash": b["prompt_hash"], "reply": pd.Series([r for r, _ in got], index=b.index, dtype=object), "error": pd.Series([e for _, e in got], index=b.index, dtype=object)})

    return prompts.select("prompt_hash", "prompt").mapInPandas(run, _REPLIES)


def with_labels(df: DataFrame, prompt: Column, fn: Callable[[list[str]], list[str | None]], labels: list[str], rule: Column, needs: Column | None = None, replies: str | None = None) -> DataFrame:
    """``df`` with category, unclassified_reason, classification_signal and label_error from a labeller.

    Each distinct prompt of the rows of which ``needs`` holds is asked once; where
    ``fn`` fails or gives no reply, ``rule`` decides (signal keyword_fallback).
    Replies are kept in the table at ``replies``, if it is given, and not asked
    for again by later runs; prompts that failed are. Other rows get nulls.
    """
    asked = df.withColumn("__prompt", prompt if needs is None else F.when(needs, prompt)).withColumn("__hash", F.sha2("__prompt", 256))
    distinct = asked.where("__prompt is not null").groupBy(F.col("__hash").alias("prompt_hash")).agg(F.first("__prompt").alias("prompt"))
    known = None
    if replies is not None and versions.latest(df.sparkSession, replies):
        known, _ = versions.read_version(df.sparkSession, replies)
        distinct = distinct.hint("shuffle_hash").join(known.select("prompt_hash").hint("shuffle_hash"), "prompt_hash", "left_anti")
    told = written(ask(distinct, fn))
    if known is not None:
        told = written(told.unionByName(known))
    if replies is not None:
        versions.write_version(told.where("error is null"), replies)
    met = asked.join(told.select(F.col("prompt_hash").alias("__hash"), F.col("reply").alias("__reply"), F.col("error").alias("label_error")).hint("shuffle_hash"), "__hash", "left")
    out = met.withColumn("__l", E.parse_label(F.col("__reply"), labels))
    given = F.col("__prompt").isNotNull()
    made = {"category": F.coalesce("__l.category", F.when(given, rule)), "unclassified_reason": F.col("__l.reason"), "classification_signal": F.when(F.col("__l").isNotNull(), "llm").when(given, "keyword_fallback")}
    return out.withColumns(made).drop("__prompt", "__hash", "__reply", "__l")


# The form of a caption, and of the number in it.
CAPTION = r"(?i)(?:^|\n)(Figure\s+\d+[:.]?\s*[^\n]{0,150}|Fig\.?\s+\d+[:.]?\s*[^\n]{0,150})"
CAPTION_NUMBER = r"(?i)^Fig(?:ure|\.)?\s+(\d+)"


def captions(pages: DataFrame, key: str) -> DataFrame:
    """(key, page_num, ord, figure_num, caption, score) of each figure caption of a page's ``text``, in order."""
    rows = pages.select(key, "page_num", F.posexplode(F.regexp_extract_all("text", F.lit(CAPTION), F.lit(1))).alias("ord", "__c"))
    rows = rows.select(key, "page_num", "ord", F.regexp_replace("__c", r"^\s+|\s+$", "").alias("caption"))
    rows = rows.withColumn("figure_num", F.regexp_extract("caption", CAPTION_NUMBER, 1).try_cast("int"))
    return rows.where("figure_num is not null").select("*", E.caption_score(F.col("caption"), F.col("page_num"), F.col("figure_num")).alias("score"))
