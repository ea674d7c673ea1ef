"""Counts, rankings and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import slug


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of each combination, null as ``unknown``."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in columns]
    return df.groupBy(*named).agg(F.count(F.lit(1)).alias("n"))


def head_with_rest(df: DataFrame, group: str, order: list, n: int = 15) -> DataFrame:
    """The first ``n`` rows of each group (a top-n report) with their position and the number of rows beyond."""
    place = Window.partitionBy(group).orderBy(*order)
    total = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    top = df.withColumn("position", F.row_number().over(place)).where(F.col("position") <= n)
    return top.join(total, group).withColumn("more", F.greatest(F.col("__n") - n, F.lit(0))).drop("__n")


def listing(df: DataFrame, n: int | None = None) -> DataFrame:
    """Papers, newest first, then by title; the first ``n`` of them if that is given (a top-n report)."""
    rows = df.orderBy(F.desc_nulls_last("year"), F.lower("title"), "seq")
    return rows if n is None else rows.limit(n)


def repo_listing(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("stars"), F.lower("owner"), F.lower("repo"))


def low_confidence(df: DataFrame) -> DataFrame:
    """Classified papers of the state whose confidence is low or medium."""
    return df.where(F.col("category_confidence_band").isin("low", "medium") & (F.col("category") != "unclassified"))


def public_papers(df: DataFrame) -> DataFrame:
    """The public fields of verified papers; image and project_url are null where they are empty, and so left out by a JSON writer."""
    blank = lambda c: (F.nullif(F.col(c), F.lit("")) if c in df.columns else F.lit(None).cast("string")).alias(c)
    return df.where("bucket = 'verified'").select("title", "authors", "venue", "year", "url", "description", "category", blank("image"), blank("project_url"))


def bucket_report(df: DataFrame, categories: list[str]) -> DataFrame:
    """(bucket, part, name, n): of each bucket all rows, those of each listed category if it is verified, and else those of each reason (null as ``unknown``)."""
    row = lambda part, name: F.struct(F.lit(part).alias("part"), name.cast("string").alias("name"))
    verified = F.col("bucket") == "verified"
    told = F.when(verified & F.col("category").isin(*categories), row("category", F.col("category"))).when(~verified, row("reason", F.coalesce("reason", F.lit("unknown"))))
    each = df.select("bucket", F.inline(F.array_compact(F.array(row("all", F.lit("all")), told))))
    return each.groupBy("bucket", "part", "name").agg(F.count(F.lit(1)).alias("n"))


def repo_report(repos: DataFrame, removals: DataFrame | None = None, parts: tuple[str, ...] = ("category", "route", "classification_reason", "repo_type")) -> DataFrame:
    """(part, name, n): repos in all, by each of ``parts``, and removals (reason, n); one pass of partial counts. Null counts as ``unknown``."""
    row = lambda part, name: F.struct(F.lit(part).alias("part"), name.cast("string").alias("name"))
    each = [row("all", F.lit("all")), *(row(c, F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for c in parts if c in repos.columns)]
    out = repos.select(F.inline(F.array(*each))).groupBy("part", "name").agg(F.count(F.lit(1)).alias("n"))
    return out if removals is None else out.unionByName(removals.select(F.lit("removed").alias("part"), F.col("reason").alias("name"), "n"))


def reconcile_files(df: DataFrame, listing: DataFrame, folder: str = "/images/") -> DataFrame:
    """Rows with ``image`` of the file named after their title, where the listing (name) has it; ``missing`` marks the others, whose image stays."""
    there = listing.select(F.col("name").alias("__file")).distinct()
    met = df.withColumn("__want", F.concat(slug(F.col("title")), F.lit(".png"))).join(there, F.col("__want") == F.col("__file"), "left")
    found = F.col("__file").isNotNull()
    image = F.when(found, F.concat(F.lit(folder), F.col("__want"))).otherwise(F.col("image") if "image" in df.columns else F.lit(None))
    return met.select(*(c for c in df.columns if c != "image"), image.alias("image"), (~found).alias("missing"))


def pages_with_figures(pages: DataFrame, drawings: int = 20) -> DataFrame:
    """Pages with ``drawings`` drawings or more, or an image: only these give a document its best caption."""
    return pages.where((F.coalesce("n_drawings", F.lit(0)) >= drawings) | (F.coalesce("n_images", F.lit(0)) > 0))


def best_caption(pages: DataFrame, key: str) -> DataFrame:
    """Of each document the best caption with a score above 0; the earliest page of equals, by partial maxima."""
    best = pages.where("score > 0").groupBy(key).agg(F.max(F.struct(F.col("score"), (-F.col("page_num")).alias("p"), (-F.col("ord")).alias("o"), F.col("caption"))).alias("b"))
    return best.select(key, F.col("b.caption").alias("caption"), (-F.col("b.p")).alias("page_num"), F.col("b.score").alias("score"))


def run_metrics(found: DataFrame, state: DataFrame, sources: list[str]) -> DataFrame:
    """One row: ``<source>_found`` of the found rows, and of the merged state (added, changed, image) its total, new, updated and existing rows and its thumbnails; one pass, partial sums only."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    none = F.lit(None).cast("boolean")
    a = found.select("source", none.alias("added"), none.alias("changed"), none.alias("pictured"))
    b = state.select(F.lit(None).cast("string").alias("source"), flag(F.col("added")).alias("added"), flag(F.col("changed")).alias("changed"), flag(F.col("image") != "").alias("pictured"))
    added, changed, pictured = F.col("added"), F.col("changed"), F.col("pictured")
    counts = {"total": added.isNotNull(), "new": added, "updated": changed & ~added, "existing": ~added, "thumbnails": pictured, "thumbnails_missing": ~pictured}
    return a.unionByName(b).agg(*(F.count_if(F.col("source") == s).alias(f"{s}_found") for s in sources), *(F.count_if(c).alias(n) for n, c in counts.items()))
