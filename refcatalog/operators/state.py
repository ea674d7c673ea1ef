"""The curated state over runs: upserts, field updates, buckets, edits, reclassification and its output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import evidence as E
from ..functions import keys as K
from ..functions import venues as V
from ..plans.tables import written
from . import versions
from .enrich import TRUSTED_YEARS
from .entities import diff
from .moves import folded
from .similar import dedup

FILLED = ["affiliations", "abstract", "pdf_url", "doi", "arxiv_id", "s2_paper_id", "openalex_id"]


def apply_updates(old: DataFrame, new: DataFrame, dim: list[V.Venue], on: str = "seq") -> DataFrame:
    """Old papers (key ``seq``) with what new rows (``matched``, own ``seq``) bring, and ``changed``.

    ``matched`` is a value of the old papers' column ``on``. Where several old papers
    share it, the new rows are brought together once and all of them get the result,
    so rows are never paired.

    Overrides stay as they are. Longer authors win, and empty fields are filled by
    the first value in order. Venue and year follow the rows one by one: a venue is
    taken, a placeholder tidies a confident venue with the year held by then and
    replaces any other; trusted years are taken, others fill. That order is kept
    by ``moves.folded``, the rest is one aggregation by partial minima and maxima,
    so many rows of one paper meet nowhere. Where old has ``venue_type`` and
    ``peer_reviewed``, they follow a venue taken over; a venue that is only tidied
    takes its type alone. A row without a source leaves the source. ``changed``
    says whether a paper differs in the end.
    """
    at, v = F.col("seq"), K.present(F.col("venue"))
    new = new.where("matched is not null")
    junk, real = v.isNotNull() & V.is_preprint(F.col("venue")), v.isNotNull() & ~V.is_preprint(F.col("venue"))
    first = lambda c: F.min_by(F.col(c), F.when(K.present(F.col(c)).isNotNull(), at)).alias(f"__{c}")
    dated = F.when(F.coalesce("year", F.lit(0)) > 0, F.col("year"))
    moves = folded(new.select("matched", "seq", F.when(real, v).alias("real"), F.when(junk, v).alias("junk"), dated.alias("year"), F.when(F.col("venue_source").isin(*TRUSTED_YEARS), dated).alias("trusted")))
    reviewed = F.when(real & V.venue_type(v, dim).isin("conference", "workshop", "journal"), v)
    brought = new.groupBy("matched").agg(
        *(first(c) for c in FILLED),
        F.max(F.when(K.present(F.col("authors")).isNotNull(), F.struct(F.length("authors").alias("n"), (-at).alias("o"), F.col("authors").alias("v")))).alias("__authors"),
        F.max_by("venue_source", F.when(K.present(F.col("venue_source")).isNotNull(), at)).alias("__source"),
        *(f(c).alias(n) for n, f, c in (("__a", F.min, F.when(real, v)), ("__z", F.max, F.when(real, v)), ("__ra", F.min, reviewed), ("__rz", F.max, reviewed))),
    )
    told = moves.select("matched", F.struct(*(c for c in moves.columns if c != "matched")).alias("__m"))
    # Papers without a value meet nothing, wherever they are; so they are dealt out.
    place = F.col(on) if on == "seq" else F.coalesce(F.col(on), F.concat(F.lit("\0"), F.col("seq")))
    met = old.withColumn("__on", place).join(brought.withColumnRenamed("matched", "__on").hint("shuffle_hash"), "__on", "left").join(told.withColumnRenamed("matched", "__on").hint("shuffle_hash"), "__on", "left").drop("__on")
    touched, m = F.col("__met"), lambda c: F.col(f"__m.{c}")
    met = met.withColumn("__met", ~F.coalesce("manual_override", F.lit(False)))
    held = F.when(F.coalesce("year", F.lit(0)) > 0, F.col("year"))
    base, later = F.coalesce(m("real"), F.col("venue")), F.coalesce(m("met"), F.lit(False))
    # The year held at the first placeholder after the venue, or at the first one that had any.
    by_then = F.coalesce(m("met_trusted"), held, m("met_year"), F.when(m("dated"), F.coalesce(m("dated_trusted"), m("dated_year"))))
    tidy = F.coalesce(K.present(V.normalize_venue(base, by_then, dim)), base)
    sure = V.is_confident(F.coalesce(base, F.lit("")), dim)
    values = {
        "authors": F.when(F.col("__authors.n") > F.length(F.coalesce("authors", F.lit(""))), F.col("__authors.v")).otherwise(F.col("authors")),
        "venue": F.when(later & sure, tidy).when(later, m("junk")).otherwise(base),
        "year": F.coalesce(m("trusted"), held, m("year"), F.col("year")),
        **{c: F.coalesce(K.unless_blank(F.col(c)), F.col(f"__{c}"), F.col(c)) for c in FILLED},
    }
    after = F.struct(*(F.when(touched, x).otherwise(F.col(c)).alias(c) for c, x in values.items()))
    met = met.withColumn("__after", after)
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__after.{c}"))
    source = F.when(touched, F.coalesce("__source", "venue_source")).otherwise(F.col("venue_source"))
    other = lambda a, z: F.coalesce((F.col(a) != F.coalesce("venue", F.lit(""))) | (F.col(z) != F.coalesce("venue", F.lit(""))), F.lit(False))
    brings = F.when(later & ~sure, m("junk")).otherwise(m("real"))
    taken = touched & (other("__a", "__z") | F.coalesce(brings != F.coalesce("venue", F.lit("")), F.lit(False)))
    kind = V.venue_type(brings, dim)
    tidied = touched & later & sure & ~F.col("venue").eqNullSafe(F.col("__after.venue"))
    follows = {"venue_type": F.when(tidied, V.once(F.col("__after.venue"), lambda v: V.venue_type(v, dim))).when(taken, kind).otherwise(F.col("venue_type")), "peer_reviewed": (touched & other("__ra", "__rz")) | (taken & kind.isin("conference", "workshop", "journal")) | F.col("peer_reviewed")}
    met = met.withColumns({c: x for c, x in follows.items() if c in old.columns}).withColumn("changed", differs).withColumn("venue_source", source)
    return met.select(*(F.col(f"__after.{c}").alias(c) if c in values else F.col(c) for c in old.columns), "changed")


def merge_papers(old: DataFrame, new: DataFrame, dim: list[V.Venue], percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(merged, stats): in order, each new paper updates the paper of its preprint id, else doi (of several old ones the last), else the first one of a similar title; the others join, and later ones may update them.

    ``seq`` orders both; new ones follow the old. Without old papers all new ones join as they are. merged has ``changed`` and ``added``.
    """
    ids = ["arxiv_id", "doi"]
    named = lambda df: df.select("seq", "title", *ids)
    if old.limit(1).count():
        leaders = written(dedup(named(old).unionByName(named(new)), ids, percent=percent, seeds=old.select("seq")))
        met = new.hint("shuffle_hash").join(leaders.hint("shuffle_hash"), "seq")
    else:
        met = new.withColumn("leader", F.col("seq"))
    fresh = met.where("seq = leader").drop("leader").withColumn("added", F.lit(True))
    base = old.withColumn("added", F.lit(False)).unionByName(fresh, allowMissingColumns=True)
    merged = written(apply_updates(base, met.where("seq <> leader").withColumnRenamed("leader", "matched"), dim))
    stats = merged.agg(F.count_if(~F.col("added")).alias("existing"), F.count_if("added").alias("new"), F.count_if(F.col("changed") & ~F.col("added")).alias("updated"), F.count(F.lit(1)).alias("total"))
    return merged, stats


def decided() -> Column:
    c = F.col
    named = F.coalesce(K.present(c("arxiv_id")), K.present(c("doi"))).isNotNull()
    return E.decide_bucket(c("year"), K.usable_abstract(c("abstract")), named, c("category"), c("unclassified_reason"), c("category_confidence_band"))


def rebucket(df: DataFrame) -> DataFrame:
    """Papers with bucket and reason decided anew unless overridden, and ``moved``: promoted, demoted or null. Detail goes with a promotion."""
    out = df.withColumn("__d", decided())
    moves = ~F.coalesce("manual_override", F.lit(False)) & ~F.col("bucket").eqNullSafe(F.col("__d.bucket"))
    moved = F.when(moves & (F.col("bucket") == "pending"), "promoted").when(moves & (F.col("bucket") == "verified"), "demoted")
    swap = lambda new, old: F.when(moves, new).otherwise(F.col(old))
    detail = F.when(moves & (F.col("__d.bucket") == "verified"), F.lit(None)).otherwise(F.col("reason_detail"))
    both = out.select("*", moved.alias("moved"), swap(F.col("__d.bucket"), "bucket").alias("__b"), swap(F.col("__d.reason"), "reason").alias("__r"), detail.alias("__x"))
    return both.drop("__d", "bucket", "reason", "reason_detail").withColumnsRenamed({"__b": "bucket", "__r": "reason", "__x": "reason_detail"})


def carry_curated(decisions: DataFrame) -> DataFrame:
    """Rows (``route`` and the old row as struct ``old``) with what a curator set.

    protected: bucket, category, reason, detail and description of the old row, and
    its ids where missing. fill_gaps of an override: every curated field of the old
    row that is present, and the decision on it. Other rows stay.
    """
    c, o = F.col, lambda n: F.col(f"old.{n}")
    protected = (c("route") == "protected") & c("old").isNotNull()
    curated = (c("route") == "fill_gaps") & F.coalesce(o("manual_override"), F.lit(False))
    out = {n: F.when(protected | curated, o(n)).otherwise(c(n)) for n in ("bucket", "category", "reason", "reason_detail")}
    out["description"] = F.when(protected, o("description")).when(curated, F.coalesce(K.unless_blank(o("description")), c("description"))).otherwise(c("description"))
    out |= {n: F.when(protected, F.coalesce(K.unless_blank(c(n)), o(n))).otherwise(c(n)) for n in ("s2_paper_id", "openalex_id")}
    out |= {n: F.when(curated, F.coalesce(K.unless_blank(o(n)), c(n))).otherwise(c(n)) for n in ("title", "authors", "affiliations", "venue", "image", "project_url", "url", "pdf_url")}
    out["year"] = F.when(curated & (o("year") > 0), o("year")).otherwise(c("year"))
    out["manual_override"] = curated | F.coalesce("manual_override", F.lit(False))
    return decisions.select(*(out.get(n, c(n)).alias(n) for n in decisions.columns if n != "old"))


TEXT, OPTIONAL = ["title", "authors", "affiliations", "venue", "description", "url"], ["pdf_url", "project_url", "image", "reason_detail", "abstract"]
# What the listed fields may hold.
CHOICES = {"category": ["uses_infrastructure", "uses_library", "referencing", "unclassified"], "bucket": ["pending", "verified", "discarded"]}
YES, NO = ["y", "yes", "true", "t", "1"], ["n", "no", "false", "f", "0"]
EDITABLE = [*TEXT, *OPTIONAL, *CHOICES, "year", "reason", "peer_reviewed"]


def edit_changes(before: DataFrame, after: DataFrame, key: str = "seq") -> DataFrame:
    """(key, field, old, new) of what edits changed in the editable fields."""
    return diff(before, after, key, [c for c in EDITABLE if c in before.columns])


def apply_edits(state: DataFrame, edits: DataFrame, key: str = "seq", reasons: list[str] | None = None) -> DataFrame:
    """State with typed edits (key, field, value, ord) applied; edited rows are frozen, their flags derived and, unless the bucket was edited, decided anew.

    Of several edits of a field the last by ``ord`` counts. Unknown fields and values
    that don't fit a field's type are errors. Null counts as empty text.
    """
    field = F.lower(F.trim("field"))
    known = F.when(field.isin(*EDITABLE), field).otherwise(F.raise_error(F.concat(F.lit("not editable: "), F.coalesce("field", F.lit("null")))))
    last = edits.groupBy(key, known.alias("f")).agg(F.max_by(F.coalesce("value", F.lit("")), "ord").alias("v"))
    listed = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("f", "v"))).alias("__e"))  # at most one entry a field
    out = state.join(listed, key, "left")
    wrong = lambda f, v: F.raise_error(F.concat(F.lit(f"bad {f}: "), v))

    def parsed(f: str) -> Column:
        v = F.col("__e")[f]
        low = F.lower(F.trim(v))
        if f in OPTIONAL:
            return K.present(v)
        if f in CHOICES:
            return F.when(low.isin(*CHOICES[f]), low).otherwise(wrong(f, v))
        if f == "year":
            return F.coalesce(F.trim(v).try_cast("int"), wrong(f, v).cast("int"))
        if f == "peer_reviewed":
            return F.when(low.isin(*YES), True).when(low.isin(*NO), False).when(low == "", F.lit(None)).otherwise(wrong(f, v).cast("boolean"))
        if f == "reason":
            named = F.when(low.isin("", "none"), F.lit(None))
            return named.otherwise(low) if reasons is None else named.when(low.isin(*reasons), low).otherwise(wrong(f, v))
        return v

    has = lambda f: F.coalesce(F.map_contains_key("__e", F.lit(f)), F.lit(False))
    touched, moved = F.col("__e").isNotNull(), has("bucket")
    out = out.select(*((F.when(has(c), parsed(c)).otherwise(F.col(c)) if c in EDITABLE else F.col(c)).alias(c) for c in state.columns), touched.alias("__t"), moved.alias("__b"))
    flags = {"has_summary": K.present(F.col("description")).isNotNull(), "has_classification": F.coalesce(F.col("category") != "unclassified", F.lit(False)), "has_thumbnail": K.present(F.col("image")).isNotNull(), "has_affiliations": K.present(F.col("affiliations")).isNotNull(), "manual_override": F.lit(True)}
    out = out.withColumn("__d", decided())
    again = F.col("__t") & ~F.col("__b") & ~F.col("bucket").eqNullSafe(F.col("__d.bucket"))
    values = {c: F.when(F.col("__t"), x).otherwise(F.col(c)) for c, x in flags.items()} | {c: F.when(again, F.col(f"__d.{c}")).otherwise(F.col(c)) for c in ("bucket", "reason")}
    return out.select(*(values.get(c, F.col(c)).alias(c) for c in state.columns))


def reclassify(state: DataFrame, verdicts: DataFrame, ids: list | None = None, key: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(state, changes): new category and band of verdicts (key, category, category_confidence_band), of all rows or ``ids``; overrides stay. changes lists (key, field, old, new)."""
    fields = ["category", "category_confidence_band"]
    now = verdicts.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    both = state.join(now, key, "left")
    free = ~F.coalesce("manual_override", F.lit(False)) & F.col("__category").isNotNull()
    if ids is not None:
        free = free & F.col(key).isin(*ids)
    out = {f: F.when(free, F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}
    out["has_classification"] = F.when(free, F.col("__category") != "unclassified").otherwise(F.col("has_classification"))
    after = both.select(*(out.get(c, F.col(c)).alias(c) for c in state.columns))
    return after, diff(state, after, key, fields)


# The columns of the sheets.
PAPER_SHEET = ["title", "authors", "affiliations", "venue", "year", "url", "pdf_url", "project_url", "description", "category", "peer_reviewed", "venue_type", "arxiv_id", "doi", "date_discovered", "category_confidence", "source", "manual_override"]
PENDING_SHEET = ["title", "authors", "venue", "year", "url", "category", "reason", "reason_detail", "arxiv_id", "doi", "source", "manual_override"]
DISCARDED_SHEET = ["title", "authors", "venue", "year", "url", "reason", "reason_detail", "arxiv_id", "doi", "source", "manual_override"]
REPO_SHEET = ["owner", "repo", "url", "description", "stars", "forks", "last_commit", "first_seen", "language", "license", "topics", "linked_paper_url", "linked_paper_tier", "readme_arxiv_ids", "category", "repo_type", "parent_full_name", "archived", "is_fork", "classification_reason", "manual_override"]
SHEETS = {"papers": ("verified", PAPER_SHEET), "pending": ("pending", PENDING_SHEET), "discarded": ("discarded", DISCARDED_SHEET), "repos": (None, REPO_SHEET)}


def sheet(df: DataFrame, name: str) -> DataFrame:
    """The rows and columns of a sheet: lists joined, confidence with two decimals, missing text empty. Missing columns are empty."""
    bucket, columns = SHEETS[name]
    kinds = {f.name: f.dataType.typeName() for f in df.schema}

    def cell(c: str) -> Column:
        if c not in kinds:
            return F.lit("")
        if c == "category_confidence":
            return F.format_string("%.2f", F.col(c).cast("double"))
        if kinds[c] == "array":
            return F.coalesce(F.array_join(c, ", "), F.lit(""))
        return F.coalesce(c, F.lit("")) if kinds[c] == "string" else F.col(c)

    return (df if bucket is None else df.where(F.col("bucket") == bucket)).select(*(cell(c).alias(c) for c in columns))


def write_sheets(papers: DataFrame, repos: DataFrame, folder: str) -> list[str]:
    """All sheets as CSV with a header, one folder each below ``folder``; gives their names. Text is quoted where it has to be, line breaks included."""
    for name in SHEETS:
        sheet(repos if name == "repos" else papers, name).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder.rstrip('/')}/{name}")
    return list(SHEETS)


STATE_KEYS = ["bucket", "title", "source"]
BUCKETS = ["pending", "verified", "discarded"]


def write_state(df: DataFrame, path: str, based_on: int | None = None) -> int:
    """The whole state as the next version of ``path``, by bucket, and its number; ``df`` may be read from there. See ``versions``."""
    return versions.write_version(df, path, based_on, ["bucket"])


def checked(items: DataFrame, kind: StructType, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of items, JSON texts in column ``item`` beside others.

    Rows have the fields of ``kind``. An item that isn't of that form, or that
    lacks a ``needed`` field, goes to rejects, with ``item`` and ``reason``.
    """
    bad = "__unread"
    form = StructType([*kind.fields, StructField(bad, StringType())])
    read = items.withColumn("__row", F.from_json("item", form, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    why = F.when(F.col("__row").isNull() | F.col(f"__row.{bad}").isNotNull(), "not of the declared form")
    for c in needed:
        why = why.when(K.present(F.col(f"__row.{c}").cast("string")).isNull(), f"no {c}")
    read = read.withColumn("reason", why)
    others = [c for c in items.columns if c != "item"]
    rows = read.where("reason is null").select(*(F.col(f"__row.{c}").alias(c) for c in kind.names), *(c for c in others if c not in kind.names))
    return rows, read.where("reason is not null").select(*others, "item", "reason")


def state_items(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, item) of a JSON document with a list of papers for each bucket; a flat list or a missing bucket is an error."""
    whole = spark.read.option("multiLine", True).schema(", ".join(f"{b} array<string>" for b in BUCKETS)).option("mode", "FAILFAST").json(path)
    lists = whole.select(*(F.when(F.col(b).isNull(), F.raise_error(F.lit(f"{path} has no {b}: not a state by buckets"))).otherwise(F.col(b)).alias(b) for b in BUCKETS))
    each = [lists.select(F.lit(b).alias("bucket"), F.explode(b).alias("item")) for b in BUCKETS]
    return each[0].unionByName(each[1]).unionByName(each[2])


def read_checked_state(spark: SparkSession, path: str, kind: StructType) -> tuple[DataFrame, DataFrame]:
    """(papers, rejects) of a JSON state against a declared form: rejects are (bucket, item, reason)."""
    return checked(state_items(spark, path), kind, ["title"])


def read_checked_repos(spark: SparkSession, path: str, kind: StructType) -> tuple[DataFrame, DataFrame]:
    """(repos, rejects) of JSON lines or one JSON list of repos against a declared form."""
    items = spark.read.text(path, wholetext=True).select(F.explode(F.coalesce(F.from_json("value", "array<string>"), F.split(F.trim("value"), "\\s*\n\\s*"))).alias("item"))
    return checked(items, kind, ["owner", "repo"])


def read_state(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """The latest version of a state, a plain parquet table, or (``form`` json) one document with a list of papers for each bucket.

    A flat list, a missing bucket or a missing column is an error; papers without a title are left out.
    """
    if form == "json":
        whole = spark.read.option("multiLine", True).json(path)
        lacking = [b for b in BUCKETS if b not in whole.columns]
        if lacking:
            raise ValueError(f"{path} has no {', '.join(lacking)}: not a state by buckets")
        each = [whole.select(F.inline(b)).withColumn("bucket", F.lit(b)) for b in BUCKETS if whole.schema[b].dataType.typeName() == "array" and whole.schema[b].dataType.elementType.typeName() == "struct"]
        if not each:
            return spark.createDataFrame([], "title string, source string, bucket string")
        state = each[0]
        for x in each[1:]:
            state = state.unionByName(x, allowMissingColumns=True)
    else:
        state = versions.read_version(spark, path)[0] if versions.latest(spark, path) else spark.read.parquet(path)
    lacking = [c for c in STATE_KEYS if c not in state.columns]
    if lacking:
        raise ValueError(f"{path} has no column {', '.join(lacking)}")
    return state.where(K.present(F.col("title")).isNotNull())


def read_repo_state(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of the repos; those without owner or name are left out."""
    repos, _ = versions.read_version(spark, path)
    return repos.where(K.present(F.col("owner")).isNotNull() & K.present(F.col("repo")).isNotNull())


# The public fields of a repo.
PUBLIC_REPO = ["owner", "repo", "url", "description", "stars", "forks", "last_commit", "language", "linked_paper_url", "is_course", "is_fork", "parent_full_name"]


def public_repos(repos: DataFrame) -> DataFrame:
    """The public fields of repos; ``is_course`` follows from ``repo_type`` and is false where that is missing. Fields not landed are null."""
    made = {"is_course": F.coalesce(F.col("repo_type") == "course", F.lit(False)), "last_commit": F.col("last_commit").cast("string")}
    return repos.select(*((made[c] if c in made else F.col(c) if c in repos.columns else F.lit(None).cast("string")).alias(c) for c in PUBLIC_REPO))


def write_repo_state(repos: DataFrame, path: str, based_on: int | None = None) -> int:
    """All repos with every field as the next version of ``path``, and its number."""
    return versions.write_version(repos, path, based_on)


def trace(state: DataFrame, texts: DataFrame, keywords: list[str], key: str = "seq") -> DataFrame:
    """(key, section, name, value): per record its ids, tier, text length, hits of each keyword in text and abstract, and the verdict held. Absent texts have length 0."""
    both = state.join(texts.select(key, F.col("text").alias("__text")), key, "left")
    count = lambda c, k: F.coalesce(E.keyword_count(F.col(c), k), F.lit(0)).cast("string")
    row = lambda s, n, v: F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), v.alias("value"))
    rows = [row("ids", c, F.col(c).cast("string")) for c in ("arxiv_id", "doi", "linked_paper_tier")]
    rows.append(row("text", "length", F.coalesce(F.length("__text"), F.lit(0)).cast("string")))
    rows += [row(s, k, count(c, k)) for s, c in (("text", "__text"), ("abstract", "abstract")) for k in keywords]
    rows += [row("verdict", c, F.col(c)) for c in ("category", "category_confidence_band")]
    return both.select(key, F.inline(F.array(*rows)))
