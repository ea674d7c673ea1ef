"""URL rules by host suffix and path prefix, matched on short hash prefixes and confirmed on full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this many are sent to every executor (about 200 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 200_000
#: Hex digits of the digest on which candidates are joined.
SHORT = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_after(url), "/", 1))
    return F.coalesce(F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    whole = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    return F.coalesce(F.when((F.instr(url, "://") > 0) & F.contains(whole, F.lit("/")), whole.substr(F.instr(whole, "/"), F.length(whole))), F.lit(""))


def _after(url: Column) -> Column:
    return url.substr(F.instr(url, "://") + 3, F.length(url))


def _key(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``.

    rules: host, path, verdict. A rule fits its host and all subdomains if the
    url's path starts with the rule's; of several the one with the longest host
    and path wins, then the one with the longer host, then the later verdict by name. Without a
    rule the verdict is ``default``. Each url is expanded into its host suffixes
    (at most as many labels as a rule has) times its path prefixes (of the
    lengths that rules have); these join the rules on ``SHORT`` digits of a
    digest, and the full digest decides. Null urls and urls without ``://`` have
    empty host and path, which fit no rule with a host. Repeated pages are
    judged each; extra columns are left out; empty tables give empty or default
    results.
    """
    facts = rules.where("host is not null and path is not null").select("host", "path", "verdict").distinct()
    shape = facts.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("host", "\\."))).alias("labels")).first()
    n, labels = shape["n"], shape["labels"] or 1
    lengths = facts.select(F.length("path").alias("n")).distinct().agg(F.sort_array(F.collect_list("n"))).first()[0]  # at most one per length
    facts = facts.select(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_size"), _key(F.col("host"), F.col("path")).alias("full"))
    facts = facts.withColumn("short", F.substring("full", 1, SHORT))

    urls = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), F.monotonically_increasing_id().alias("row"))
    parts = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths or [0])), lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    each = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _key(h, p))))
    open_ = urls.select("*", F.explode_outer(each).alias("expression")).withColumn("short", F.substring("expression", 1, SHORT))
    met = open_.join(facts.hint("broadcast" if n <= BROADCAST_RULES else "shuffle_hash"), "short", "left")
    met = met.withColumn("fit", F.when(F.col("expression") == F.col("full"), F.struct(F.length("rule").alias("size"), "host_size", F.col("verdict").alias("verdict"), F.col("rule").alias("rule"))))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max("fit").alias("fit"))
    return best.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))
