"""Resumable ingestion of landed pages, consolidated once a listing is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A landed page: its listing and number, where the next one is (null on the last), and what it lists.
PAGE = "listing string, page int, next_url string, items array<struct<name: string, url: string>>"
_DONE = "listing string, pages long, items long"


def _read(spark: SparkSession, folder: str, schema: str, but: int) -> DataFrame:
    """All batches in ``folder`` other than number ``but``, with ``batch``; none before the first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").parquet(folder).where(F.col("batch") != but)


def complete_listings(pages: DataFrame) -> DataFrame:
    """(listing, pages) of listings whose pages from 0 on are all there, up to one without a next page; a page landed twice counts once."""
    ends = F.max(F.when(F.col("next_url").isNull(), F.col("page")))
    told = pages.select("listing", "page", "next_url").distinct().groupBy("listing").agg(F.count_distinct("page").alias("pages"), F.min("page").alias("first"), F.max("page").alias("last"), ends.alias("end"))
    return told.where("first = 0 and pages = last + 1 and end = last").select("listing", "pages")


def consolidate(spark: SparkSession, sink: str, batch_id: int) -> None:
    """Listings that became complete go to ``listings``, each item of a page once, and then to ``manifest``; done again for a batch it gives the same."""
    pages = _read(spark, f"{sink}/pages", PAGE, -1)
    before = _read(spark, f"{sink}/manifest", _DONE, batch_id).select("listing")
    fresh = complete_listings(pages).join(before.hint("shuffle_hash"), "listing", "left_anti")
    first = pages.groupBy("listing", "page").agg(F.min_by("items", "batch").alias("items"))
    rows = first.join(fresh.select("listing").hint("shuffle_hash"), "listing").select("listing", "page", F.posexplode("items").alias("place", "item")).select("listing", "page", "place", "item.*")
    rows.write.mode("overwrite").parquet(f"{sink}/listings/batch={batch_id}")
    own = spark.read.schema("listing string").parquet(f"{sink}/listings/batch={batch_id}").groupBy("listing").agg(F.count(F.lit(1)).alias("items"))
    done = fresh.hint("shuffle_hash").join(own.hint("shuffle_hash"), "listing", "left").select("listing", "pages", F.coalesce("items", F.lit(0)).alias("items"))
    done.write.mode("overwrite").parquet(f"{sink}/manifest/batch={batch_id}")


def ingest_pages(spark: SparkSession, source: str, sink: str, checkpoint: str, files: int = 1000) -> None:
    """Every page file of ``source`` that no earlier run has taken, in micro-batches of up to ``files``; returns when none is left.

    A batch is written under its own number before its listings are consolidated,
    so that a batch that failed half-way and is run again changes nothing. Listings
    that lack a page stay in ``pages`` until it lands.
    """

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/pages/batch={number}")
        consolidate(batch.sparkSession, sink, number)

    rows = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files).json(source)
    rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def listings(spark: SparkSession, sink: str) -> DataFrame:
    """(listing, page, place, name, url) of all complete listings that the manifest names."""
    rows = _read(spark, f"{sink}/listings", "listing string, page int, place int, name string, url string", -1)
    done = _read(spark, f"{sink}/manifest", _DONE, -1).select("listing", "batch")
    return rows.join(done.hint("shuffle_hash"), ["listing", "batch"]).drop("batch")
