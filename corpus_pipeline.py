"""The corpus pipeline: documents in, packed sequences out, one operator a stage.

Rejected documents, copies and contaminated passages go; secrets are masked; what
is left is packed. Each stage works on all its predecessor kept, with all columns.

In every stage null and empty texts are documents without words: they are scored
like others, are no copies of anything, hold no passages or secrets, and are packed
as one end token. Null ids stay; repeated rows are copies, of which one stays; ties
are told apart by the smallest id; columns may have any names; and an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refcatalog.llm import decontam, near_dup, packing, quality, secrets
from refcatalog.llm.queries import tokenizer_path
from refcatalog.llm.shared import cut, table

#: SQL can't express the trained classifiers; tests/llm runs the stages on small texts with known results, on whole small tables, and on odd and empty ones.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers keep."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id; repeated rows count as copies. Rows without an id or without words stay."""
    return near_dup.keep(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly such passages go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_coverage=0.5, window=10)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked; n_chars follows."""
    masked = secrets.redact(docs, secrets.train(docs))
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 2048, 0)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the packed pieces of what they keep."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
