"""A text of 20 MB, whole, beside ordinary ones."""

import random

import pytest
from pyspark.sql import functions as F

from refcatalog.llm import decontam, quality, secrets, token_count, toxicity
from refcatalog.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
WORDS, LAST = 3_000_000, "password = abcdef0123456789"


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    draw = random.Random(1)
    known = ["".join(draw.choice("aeinorstl") for _ in range(draw.randint(2, 9))) for _ in range(20_000)]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    text = " ".join([*(draw.choice(known) for _ in range(WORDS)), item, LAST])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = f"file://{tmp_path_factory.mktemp('long')}/documents"
    docs.unionByName(spark.createDataFrame([(-1, text, "en", "s", len(text))], docs.schema)).write.parquet(path)
    return spark.read.parquet(path), text


def test_long_texts_are_read_to_their_end(spark, long):
    docs, text = long
    assert len(text) > 19_000_000
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    own = lambda df: df.where("doc_id = -1").first()
    counted = own(token_count.token_counts(docs, tokenizer_path("piece_bpe_32k.model"), 4096))
    assert counted["n_bytes"] == len(text) and counted["n_tokens"] > WORDS
    hit = own(decontam.scan(docs, bench, window=10))
    assert hit["n_words"] > WORDS and 0 < hit["n_hit"] < 5000 and len(hit["item_ids"]) >= 1
    found = own(secrets.scan(docs, secrets.train(docs.where("doc_id >= 0"))))
    assert found["n_assign"] == 1 and found["base"].startswith(f"assign:{len(text) - len(LAST)}:{len(text)}")
    rows = toxicity.training_rows(docs.where("doc_id >= 0"), labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1), "doc_id", "text", "toxic")
    assert 0 <= own(toxicity.score(docs, toxicity.fit(rows)))["score"] <= 1
    assert 0 <= own(quality.score(docs, labels))["score"] <= 1
