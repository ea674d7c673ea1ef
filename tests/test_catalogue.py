import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from refcatalog.functions import evidence, keys, venues
from refcatalog.operators.similar import _lcs, dedup, similar_pairs
from refcatalog.plans import catalogue, curated, upkeep

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.queries() | curated.queries() | upkeep.queries()
ORACLE = catalogue.oracle_sql() | curated.oracle_sql() | upkeep.oracle_sql()


def _rows(frame, columns):
    plain = lambda v: "~" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)[:10] if hasattr(v, "year") else str(v)
    return sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert _rows(got, columns) == _rows(want, columns)


def test_similar_pairs_lose_nothing(spark):
    titles = ["abcdefghij klmnop", "abcdefghij klmnoq", "abcdefghij klmn", "other title here", "Other Title here", "", None, "ab", "abc", "other title herd"]
    rows = spark.createDataFrame(list(enumerate(titles)), "seq long, title string")
    got = {(r["a"], r["b"]) for r in similar_pairs(rows).collect()}
    low = {i: t.lower().strip() for i, t in enumerate(titles) if t}
    first = {t: min(i for i, u in low.items() if u == t) for t in low.values()}
    want = {(i, first[t]) for i, t in low.items() if first[t] != i}
    for a in first.values():
        for b in first.values():
            if a > b and 200 * _lcs(low[a], low[b]) >= 90 * (len(low[a]) + len(low[b])):
                want.add((a, b))
    assert got == want


def test_dedup_joins_leaders_only(spark):
    rows = spark.createDataFrame([(0, "first title of all", "1", None), (1, "quite another one", "1", "d"), (2, "third of them here", None, "d"), (3, "first title of alL", None, None)], "seq long, title string, arxiv_id string, doi string")
    assert {r["seq"]: r["leader"] for r in dedup(rows, ["arxiv_id", "doi"]).collect()} == {0: 0, 1: 0, 2: 2, 3: 0}


def test_usage_outside_boilerplate(spark):
    rows = spark.createDataFrame([("runs on GRID today",), ("join the GRID chat",), ("join the GRID chat, hosted on GRID",)], "t string")
    got = rows.select(evidence.usage_class(F.col("t"), "GRID", [("join the ", " chat")])).toPandas().iloc[:, 0].tolist()
    assert got == [True, False, True]


def test_venue_and_key_cases(spark):
    rows = spark.createDataFrame([("Proceedings of the 3rd Conf X Poster", 2024, "Accepted at ACME 2025."), ("arXiv preprint 2301", 0, "none"), ("the ICLR, 2025 2025", 0, None)], "v string, y int, c string")
    got = rows.select(venues.normalize_venue(F.col("v"), F.col("y")), venues.venue_from_comment(F.col("c"))).toPandas().values.tolist()
    assert got == [["Conf X 2024", "ACME 2025"], ["", ""], ["ICLR 2025", ""]]
    ids = spark.createDataFrame([("http://arxiv.org/pdf/2407.14561v2.pdf",)], "u string").select(keys.normalize_arxiv_id(F.col("u"))).first()[0]
    assert ids == "2407.14561"
