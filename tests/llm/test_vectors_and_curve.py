"""Vector codes, curve packing and whitening against plain Python over the smallest tables, and on small cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from refcatalog.llm import curve_packing, queries, vector_codes, whitening
from refcatalog.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return [(r["vec_id"], np.array(r["embedding"], np.float32).astype(float), r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]


def _codes(rows, pieces=4, entries=256, rounds=4, scale=1024):
    """Plain product codebooks: (vec_id, code, error) and the digest."""
    whole = {i: np.floor(v * scale).astype(int) for i, v, _ in rows}
    width = len(rows[0][1]) // pieces
    parts = {(i, j): tuple(v[j * width : (j + 1) * width].tolist()) for i, v in whole.items() for j in range(pieces)}
    books = [[parts[i, j] for i in sorted(whole)[:entries]] for j in range(pieces)]
    near = lambda w, book: min((sum((a - b) ** 2 for a, b in zip(w, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        held = defaultdict(list)
        for (_, j), w in parts.items():
            held[j, near(w, books[j])[1]].append(w)
        for (j, k), own in held.items():
            books[j][k] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    out = {i: [near(parts[i, j], books[j]) for j in range(pieces)] for i in whole}
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in own), sum(d for d, _ in own)) for i, own in out.items()}, sha


def test_op11_equals_brute_force(spark, vectors):
    some = vectors[:120]
    want, sha = _codes(some, entries=24)
    rows = spark.createDataFrame([(i, v.tolist(), lab) for i, v, lab in some], "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.compress(rows, entries=24)
    got = vector_codes.with_label_error(coded).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and vector_codes.digest(books) == sha
    by_label = defaultdict(int)
    for i, _, lab in some:
        by_label[lab] += want[i][1]
    assert all(r["label_error"] == by_label[r["label"]] for r in got)


def test_trie_walk_equals_all_distances():
    rng = np.random.default_rng(3)
    for reach, kind in ((3, np.int32), (40_000, np.int64), (1 << 40, object)):
        parts, place = vector_codes.distinct_rows(rng.integers(-reach, reach, (3000, 5)))
        book = np.concatenate([parts[rng.integers(0, len(parts), 40)], parts[:1], parts[:1]])
        code, far = vector_codes.nearest(parts, book)
        assert vector_codes._kind(parts, book) is kind
        all_ = ((parts[:, None, :].astype(object) - book[None, :, :]) ** 2).sum(axis=2)
        assert (far == all_.min(axis=1)).all() and (code == np.array([int(np.argmin(r)) for r in all_])).all()
        assert len(place) == 3000 and place.max() == len(parts) - 1
    assert vector_codes.nearest(np.zeros((0, 4), int), np.zeros((2, 4), int))[0].tolist() == []


def test_codes_of_ties_nulls_and_odd_lengths(spark):
    rows = [(3, [0.5, 0.5, 0.25], None), (1, [1.0], "a"), (None, [0.5, 0.5, 0.25], "a"), (2, [0.5, None, 1.0], "a"), (4, [float("nan")], "a"), (5, None, None), (6, [1e30], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("code", F.lit("clash")).withColumn("salt", F.lit(0)).withColumn("v", F.lit(0))
    coded, books = vector_codes.compress(df, rounds=1)
    got = {(r["vec_id"], r["label"]): r for r in vector_codes.with_label_error(coded).collect()}
    # Ids 1, 3 and 6 start the codebooks; equal first parts go to the lower index.
    assert {k: r["code"] for k, r in got.items()} == {(1, "a"): "00000000", (3, None): "01010100", (None, "a"): "01010100", (6, None): "02000000"}
    assert all(r["label_error"] == 0 for r in got.values()) and [b.shape for b in books] == [(3, 1)] * 4
    empty, books = vector_codes.compress(df.where("vec_id > 9"))
    assert empty.collect() == [] and vector_codes.digest(books) == hashlib.sha256(b"").hexdigest()


def test_op12_ids_sequences_and_padding(spark):
    from tokenizers import Tokenizer

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tok, got = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), queries.op12_curve_packing(spark, SF).toPandas()
    for i, own in got.groupby("doc_id"):
        ids = np.array([*tok.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        own = own.sort_values("start")
        assert (own.doc_tokens == len(ids)).all() and list(own.start) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)] == list(own.ids_crc32)
    assert set(got.doc_id) == set(texts)
    short = []
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        n = int(s.length.sum())
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and n <= 2048 and n & (n - 1) == 0
        short += [n] if n < 2048 else []
    assert len(short) == len(set(short))  # the rest, in powers of two


def test_neighbours_on_the_curve_are_alike(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op12_curve_packing(spark, "/root/testdata/sf0.01").toPandas().sort_values(["sequence_id", "offset"])
    order = list(dict.fromkeys(got.doc_id))
    same = np.mean([langs[a] == langs[b] for a, b in zip(order, order[1:])])
    mixed = sum((n / len(order)) ** 2 for n in got.groupby(got.doc_id.map(langs)).doc_id.nunique())
    assert same > mixed + 0.5 * (1 - mixed)


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        key = curve_packing.hilbert_key(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_byte_ids_equal_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    own, library = curve_packing.ByteIds(path), Tokenizer.from_file(path)
    odd = ["", " ", "  ", "a  b", " a\n \nb", "x \n", "a  b　　c", "\x1c \x85\x85", "<|endoftext|>", "a <|endoftext|> <|endoftext|>b  ", "<|endof", "I'll 'sx '  's", "漢字 🙂 é é", "١٢ 12x", "x" * 50_000, " \t" * 999]
    assert [x.tolist() for x in own.batch(pa.array(odd, pa.large_string()))] == [library.encode(x, add_special_tokens=False).ids for x in odd]


def test_curve_packing_of_odd_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "word " * 30_000), *((k, "the same text") for k in range(3, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in ("ids", "n", "part", "nth", "p", "range", "start")))
    got = curve_packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json")).toPandas()
    assert got.length.sum() == got[got.start == 0].doc_tokens.sum() and len(got[got.start == 0]) == len(rows)
    copies = got.sort_values(["sequence_id", "offset"]).reset_index().query("doc_id > 2").index
    assert copies.max() - copies.min() + 1 == len(copies)  # side by side
    assert curve_packing.pack_documents(docs.where("doc_id > 999"), tokenizer_path("byte_bpe_50k.json")).collect() == []


def test_op13_equals_direct_whitening(spark, vectors):
    x = np.stack([np.floor(64 * v).astype(int) + 1_000_000 for _, v, _ in vectors])
    n, s = len(x), x.sum(axis=0)
    d = x.astype(object) * n - s
    centred = d.astype(float) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    got = queries.op13_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == n * 32 and set(got.n) == {n}
    deviation = dict(zip((i for i, _, _ in vectors), (d**2).sum(axis=1), strict=True))
    assert all(deviation[i] == x for i, x in zip(got.vec_id, got.deviation, strict=True))
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _, _ in vectors]].to_numpy()
    want = centred @ u[:, :32] / np.sqrt(e[:32])
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-9
    assert np.abs(got[got.vec_id == vectors[0][0]].explained.to_numpy() / (e[:32] / np.trace(v)) - 1).max() < 1e-10
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_spectrum_slices_of_ties_and_low_ranks():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((8, 8)))[0]
    tied = np.diag([5.0, 5, 5, 1, 1, 1 - 1e-9, 0, 0])
    for a, values in ((tied, [5, 5, 5, 1, 1, 1 - 1e-9]), (q @ tied @ q.T, [5, 5, 5, 1, 1, 1 - 1e-9]), (np.ones((4, 4)), [4]), (np.zeros((3, 3)), []), (np.diag([1e6, 1.0, 1e-3]), [1e6, 1, 1e-3])):
        e, x = whitening.leading(a, 32)
        assert np.allclose(e, values, rtol=1e-9) and np.abs(x.T @ x - np.eye(len(e))).max(initial=0) < 1e-12
        assert np.abs(a @ x - x * e).max(initial=0) < 1e-9 * max([1, *values])
    m = rng.standard_normal((25, 25))
    m += m.T
    e = np.linalg.eigvalsh(m)
    assert [whitening.above(m, s) for s in (-3.0, 0.0, 2.5)] == [(e > s).sum() for s in (-3.0, 0.0, 2.5)]
    b = rng.standard_normal(25)
    assert np.abs(m @ whitening.Factor(m).solve(b, 1e-300) - b).max() < 1e-9


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 7.0]), (1, [1.0, 2.0, 7.0]), (None, [3.0, 1.0, 7.0]), (2, [0.5, -4.0, 7.0]), (3, None), (4, [1.0, None, 2.0]), (5, [float("inf")] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("whitened", F.lit("x")).withColumn("n", F.lit("x"))
    got = whitening.whiten(df).collect()
    # The third dimension is constant, so two components are left.
    assert sorted((r["vec_id"] or 0, r["n"], len(r["whitened"])) for r in got) == [(0, 4, 2), (1, 4, 2), (1, 4, 2), (2, 4, 2)] and got[0]["identity_error"] < 1e-9
    one = whitening.whiten(df.where("vec_id = 2")).collect()
    assert [(r["n"], r["deviation"], r["whitened"]) for r in one] == [(1, 0, [])]
    assert whitening.whiten(df.where("vec_id = 3")).collect() == []
    far = spark.createDataFrame([(1, [1e12]), (2, [-1e12]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["deviation"]) for r in whitening.whiten(far).orderBy("vec_id").collect()] == [(1, None), (2, None), (3, 0)]
