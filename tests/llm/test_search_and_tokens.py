"""Top-k search and BPE against plain Python and the tokenizers library."""

import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import same_as_sql
from weekgrid.llm import bpe, queries, sql, topk_search

FILE = public_tokenizers.path("word_bpe_49k.json")


def vectors(spark, n=160, dim=6):
    rng = np.random.default_rng(4)
    near = rng.integers(-3, 4, (n, dim)) / 8  # few values: many ties
    rows = [(i, [float(x) for x in v], i) for i, v in enumerate(near)]
    rows += [
        (500, None, 0), (550, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (600, [math.nan] * dim, 0), (650, [math.inf] * dim, 0), (None, [1.0] * dim, 0),
        (700, [0.5, 0.25], 0), (701, [1.0, 1.0], 0), (750, [], 0), (751, [], 0), rows[100], rows[3], (800, [-0.001] * dim, 0),
    ]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(4)


def by_hand(rows, k=5):
    whole = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [math.floor(256 * float(np.float32(x))) for x in v]
    out = set()
    for q, v in whole.items():
        if q % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole.items() if i != q and len(w) == len(v)]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 20, "block_rows": 2, "leaf": 4}])
def test_top_k(spark, sizes):
    rows, table = vectors(spark)
    got = topk_search.top_k(table, table.where("vec_id % 50 = 0"), **sizes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == by_hand(rows)


def test_top_k_empty(spark):
    _, table = vectors(spark)
    none = table.limit(0)
    assert topk_search.top_k(none, none).collect() == topk_search.top_k(table, none).collect() == topk_search.top_k(none, table).collect() == []


def test_top_k_sql(spark, sf):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view embeddings as from '{sf}/embeddings.parquet'")
    same_as_sql(queries.op1_topk_search(spark, sf), db, sql.TOPK_SEARCH)


def test_bounds_hold():
    rng = np.random.default_rng(8)
    points, asked = rng.integers(-50, 50, (300, 5)).astype(float), rng.integers(-50, 50, (20, 5)).astype(float)
    import io

    tree = np.load(io.BytesIO(topk_search.packed(np.arange(300), points, 16)))
    top = topk_search.bounds(tree, asked, np.full(20, -np.inf))
    for node, (a, b, _) in enumerate(tree["nodes"]):
        assert (asked @ tree["vectors"][a:b].T <= top[:, [node]]).all()


def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


TEXTS = [
    None, "", " ", "Hello World's  é ab<|endoftext|>c 12a!", "x y y İİ ΑΣ H̱ é \x1c\x85",
    "<|StartOfText|> <|startoftext|>x<|endoftext|><|endoftext|>", "́abc ́d\tE​", "'s'S don't DON'T ’s", "가 가 \U0001f600️ ﬁ Å",
    "word " * 30_000, "w" * 30_000,
]


@pytest.mark.parametrize("table_words", [400_000, 3])
def test_bpe_is_the_librarys(spark, odd_rows, table_words):
    texts = TEXTS + [t for _, t, *_ in odd_rows[:15]]
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    both = bpe.decode(bpe.encode(docs, FILE, table_words), FILE).collect()
    tokenizer = library()
    assert len(both) == len(texts)
    for r in both:
        ids = tokenizer.encode(texts[r.doc_id or 0] or "", add_special_tokens=False).ids
        assert (r.n_tokens, bytes(r.ids)) == (len(ids), np.array(ids, "<u4").tobytes())
        assert r.decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_digests(spark, sf):
    got = {r.doc_id: r for r in queries.op9_bpe(spark, sf).collect()}
    tokenizer = library()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        assert tuple(got[r.doc_id])[1:] == want


def test_decode_odd_ids(spark):
    rows = [(1, None), (2, b""), (3, np.array([320, 49_405, 49_407], "<u4").tobytes())]
    got = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary"), FILE).collect()}
    assert got == {1: None, 2: "", 3: library().decode([320, 49_405, 49_407], skip_special_tokens=False)}
    assert bpe.decode(bpe.encode(spark.createDataFrame([], "doc_id long, text string"), FILE), FILE).collect() == []


def test_all_rows_of_the_queries(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert queries.op8_lm_scoring(spark, sf).where(F.col("score") >= 0).count() == 0
    assert queries.op8_lm_scoring(spark, sf).count() == docs.count()
