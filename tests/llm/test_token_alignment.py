"""Alignment and pair counts against whole texts tokenized, aligned and counted the slow way."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weekgrid.llm import queries
from weekgrid.llm.spill_count import pack, unpack
from weekgrid.llm.token_alignment import align, load, pair_counts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    "a  b \n c", " ", "   ", "  lead", "trail  ", "x<|endoftext|> y <s> z</s> <0x0A> <unk>", "don't DON'T ''s", "\n\n a\t\tb\r\n", "▁x",
    "x ▁ y", "é\x85\x1c ͏ ​漢字  　x 12 3½ ", "a\x00b", "\U0001f600 \U0001f468‍\U0001f469 \U0001f600", "a b\n c \n d", "zßß ßz" * 40, "۝۝۝۝ ߷߷߷", None, "",
]


def plain(texts):
    """Digest rows and pair counts by the contract's words."""
    library, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    rows, links = [], []
    for text in texts:
        a = library.encode(" " + (text or ""), add_special_tokens=False).ids
        b = model.encode(text or "")
        a_raw = [bytes(letters[c] for c in library.id_to_token(i)) for i in a]
        b_raw = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
            rows.append((0, 0, 0, ""))
            links.append(Counter())
            continue
        ends = [np.cumsum([len(x) for x in raw]).tolist() for raw in (a_raw, b_raw)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = defaultdict(lambda: ([], []))
        for side, (ids, end) in enumerate(zip((a, b), ends, strict=True)):
            for i, g in zip(ids, np.searchsorted(both, end).tolist(), strict=True):
                groups[g][side].append(i)
        listed = [groups[g] for g in range(len(both))]
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in listed)
        rows.append((len(a), len(b), len(both), hashlib.sha256(text_of.encode()).hexdigest()))
        links.append(Counter((x, y) for xs, ys in listed for x in xs for y in ys))
    counts = Counter(pair for one in links for pair in one)
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for (n_a, n_b, n_groups, digest), one in zip(rows, links, strict=True):
        best = sum(n for p, n in one.items() if counts[p] == top[p[0]])
        out.append((n_a, n_b, n_groups, sum(one.values()), best, sum(n * counts[p] for p, n in one.items()), digest))
    return out, counts, top


def digests(frame):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect())


@pytest.mark.parametrize("limits", [{}, {"buckets": 3, "fan": 2, "most_words": 40, "most_pieces": 30}])
def test_odd_texts(spark, odd, odd_rows, limits):
    texts = [r[1] for r in odd_rows]
    want, _, _ = plain(texts)
    assert digests(align(odd, A, B, **limits)) == sorted((str(r[0]), *w) for r, w in zip(odd_rows, want, strict=True))


@pytest.mark.parametrize("limits", [{}, {"buckets": 2, "fan": 2, "most_words": 5, "most_pieces": 7}])
def test_blanks_specials_and_texts_that_do_not_fit(spark, limits):
    frame = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").repartition(2)
    want, counts, top = plain(HARD)
    assert digests(align(frame, A, B, **limits)) == sorted((str(i), *w) for i, w in enumerate(want))
    got = {(r.a, r.b): (r.n, r.best) for r in pair_counts(frame, A, B, **limits).collect()}
    assert got == {p: (n, n == top[p[0]]) for p, n in counts.items()}


def test_pieces_may_be_tokenized_one_by_one():
    assert load(A, B).cuts


def test_an_empty_table_gives_an_empty_one(none):
    assert align(none, A, B).collect() == []
    assert pair_counts(none, A, B).collect() == []


def test_columns_survive_packing():
    columns = [np.array([], np.int64), np.array([0, 255, 3]), np.array([70_000, 1]), np.array([1 << 40])]
    assert all(np.array_equal(a, b) for a, b in zip(columns, unpack(pack(*columns)), strict=True))


def test_query_over_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want, _, _ = plain([r.text for r in docs])
    assert digests(queries.op11_token_alignment(spark, sf)) == sorted((str(r.doc_id), *w) for r, w in zip(docs, want, strict=True))
