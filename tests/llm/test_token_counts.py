"""Token counts against the library's own encoding of whole texts."""

from __future__ import annotations

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from weekgrid.llm import queries
from weekgrid.llm.pretokens import PATTERN, Cutter, newer_characters, rules
from weekgrid.llm.token_counts import distinct_pretokens, token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "a  b \n c", " ", "  lead", "trail  ", "x<|endoftext|> y<|endoftext|><|endoftext|>  z ", "don't DON'T ''s 'sx 'll've", "\n\n a\t\tb\r\n",
    "é\x85\x1c ͏ ​漢字  　x 12 3½ ", "՘a՘ ꟎꟏b ࢏", "<|endoftext|", "a. b, c! 'tis ..", "\U0001f600 \U0001f468‍\U0001f469", "▁x ▁",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def expected(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("head", [0, 50, 200_000])
def test_odd_texts_count_as_the_library_counts_them(spark, odd, odd_rows, library, head):
    got = sorted(map(str, token_counts(odd, FILE, limit=40, head=head).collect()))
    want = []
    for doc_id, text, *_ in odd_rows:
        n = expected(library, text)
        want.append(f"Row(doc_id={doc_id}, n_bytes={len((text or '').encode())}, n_tokens={n}, over_limit={n > 40})")
    assert got == sorted(want)


@pytest.mark.parametrize("head", [0, 200_000])
def test_blanks_specials_and_new_characters(spark, library, head):
    frame = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(frame, FILE, head=head).collect()}
    assert got == {i: expected(library, text) for i, text in enumerate(HARD)}


def test_pieces_cut_as_the_library_cuts_every_character(library):
    cut = Cutter(rules(open(FILE, encoding="utf-8").read()))
    newer = regex.compile(f"[{newer_characters()}]")
    for code in [*range(0, 0x3100), *range(0xA000, 0xD800, 7), *range(0xE000, 0x110000, 61)]:
        ch = chr(code)
        text = f"a{ch}b1{ch}2 {ch}  {ch} !{ch}!"
        want = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert [t for piece in cut.pieces(text) for t in cut.pretokens(piece)] == want, hex(code)
        assert newer.search(ch) or regex.findall(PATTERN, text) == want, hex(code)


def test_every_pretoken_is_counted_once(spark, odd, odd_rows, library):
    rows = distinct_pretokens(odd, FILE).collect()
    assert len({r.key for r in rows}) == len(rows)
    assert sum(r.n * r.pieces for r in rows) == sum(
        expected(library, part) for _, text, *_ in odd_rows for part in (text or "").split("<|endoftext|>")
    )


def test_an_empty_table_gives_an_empty_one(none):
    assert token_counts(none, FILE).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        rules(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_query_over_the_whole_table(spark, sf, library):
    got = {r.doc_id: r.n_tokens for r in queries.op13_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {r.doc_id: expected(library, r.text) for r in docs}
