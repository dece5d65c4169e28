"""Word hashes and shingle sets against plain Python."""

import re

import numpy as np

from weekgrid.llm.words import LETTERS, chunks, shingle_sets, windows, word_hashes


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())


def test_hashes_name_words(odd_rows):
    texts = [t for _, t, *_ in odd_rows]
    of = {}
    for start, raw in chunks(texts, most=3000):
        hashes, begins = word_hashes(raw)
        for i, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
            mine = words(texts[start + i] or "")
            assert len(mine) == b - a
            for word, h in zip(mine, hashes[a:b].tolist(), strict=True):
                assert of.setdefault(word, h) == h  # the same in every batch and place
    assert len(set(of.values())) == len(of)


def test_chunks_hold_every_text():
    texts = ["a" * 10, None, "", "b" * 50, "c"] * 20
    got = [r for start, raw in chunks(texts, most=60) for r in raw]
    assert got == [(t or "").encode() for t in texts]
    assert list(chunks([])) == []


def test_shingles(odd_rows):
    texts = [t or "" for _, t, *_ in odd_rows]
    for text, got in zip(texts, shingle_sets([t.encode() for t in texts]), strict=True):
        w = words(text)
        k = min(5, len(w))
        want = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()


def test_windows_know_order():
    a, b = windows(np.array([1, 2, 3], np.uint64), 3), windows(np.array([2, 1, 3], np.uint64), 3)
    assert a != b and len(windows(np.array([1], np.uint64), 2)) == 0


def test_letters_cut_at_marks():
    assert len(word_hashes(["idiot, idiot!".encode()], LETTERS)[0]) == 2
    a, b = word_hashes([b"idiot, (idiot)"], LETTERS)[0]
    assert a == b
