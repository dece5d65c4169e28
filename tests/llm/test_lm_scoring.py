"""The byte model and the word base line against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekgrid.llm import ppm
from weekgrid.llm.lm_scoring import lm_scores, most_frequent
from weekgrid.llm.shared import remainder


def brute(train, order, text):
    """Prediction by partial matching, a symbol at a time."""
    seen = defaultdict(Counter)
    mark = b"\xff" * order
    for raw in train:
        whole = mark + raw + b"\xff"
        for i in range(order, len(whole)):
            for k in range(order + 1):
                seen[whole[i - k : i]][whole[i]] += 1
    whole, total = mark + text + b"\xff", 0.0
    for i in range(order, len(whole)):
        out = set()
        for k in range(order, -1, -1):
            left = {s: n for s, n in seen[whole[i - k : i]].items() if s not in out}
            if left:
                if whole[i] in left:
                    total += math.log10((left[whole[i]] - 0.5) / sum(left.values()))
                    break
                total += math.log10(len(left) / 2 / sum(left.values()))
                out |= set(left)
        else:
            total += math.log10(1 / (256 - len(out)))
    return total


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_model(order):
    train = [b"abracadabra", b"banana bandana", b"", "é è".encode()]
    model = ppm.train(*ppm.grams(train, order), order)
    texts = [b"", b"abra", b"xyz", b"bandana", "ñé".encode(), b"a" * 500]
    for text, got in zip(texts, ppm.score(model, texts), strict=True):
        assert got == pytest.approx(brute(train, order, text), abs=1e-4)


def test_chances_sum_to_one():
    model = ppm.train(*ppm.grams([b"abracadabra", b"banana"], 3), 3)
    chance = 10.0 ** model.logs.astype(float)
    met = chance.shape[1] - 1
    assert np.allclose(chance[:, :met].sum(axis=1) + (256 - met) * chance[:, met], 1, atol=1e-4)


def test_bounded_contexts_keep_the_trie_whole():
    train = [bytes(np.random.default_rng(i).integers(97, 105, 400, dtype=np.uint8)) for i in range(5)]
    small = ppm.train(*ppm.grams(train, 3), 3, max_contexts=50)
    assert len(small.logs) <= 50 and np.isfinite(ppm.score(small, [b"abcdefgh", b"zzz"])).all()


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())


@pytest.mark.parametrize("head", [0, 5, 100_000])
def test_base_line(odd, odd_rows, head):
    got = lm_scores(odd, remainder("doc_id", 7) != 2, order=2, head=head)
    assert got.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    learned = [t or "" for d, t, *_ in odd_rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for t in learned for w in words(t))
    total, kinds = sum(counts.values()) + len(learned), len(counts) + 1
    want = []
    for d, t, *_ in odd_rows:
        seen = [counts[w] for w in words(t or "")] + [len(learned)]
        base = sum(math.log10((c + 1) / (total + kinds + 1)) for c in seen)
        want.append((d, len(seen), sum(c > 0 for c in seen), total, round(base, 5)))
    rows = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_model_learns_from_the_table(odd, odd_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 2000]
    docs = odd.where(F.coalesce(F.length("text"), F.lit(0)) < 2000)
    learned = [(t or "").encode() for d, t, *_ in rows if d is not None]
    got = {(r.doc_id, r.n_tokens): r.score for r in lm_scores(docs, F.col("doc_id").isNotNull(), order=2).collect()}
    for d, t, *_ in rows[:12]:
        assert got[d, len(words(t or "")) + 1] == pytest.approx(brute(learned, 2, (t or "").encode()), abs=1e-2)


def test_nothing_to_learn(odd, none):
    assert lm_scores(none, F.lit(True)).collect() == []
    rows = lm_scores(odd, F.lit(None).cast("boolean"), order=2).collect()
    assert {r.n_known for r in rows} == {0} and {r.base_score for r in rows} == {0.0}
    assert all(r.score < 0 for r in rows)


def test_most_frequent(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([9, 7, 7, 5, 1, 1, 1])], "key long, n long")
    take = lambda rows, **o: sorted(r.key for r in most_frequent(counts, rows, **o).collect())
    assert take(1) == [0] and take(2) == [0] and take(3) == [0, 1, 2] and take(99) == list(range(7)) and take(0) == []


@pytest.mark.parametrize("cached", [0, 40, 1_000_000])
def test_nothing_is_cut_from_the_contexts(spark, cached):
    """Runs that the cache lacks, and bytes of a script whose runs are all rare, have the chances of all training texts."""
    common = [("banana bandana %d" % (i % 3),) for i in range(40)]
    rare = [("漢字 abracadabra",), ("ñandú",), ("",), (None,), ("xylophone \x85 banana",)]
    rows = [(i, *r) for i, r in enumerate(common + rare)] + [(100, "漢字 banana"), (101, "zzz ñandú é"), (102, "abra 字")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learned = [(t or "").encode() for d, t in rows if d < 100]
    got = {r.doc_id: r.score for r in lm_scores(docs, F.col("doc_id") < 100, order=3, cached=cached, head=5).collect()}
    for d, t in rows[38:]:
        assert got[d] == pytest.approx(brute(learned, 3, (t or "").encode()), abs=1e-6)
