"""FTRL and the embedding model against versions that go feature by feature and byte by byte."""

from __future__ import annotations

import math

import numpy as np

from weekgrid.llm import language_id, toxicity
from weekgrid.llm.words import mix


def plain_ftrl(examples, epochs, alpha, beta, l1, l2):
    z, n, bias, bias_n = {}, {}, 0.0, 0.0
    order = np.random.default_rng(7)

    def weight(f):
        if abs(z.get(f, 0.0)) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            y, features = examples[i]
            w = {f: weight(f) for f in features}
            g = 1 / (1 + math.exp(-max(-35, min(35, bias + sum(w.values()))))) - y
            for f in features:
                old = n.get(f, 0.0)
                sigma = (math.sqrt(old + g * g) - math.sqrt(old)) / alpha
                z[f] = z.get(f, 0.0) + g - sigma * w[f]
                n[f] = old + g * g
            bias_n += g * g
            bias -= alpha / (beta + math.sqrt(bias_n)) * g
    return {f: weight(f) for f in z if weight(f)}, bias


def test_ftrl_by_single_features():
    rng = np.random.default_rng(1)
    examples = [(int(i % 3 == 0), np.unique(rng.integers(0, 60, 12)) if i % 3 else np.unique(rng.integers(40, 90, 12))) for i in range(120)]
    places, values, bias = toxicity.ftrl(examples, 7, epochs=3, alpha=1.0, beta=1.0, l1=0.5, l2=0.1)
    want, want_bias = plain_ftrl([(y, f.tolist()) for y, f in examples], 3, 1.0, 1.0, 0.5, 0.1)
    assert sorted(want) == places.tolist() and len(places) < 90
    assert np.allclose(values, [want[p] for p in places.tolist()]) and math.isclose(bias, want_bias)


def plain_features(text):
    """Words, neighbours and words with one between, as the hashes of single words give them."""
    words = toxicity.word_hashes([text], toxicity.LETTERS)[0]
    odd = np.uint64(0x9E3779B97F4A7C15)
    out = {int(mix(np.array([w ^ toxicity._KINDS[0]]))[0] >> np.uint64(54)) for w in words}
    for gap in (1, 2):
        for a, b in zip(words, words[gap:]):  # noqa: B905
            with np.errstate(over="ignore"):
                out.add(int(mix(np.array([(a ^ toxicity._KINDS[gap]) * odd + b]))[0] >> np.uint64(54)))
    return out


def test_features_of_several_texts_by_single_texts():
    texts = [b"one two, three! four", b"", b"Two words", b"x", b"a b a b a b"]
    ids, owner = toxicity.features(texts, 10)
    for i, text in enumerate(texts):
        assert set(ids[owner == i].tolist()) == plain_features(text)


def plain_subwords(text, bits):
    """Runs of 2 to 4 bytes inside one word with its borders as blanks, byte by byte."""
    data = [32 if b <= 32 else b for b in b" " + text + b" "]
    out = []
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            run = data[i : i + n]
            if 32 in run[1:-1] or (n > 2 and run[0] == run[-1] == 32) or (n == 2 and 32 in run):
                continue
            code = n
            for b in run:
                code = code << 8 | b
            out.append(int(mix(np.array([code], np.uint64))[0] >> np.uint64(64 - bits)))
    return out


def test_language_scores_byte_by_byte(spark):
    examples = [("en", f"the house and the garden of number {i} there") for i in range(40)]
    examples += [("de", f"das Haus und der Garten von Nummer {i} dort") for i in range(40)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(examples)] + [(900, "der gardener", None), (901, "7 !", None), (902, None, None)], "doc_id long, text string, lang string")
    model = language_id.train(language_id.sample(docs, language_id.F.lit(True), 100), 12)
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.F.lit(True), bits=12, examples=100).collect()}
    for row in docs.collect():
        if not row.text or not any(ch.isalpha() for ch in row.text):
            assert (got[row.doc_id].lang_pred, got[row.doc_id].score) == ("und", 0.0)
            continue
        ids = plain_subwords(row.text.lower().encode(), 12)
        mean = [sum(float(model.logits[i][k]) for i in ids) / len(ids) + float(model.bias[k]) for k in range(2)]
        shares = [math.exp(m / model.temperature) for m in mean]
        best = max(range(2), key=shares.__getitem__)
        assert got[row.doc_id].lang_pred == model.langs[best]
        assert math.isclose(got[row.doc_id].score, shares[best] / sum(shares), rel_tol=1e-5)
