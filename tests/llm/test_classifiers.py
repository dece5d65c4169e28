"""Toxicity, quality, language and url verdicts: held-out accuracy, odd rows, and rules against plain Python."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from weekgrid.llm import language_id, queries, quality_crf, toxicity, url_filter
from weekgrid.llm.shared import held_out, labelled, remainder, table


def fold(d, m):
    return zlib.crc32(str(d).encode()) % m


def test_folds(odd):
    rows = odd.select("doc_id", remainder("doc_id", 5).alias("r"), held_out("doc_id", 5, 0).alias("h")).collect()
    for r in rows:
        assert (r.r, r.h) == ((None, False) if r.doc_id is None else (fold(r.doc_id, 5), fold(r.doc_id, 5) == 0))


def truth(spark, sf, column):
    return {r.doc_id: r[column] for r in table(spark, sf, "labels").where(F.col(column).isNotNull()).collect()}


def test_quality_held_out(spark, sf):
    rows, labels = queries.op4_quality_crf(spark, sf).collect(), truth(spark, sf, "quality")
    assert len(rows) == table(spark, sf, "documents").count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 10 and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


def test_toxicity_learned(spark, sf):
    rows, labels = queries.op2_toxicity(spark, sf).collect(), truth(spark, sf, "toxic")
    assert len(rows) == table(spark, sf, "documents").count() and all(0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in known) >= 0.9 * len(known)


def test_toxicity_held_out(spark):
    """Words alone, pairs and pairs with a gap are all learned."""
    clean = [f"plain words number w{i} and w{i % 7} nice day" for i in range(60)]
    bad = [f"w{i} you {('scum', 'utter fool', 'fool of a')[i % 3]} w{i % 7}" for i in range(60)]
    rows = [(i, t, int(i >= 60)) for i, t in enumerate(clean + bad)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, remainder("doc_id", 5) != 0).collect()}
    assert all(got[i].predicted == y for i, _, y in rows)
    kept = toxicity.only_clean(docs, labels, F.lit(True)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(60))


def test_language_held_out(spark, sf):
    rows = queries.op5_language_id(spark, sf).collect()
    langs = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


LABELS = "doc_id long, quality int, toxic int"


def test_odd_rows(spark, odd, odd_rows):
    ids = sorted((d for d, *_ in odd_rows), key=str)
    labels = spark.createDataFrame([(d or -1, d and d % 2, d and int(d > 25)) for d in ids] + [(None, 1, 1), (4, None, None)], LABELS)
    learn = F.col("doc_id").isNotNull()
    for frame in (toxicity.toxicity(odd, labels, learn), quality_crf.quality(odd, labels, learn)):
        rows = frame.collect()
        assert sorted((r.doc_id for r in rows), key=str) == ids
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    kept = toxicity.only_clean(odd, labels, learn)
    assert kept.columns == odd.columns and kept.count() <= len(ids)
    named = language_id.identify(odd, learn).collect()
    assert sorted((r.doc_id for r in named), key=str) == ids
    text = dict((d, t) for d, t, *_ in odd_rows)
    for r in named:
        if r.doc_id is not None:
            lettered = any(c.isalpha() for c in text[r.doc_id] or "")
            assert (r.lang_pred in ("en", "fr", "de")) == lettered and (lettered or (r.score == 0 and not r.accepted))
    accepted = language_id.only_accepted(odd, learn)
    assert accepted.columns == odd.columns and accepted.where("text is null or doc_id = 7").count() == 0
    assert language_id.only_accepted(odd, learn, reject_below=1.1).count() == 0


def test_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([], LABELS)
    always = F.lit(True)
    assert toxicity.toxicity(none, labels, always).collect() == quality_crf.quality(none, labels, always).collect() == []
    assert language_id.identify(none, always).collect() == language_id.only_accepted(none, always).collect() == []
    assert {r.predicted for r in toxicity.toxicity(odd, labels, always).collect()} == {0}
    assert {r.score for r in quality_crf.quality(odd, labels, always).collect()} == {0.5}
    assert {r.lang_pred for r in language_id.identify(odd, F.lit(False)).collect()} == {"und"}


def test_sample_is_bounded(spark, odd):
    docs = odd.unionByName(odd).unionByName(odd)
    labels = spark.createDataFrame([(d, d % 2, 0) for d in [*range(1, 17), *range(20, 40)]] * 2, LABELS)
    got = labelled(docs, labels, "quality", F.lit(True), per_class=4).collect()
    assert len(got) <= 8 and {r.y for r in got} == {0, 1}
    assert len(language_id.sample(docs, F.lit(True), 3)) <= 3


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URLS = [
    None, "", "no scheme", "http://", "http://?q", "http://A.Example.NET/en/1?x", "https://example.net/EN/", "https://net", "https://net/",
    "x://b.net?/en/", "ftp://a.org/fr/#/de/", "https://xorg/fr/", "https://org/fr", "https://u@h.example.com:80/de/", "https://example.com/de/a",
    "https://sub.example.com/de/://x/en/", "https://cheap-pills.example.com/en/4", "https://casino-win.example.org/x", "https://town-library.example.com/1",
    "https://Ñ.com/é", "http://a.net/" + "p" * 50_000, "HTTPS://WWW.EXAMPLE.COM/DE/", "://example.net/en/", "a\n://b.org/fr/\n?",
]


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, i, i) for i, u in enumerate(URLS)] + [(None, None, 0, 0), (5, URLS[5], 0, 0)], "page_id long, url string, score int, rule int")
    labelled_urls = spark.createDataFrame([*url_filter.EXAMPLES, (None, 1), ("http://x/", None)], "url string, block int")
    rows = url_filter.url_verdicts(pages, RULES, labelled_urls).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        host, path, rule, verdict = by_hand(URLS[r.page_id] if r.page_id is not None else None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow")) and 0 <= r.score <= 1
    verdicts = {r.page_id: r.verdict for r in rows}
    assert [verdicts[i] for i in (16, 17, 18)] == ["block", "block", "allow"]
    blank = url_filter.url_verdicts(pages, [], labelled_urls.limit(0)).collect()
    assert {r.verdict for r in blank} == {"allow"} and {r.rule for r in blank} == {None}
    assert url_filter.url_verdicts(pages.limit(0), RULES, labelled_urls).collect() == []


def test_hosts_that_no_example_names(spark):
    junk = ["casino-win", "free-bets", "cheap-pills", "adult-x", "mega-casino", "pills-now", "bet-kings", "loans-fast"]
    plain = ["village-library", "daily-gazette", "old-museum", "river-council", "thther", "botanic-garden", "night-school", "choir-society"]
    assert not any(h in url for url, _ in url_filter.EXAMPLES for h in (*junk, "thther", "ads-track", "spam-farm"))
    pages = spark.createDataFrame([(i, f"https://{h}.example.com/en/{i}") for i, h in enumerate([*junk, *plain])], "page_id long, url string")
    labelled_urls = spark.createDataFrame(url_filter.EXAMPLES, "url string, block int")
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(pages, [], labelled_urls).collect()}
    right = sum(got[i] == ("block" if i < len(junk) else "allow") for i in got)
    assert right >= 14, got


@pytest.mark.parametrize("lengths", [[1], [3, 1, 7], [1, 1, 1, 5]])
def test_marginals_by_enumeration(lengths):
    import itertools

    import numpy as np

    rng = np.random.default_rng(sum(lengths))
    begins = np.cumsum([0, *lengths])
    scores, chain = rng.normal(size=begins[-1]), rng.normal(size=(2, 2))
    good, edges = quality_crf.marginals(scores, begins, chain)
    for k, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
        weight, hits, pairs = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(b - a)):
            steps = np.zeros((2, 2))
            for i, j in itertools.pairwise(path):
                steps[i, j] += 1
            w = np.exp((scores[a:b] * path).sum() + (steps * chain).sum())
            weight, hits, pairs = weight + w, hits + w * np.array(path), pairs + w * steps
        assert np.allclose(good[a:b], hits / weight) and np.allclose(edges[k], pairs / weight)


def test_lines_look_at_neighbours():
    ids, size, begins = quality_crf.lines([b"a b\nA!! B!!", b"", b"a b"])
    assert size.tolist() == [4, 8, 1, 4] and begins.tolist() == [0, 2, 3, 4]
    third = ids.shape[1] // 3
    assert ids[0, 2 * third :].tolist() != ids[3, 2 * third :].tolist()
    assert ids.max() < quality_crf.N_FEATURES
