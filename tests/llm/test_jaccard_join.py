"""The Jaccard join against all pairs, and its tiles against random sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_words import words
from weekgrid.llm import components, sql
from weekgrid.llm.components import connected
from weekgrid.llm.jaccard_join import bitmap, compare, folded, heads, jaccard_components, jaccard_links, one_per_group, overlap, place_of, prefix_runs


def shingles(text):
    w = words(text or "")
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, percent=80):
    """component_id by trying all pairs of rows."""
    sets = [shingles(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= percent * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (doc, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), None if doc is None else min(ids)))
    return sorted(out, key=str)


@pytest.mark.parametrize("percent, tile", [(80, 2_000_000), (90, 2_000_000), (80, 40)])
def test_all_pairs(odd, odd_rows, percent, tile):
    got = jaccard_components(odd, percent=percent, tile_elements=tile)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(odd_rows, percent)


def test_empty(none):
    assert jaccard_components(none).collect() == [] and one_per_group(none).collect() == []


def test_one_per_group(odd, odd_rows):
    kept = one_per_group(odd)
    assert kept.columns == odd.columns
    want = sorted({d for d, _, c in brute(odd_rows) if d is not None and d == c})
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == want and ids.count(None) == 2


def test_sql_agrees(odd, odd_rows, duck):
    # The SQL tells documents apart by doc_id: without nulls and repeats.
    rows = list({d: (d, t) for d, t, *_ in odd_rows if d is not None}.values())
    spark = odd.sparkSession
    duck.execute("create or replace table documents (doc_id bigint, text varchar)")
    duck.executemany("insert into documents values (?, ?)", rows)
    want = sorted(duck.execute(f"select doc_id, n_shingles, component_id from ({sql.JACCARD_JOIN})").fetchall())
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == want


def test_linked_sets_share_a_prefix_run():
    """The claim the tiles rest on, at the sharpest allowed difference."""
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        a_only = int(rng.integers(0, n // 5 + 1))
        b_only = int((0.2 * n - a_only) / 0.8 + 1e-9)
        pool = np.unique(rng.integers(0, 2**63, n + b_only + 5, dtype=np.uint64))[: n + b_only]
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(pool[a_only:])
        both, union = overlap(a, b), n + b_only
        assert both == n - a_only
        if 100 * both >= 80 * union and len(a) and a_only + b_only:
            assert set(prefix_runs(a, 80).tolist()) & set(prefix_runs(b, 80).tolist()), (n, a_only, b_only)


def test_compare_connects_all_links():
    rng = random.Random(2)
    pool = [np.uint64(x) for x in np.random.default_rng(3).integers(0, 2**63, 400, dtype=np.uint64)]
    for _ in range(30):
        sets, base = [], rng.sample(pool, 40)
        for _ in range(25):
            s = {*base[: rng.randint(20, 40)], *rng.sample(pool, rng.randint(0, 8))}
            sets.append(np.array(sorted(s), np.uint64))
        got = list(range(25))
        sizes, maps = np.array(list(map(len, sets))), list(map(bitmap, sets))
        allowed = [*range(25)]
        for i, j in compare(sizes, maps, np.zeros(25, int), 80):
            allowed = [allowed[i] if g == allowed[j] else g for g in allowed]
        for i, j in compare(sizes, maps, np.zeros(25, int), 80, sets=sets):
            assert allowed[i] == allowed[j]
            assert 100 * overlap(sets[i], sets[j]) >= 80 * len(np.union1d(sets[i], sets[j]))
            got = [got[i] if g == got[j] else g for g in got]
        want = list(range(25))
        for i in range(25):
            for j in range(i):
                if 100 * overlap(sets[i], sets[j]) >= 80 * len(np.union1d(sets[i], sets[j])):
                    want = [want[i] if g == want[j] else g for g in want]
        assert [[g == h for h in got] for g in got] == [[g == h for h in want] for g in want]


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(6)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        a, b = np.sort(rng.choice(pool, int(rng.integers(1, 200)), False)), np.sort(rng.choice(pool, int(rng.integers(1, 200)), False))
        x, y = folded([bitmap(a), bitmap(b)])
        assert overlap(a, b) <= len(a) - int(np.bitwise_count(x & ~y).sum())
        assert overlap(a, b) <= len(b) - int(np.bitwise_count(y & ~x).sum())


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95), (7, 7), (300, 300), (None, 5)]
    got = connected(spark.createDataFrame(links, "a long, b long").repartition(7))
    want = {i: 1 for i in range(1, 61)} | {100: 90, 90: 90, 95: 90, 300: 300}
    assert {r.node: r.component for r in got.collect()} == want


def test_leaves_of_hubs_wait_for_the_rounds(spark, monkeypatch):
    """A hub's links go through no round's joins; the ends of a path and lone pairs come out right."""
    rows, plain = [], components.staged
    monkeypatch.setattr(components, "staged", lambda df, label: (out := plain(df, label), rows.append((label, out.count())))[0])
    links = [(1, i) for i in range(10, 2000)] + [(i, i + 1) for i in range(3000, 3030)] + [(5000, 4000), (1999, 2), (7, 7)]
    got = connected(spark.createDataFrame(links, "a long, b long").repartition(7))
    want = {i: 1 for i in (1, 2, *range(10, 2000))} | {i: 3000 for i in range(3000, 3031)} | {4000: 4000, 5000: 4000, 7: 7}
    assert {r.node: r.component for r in got.collect()} == want
    assert max(n for label, n in rows if label == "stars") < 100


def test_a_key_leads_to_the_first_of_its_sizes(spark):
    """One link a set, to the smallest of its segment; a gap of more than 1/s begins a new one."""
    sets = [(1, n, 10_000 + n) for n in range(100, 200)] + [(1, n, 10_000 + n) for n in (251, 300, 300)] + [(2, 100, 10_100), (3, 7, 5), (3, 9, 5)]
    frame = spark.createDataFrame(sets, "key long, n long, set_id long")
    place = place_of(F.col("n"), F.col("set_id"))
    at = {(r.n, r.set_id): r.place for r in frame.select("n", "set_id", place.alias("place")).collect()}
    got = sorted(map(tuple, heads(frame.select("key", place.alias("place")).repartition(5), 80).collect()))
    assert got == sorted([(at[n, 10_000 + n], at[100, 10_100]) for n in range(101, 200)] + [(at[300, 10_300], at[251, 10_251])])


def test_limits_below_80_are_refused(none):
    with pytest.raises(ValueError):
        jaccard_components(none, percent=79)


@pytest.mark.parametrize("tile", [2_000_000, 300])
def test_every_link_is_counted(odd, odd_rows, tile):
    """In a group of near copies each document has its own number of links, not those of a spanning tree."""
    base = [f"w{i}" for i in range(120)]
    group = [(5000 + i, " ".join([*base[: 119 - 2 * i], f"x{i}", *base[120 - 2 * i :]])) for i in range(12)]
    group += [(6000 + i, " ".join(base[: 120 - 6 * i])) for i in range(8)] + [(7000, " ".join(base)), (7000, " ".join(base))]
    rows = [(d, t) for d, t, *_ in odd_rows] + group
    docs = odd.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {d: shingles(t) for d, t in rows if d is not None}
    linked = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    want = {d: sum(linked(s, t) for e, t in sets.items() if e != d) for d, s in sets.items()}
    got = jaccard_links(docs, tile_elements=tile).collect()
    assert len(got) == len(rows) and {r.n_links for r in got if r.doc_id is None} == {0}
    assert {r.doc_id: r.n_links for r in got if r.doc_id is not None} == want and max(want.values()) > 10
