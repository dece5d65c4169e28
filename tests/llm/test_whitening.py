"""Whitening against numpy's eigenvectors and exact whole-number arithmetic."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from weekgrid.llm import queries
from weekgrid.llm.qd import bidiagonal, dqds, right_singular
from weekgrid.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, n int, component int"


def plain(pairs, most=8):
    """The contract, slowly: whole numbers, covariance, numpy's eigenvectors."""
    good = [(i, v) for i, v in pairs if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(column) for column in zip(*x, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    return [i for i, _ in good], n, deviation, values, centred @ vectors / np.sqrt(values), values / centred.var(axis=0).sum()


def by_row(rows, ids, k):
    out = {}
    for r in rows:
        out.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(out) == sorted(ids) and all(sorted(c) == list(range(1, k + 1)) for c in out.values())
    return out


def check(rows, pairs, k=8):
    ids, n, deviation, _, white, share = plain(pairs, k)
    got = by_row(rows, ids, k)
    for c in range(k):
        mine = np.array([got[i][c + 1].whitened for i in ids])
        sign = np.sign(mine @ white[:, c])
        assert np.allclose(mine * sign, white[:, c], rtol=1e-8, atol=1e-8)
        assert {got[i][c + 1].n for i in ids} == {n}
        assert [got[i][c + 1].deviation for i in ids] == deviation
        assert all(math.isclose(got[i][c + 1].explained, share[c], rel_tol=1e-9) for i in ids)
    assert all(r.identity_error < 1e-9 for r in rows)
    assert len({r.identity_error for r in rows}) == 1


@pytest.mark.parametrize("parts", [1, 40])
def test_rows_with_nulls_and_repeats(spark, parts):
    rng = np.random.default_rng(1)
    pairs = [(i, (rng.normal(size=12) * np.arange(1, 13)).astype(np.float32).tolist()) for i in range(150)]
    hole, gap, far = pairs[0][1].copy(), pairs[1][1].copy(), pairs[2][1].copy()
    hole[3], gap[4], far[5] = None, float("nan"), float("-inf")
    rows = [*pairs, (200, None), (201, hole), (202, gap), (203, far), (204, []), (205, pairs[3][1]), (206, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA).repartition(parts)
    check(whiten(frame, fan=3).collect(), [*pairs, (205, pairs[3][1])])


def test_repeated_and_null_ids_come_out_as_they_came_in(spark):
    rows = [(1, [0.1, 0.2], 0, 0), (1, [0.1, 0.2], 0, 0), (None, [0.3, -0.4], 0, 0), (2, [0.0, 0.9], 0, 0)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted(
        (str(i), c) for i, *_ in rows for c in (1, 2)
    )


def test_huge_entries_stay_exact_or_null(spark):
    rows = [(i, [1e30 if i == 0 else 0.5 * i, 1.0 * i], 0, 0) for i in range(6)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.deviation for r in got} == {None} and {r.n for r in got} == {6}
    assert all(math.isfinite(r.whitened) for r in got)
    wide = [(i, [1e6 * i, -1e6 * i * i], 0, 0) for i in range(4)]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v, *_ in wide]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((4 * c - t) ** 2 for c, t in zip(x[i], s, strict=True)) for i in range(4)}
    got = whiten(spark.createDataFrame(wide, SCHEMA)).collect()
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 2**63 else None for i, d in want.items()}


def test_fewer_directions_than_components(spark):
    flat = spark.createDataFrame([(i, [0.5 * i, 1.0 * i, 2.0], 0, 0) for i in range(5)], SCHEMA)
    got = whiten(flat).collect()
    assert {r.component for r in got} == {1} and math.isclose(got[0].explained, 1.0)
    same = spark.createDataFrame([(i, [0.5, 1.0], 0, 0) for i in range(5)], SCHEMA)
    assert whiten(same).collect() == []
    empty = whiten(same.limit(0))
    assert empty.collect() == [] and empty.columns == whiten(flat).columns


def test_query_over_the_whole_table(spark, sf):
    rows = queries.op12_embedding_whitening(spark, sf).collect()
    pairs = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, pairs)


@pytest.mark.parametrize("seed", range(30))
def test_singular_values_and_vectors(seed):
    rng = np.random.default_rng(seed)
    m = int(rng.integers(1, 50))
    a = rng.normal(size=(3 * m, m)) * np.exp(rng.normal(size=m) * rng.choice([0, 1, 5]))
    if seed % 4 == 1:
        a[:, -1] = a[:, 0]
    if seed % 4 == 2:
        a = np.linalg.qr(a)[0] * np.repeat([3.0, 1.0], [m // 2, m - m // 2])
    r = np.linalg.qr(a, mode="r")
    squares, vectors = right_singular(r, 8)
    true = np.linalg.svd(a, compute_uv=False) ** 2
    k = vectors.shape[1]
    assert np.allclose(squares[:k], true[:k], rtol=1e-9) and k == min(8, np.linalg.matrix_rank(a))
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-10
    assert np.abs(a.T @ (a @ vectors) - vectors * squares[:k]).max() < 1e-7 * true[0]


def test_small_values_keep_their_digits():
    """Values of a graded bidiagonal matrix, whose squares' product is that of its diagonal."""
    d, f = 10.0 ** -np.arange(0, 24, 2), 10.0 ** -np.arange(1, 23, 2)
    values = dqds(d * d, f * f)
    assert math.isclose(np.log(values).sum(), np.log(d * d).sum(), rel_tol=1e-13)


def test_bidiagonal_form_keeps_the_values():
    a = np.random.default_rng(2).normal(size=(9, 9))
    d, f, _ = bidiagonal(a)
    assert np.allclose(np.linalg.svd(np.diag(d) + np.diag(f, 1), compute_uv=False), np.linalg.svd(a, compute_uv=False))
