"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

1. Vectors are dealt by hash into shards of about `shard_rows`; each becomes one row that holds its ball tree: nested
   runs of vectors with centre and radius, split along the widest direction. q.c + |q|*r bounds the inner product of
   every vector in a ball.
2. Queries come in blocks of at most `block_rows`. In a first round every query meets each shard's most promising
   leaf only; the k-th best of these scores over all shards is a floor that all shards share.
3. In the second round each shard's tree is bounded from the top, whole branches below a query's floor go, and the
   leaves left are visited in the order of their bounds. A leaf's scores raise the query's floor for the leaves after
   it; a bound equal to the floor is still visited, as ties go to the smaller id.
4. At most k hits a query and shard are merged.

A block meets a shard once a round: as the queries are a given set against all rows, that number is theirs times the
shards, and each meeting moves vectors of a fixed largest size.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekgrid.operators.staging import staged

_EXACT = 2.0**53


def ball_tree(vectors: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and per node (start, stop, left child or -1): nodes hold runs of the order, children later."""
    order = np.arange(len(vectors))
    nodes, at = [[0, len(order), -1]], 0
    while at < len(nodes):
        start, stop, _ = nodes[at]
        if stop - start > leaf:
            part = order[start:stop]
            mean = vectors[part].mean(axis=0)
            far = vectors[part[np.argmax(((vectors[part] - mean) ** 2).sum(axis=1))]]
            other = vectors[part[np.argmax(((vectors[part] - far) ** 2).sum(axis=1))]]
            by = np.argsort(vectors[part] @ (far - other), kind="stable")
            order[start:stop] = part[by]
            middle = start + len(part) // 2
            nodes[at][2] = len(nodes)
            nodes += [[start, middle, -1], [middle, stop, -1]]
        at += 1
    return order, np.array(nodes)


def packed(ids: np.ndarray, vectors: np.ndarray, leaf: int) -> bytes:
    order, nodes = ball_tree(vectors, leaf)
    kept = vectors[order]
    centres = np.stack([kept[a:b].mean(axis=0) for a, b, _ in nodes])
    # Rounded up, so that a bound is never too small.
    radii = np.array([np.sqrt(((kept[a:b] - c) ** 2).sum(axis=1).max()) for (a, b, _), c in zip(nodes, centres, strict=True)]) * (1 + 1e-9)
    file = io.BytesIO()
    np.savez(file, ids=ids[order], vectors=kept, nodes=nodes, centres=centres, radii=radii)
    return file.getvalue()


def bounds(tree, queries: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Upper bounds of all nodes (queries x nodes); -inf below a branch whose bound misses the query's floor."""
    length = np.sqrt((queries**2).sum(axis=1))
    top = queries @ tree["centres"].T + length[:, None] * tree["radii"]
    top += 1e-9 * np.abs(top) + 1e-6
    for node, (_, _, child) in enumerate(tree["nodes"]):
        top[:, node] = np.where(top[:, node] >= floor, top[:, node], -np.inf)
        if child >= 0:
            top[:, child : child + 2] = np.minimum(top[:, child : child + 2], top[:, [node]])
    return top


def best(k: int, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search(tree, names: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, leaves: int | None) -> list[tuple[int, int, int]]:
    """(query, vector, score) of every query's k best in the tree that reach its floor; `leaves` bounds the visits."""
    tree = {name: tree[name] for name in tree.files}
    if max(1, len(queries[0])) * np.abs(tree["vectors"]).max(initial=0) * np.abs(queries).max(initial=0) >= _EXACT:
        raise ValueError("scores beyond 2**53 are not exact here")
    floor = floor.copy()
    last = np.flatnonzero(tree["nodes"][:, 2] < 0)
    top = bounds(tree, queries, floor)[:, last]
    visits = np.argsort(-top, axis=1, kind="stable")
    hit_ids = [np.empty(0, np.int64)] * len(queries)
    hit_scores = [np.empty(0)] * len(queries)
    active = np.arange(len(queries))
    for turn in range(len(last) if leaves is None else min(leaves, len(last))):
        leaf = visits[active, turn]
        active = active[top[active, leaf] >= floor[active]]
        active = active[np.isfinite(top[active, visits[active, turn]])]
        if not len(active):
            break
        leaf = visits[active, turn]
        for x in np.unique(leaf):
            mine = active[leaf == x]
            start, stop, _ = tree["nodes"][last[x]]
            ids = tree["ids"][start:stop]
            for q, row in zip(mine, queries[mine] @ tree["vectors"][start:stop].T, strict=True):
                ok = (row >= floor[q]) & (ids != names[q])
                joined_ids, joined = np.concatenate([hit_ids[q], ids[ok]]), np.concatenate([hit_scores[q], row[ok]])
                keep = best(k, joined_ids, joined)
                hit_ids[q], hit_scores[q] = joined_ids[keep], joined[keep]
                if len(keep) == k:
                    floor[q] = max(floor[q], hit_scores[q][-1])
    return [(q, int(i), int(s)) for q in range(len(queries)) for i, s in zip(hit_ids[q], hit_scores[q], strict=True)]


def _plant(leaf: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack([np.asarray(v, np.float64) for v in shard["vector"]])
        blob = packed(shard["vec_id"].to_numpy(), vectors, leaf)
        return pd.DataFrame({"dim": [shard["dim"][0]], "shard": [shard["shard"][0]], "tree": [blob]})

    return run


def _meet(k: int, leaves: int | None):
    def run(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int]] = []
        if len(trees) and len(asked):
            names = asked["vec_id"].to_numpy()
            queries = np.stack([np.asarray(v, np.float64) for v in asked["vector"]])
            floor = asked["floor"].fillna(-np.inf).to_numpy(np.float64)
            found = search(np.load(io.BytesIO(trees["tree"][0])), names, queries, floor, k, leaves)
            rows = [(int(names[q]), i, s) for q, i, s in found]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, vector, dim): floor(scale * component), for vectors without null or non-finite components; no repeats."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    kept = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector")).withColumn("dim", F.size("vector")).distinct()


def top_k(
    vectors: DataFrame, asked: DataFrame, k: int = 5, scale: int = 256, shard_rows: int = 4096, block_rows: int = 1024, leaf: int = 64
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of `vectors` for each of `asked`, both (vec_id, embedding).

    Scores are inner products of whole numbers; ties go to the smaller vec_id; a query's own id is no candidate.
    Vectors that are null, or hold a null or non-finite component, and null ids take no part, nor do vectors meet those
    of another length. Repeated rows count once; an id with several vectors has its best score.
    """
    spark = vectors.sparkSession
    rows, queries = whole_vectors(vectors, scale), staged(whole_vectors(asked, scale), "asked")
    dealt = lambda n, size: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(max(1, -(-n // size)))).cast("int")
    rows = staged(rows, "vectors")
    n, m = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    grown = rows.withColumn("shard", dealt(n, shard_rows)).groupBy("dim", "shard").applyInPandas(_plant(leaf), "dim int, shard int, tree binary")
    trees = staged(grown, "trees").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    blocked = queries.withColumn("block", dealt(m, block_rows)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    key, schema = ["dim", "shard", "block"], "query_id long, vec_id long, score long"

    def hits(asking: DataFrame, leaves: int | None) -> DataFrame:
        return trees.groupBy(*key).cogroup(asking.groupBy(*key)).applyInPandas(_meet(k, leaves), schema)

    first = hits(blocked.withColumn("floor", F.lit(None).cast("double")), 1)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = lambda found: found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    floors = merged(first).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    floors = staged(floors, "floors")
    second = hits(blocked.join(floors, blocked["vec_id"] == floors["query_id"], "left").drop("query_id"), None)
    return merged(second).select("query_id", "rank", "vec_id", "score")
