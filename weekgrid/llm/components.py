"""Connected components of a graph given as a table of links, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrid.operators.staging import discard, staged


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and the smallest node each one reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[root(x) for x in range(len(nodes))]]


def _contract(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Links become a star per component of up to `most` links of a task: never more rows, and mostly far fewer."""

    def stars(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        nodes, low = union_find(*map(np.concatenate, zip(*held, strict=True)))
        keep = nodes != low
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(low[keep])], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(a) for a, _ in held) >= most:
            yield stars(held)
            held = []
    if held:
        yield stars(held)


def connected(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): every node of `links` (long columns a, b) with the smallest node it reaches.

    Links of a node with itself keep it as a component of its own; nulls are no links. Nodes that hang on a single
    smaller one wait for its component. Each round runs a large star and a small star over the links left, written to
    the shared folder; the number of rounds grows with the logarithm of the longest path. Only a count and a checksum of
    a round's links come to the driver.
    """
    spark = links.sparkSession
    given = staged(links.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna(), "links")
    # A task leaves a star of each component it meets; dealt by node and contracted again, hardly more links than nodes are left.
    stars = given.where("a <> b").mapInArrow(_contract, "a long, b long").distinct()
    edges = stars.repartition("a").mapInArrow(_contract, "a long, b long").distinct()
    edges = staged(edges, "edges")
    # Per node its links (as the larger end, at most one from each task) and how often it is met at either end.
    ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.lit(None).cast("long").alias("b")))
    ends = staged(ends.groupBy("a").agg(F.count("*").alias("met"), F.collect_list("b").alias("lows")), "ends")
    leaves = ends.where((F.col("met") == 1) & (F.size("lows") == 1)).select("a", F.col("lows")[0].alias("b"))
    table, before = staged(ends.where("met > 1").select("a", F.explode("lows").alias("b")), "stars"), None
    for _ in range(rounds):
        state = table.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        both = table.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        turned = staged(small.where("a <> b").distinct(), "stars")
        discard(table)
        table, before = turned, state
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    lows = table.groupBy("a").agg(F.min("b").alias("low"))
    hung = leaves.join(lows.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("low", "b").alias("low"))
    lows = lows.unionByName(hung)
    nodes = given.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(lows, nodes["node"] == lows["a"], "left").select("node", F.coalesce("low", "node").alias("component"))
