"""Counting of pairs by sorted runs: radix-partitioned, zstd-packed, merged by heap, streamed back.

A record says that a document holds a pair of ids, and how many times. A task sorts the records of some thousand
documents (a flush), side-major: by first id, then second id, then document. It deals them by the first id's lowest
digits to buckets and packs each bucket's part as one run: `heads` has the distinct pairs with their numbers of documents, `body` the documents and
times behind them. Runs are rows of a table in the shared folder, so a lost executor costs no records, and Spark's
shuffle moves packed bytes, not records.

Heads are merged by a heap, `fan` runs to one, in rounds, until a bucket is one run. As the order is side-major, all
pairs of a first id pass one after the other and its maximum is known when the next one comes. The merged runs then go back to the bodies:
a bucket's runs are split into parts of about `fan`, each part gets the bucket's merged heads, and every run gives its
flush the sums for its documents. A first id that a third of all records share fills one bucket's bodies, which are many parts, and adds no more to
the heads than its distinct pairs.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrid.operators.staging import discard, staged

RUN = "bucket int, flush long, heads binary, body binary"


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0 on, each in the narrowest type that holds it."""
    head, raw = [struct.pack("<B", len(columns))], []
    for column in columns:
        top = int(column.max()) if len(column) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
        head.append(struct.pack("<BI", width, len(column)))
        raw.append(column.astype(f"<u{width}").tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(head + raw))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    (columns,) = struct.unpack_from("<B", data)
    at, out = 1 + 5 * columns, []
    for i in range(columns):
        width, rows = struct.unpack_from("<BI", data, 1 + 5 * i)
        out.append(np.frombuffer(data, f"<u{width}", rows, at).astype(np.int64))
        at += width * rows
    return out


def _steps(pairs: np.ndarray) -> np.ndarray:
    return np.diff(pairs, prepend=0)


def runs(pairs: np.ndarray, docs: np.ndarray, times: np.ndarray, second: int, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, heads, body) of records sorted by pair and document; a pair is first id * `second` + second id."""
    radix = (pairs // second) % buckets
    order = np.argsort(radix, kind="stable")
    pairs, docs, times, radix = pairs[order], docs[order], times[order], radix[order]
    edges = np.flatnonzero(np.diff(radix, prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        each, held = np.unique(pairs[a:b], return_counts=True)
        yield int(radix[a]), pack(_steps(each), held), pack(docs[a:b], times[a:b])


def _merged(blobs: list[bytes]) -> Iterator[tuple[int, int]]:
    """Distinct pairs of sorted runs in order, with the sum of their numbers."""

    def entries(blob: bytes) -> Iterator[tuple[int, int]]:
        steps, held = unpack(blob)
        return zip(np.cumsum(steps).tolist(), held.tolist(), strict=True)

    last, total = -1, 0
    for pair, n in heapq.merge(*map(entries, blobs)):
        if pair != last:
            if last >= 0:
                yield last, total
            last, total = pair, 0
        total += n
    if last >= 0:
        yield last, total


def _merge(table: pa.Table) -> pa.Table:
    """One run of heads out of a group's."""
    both = np.array(list(_merged(table["heads"].to_pylist())), np.int64).reshape(-1, 2)
    heads = pack(_steps(both[:, 0]), both[:, 1])
    return pa.table({"bucket": table["bucket"][:1], "part": table["part"][:1], "heads": pa.array([heads], pa.binary())})


def _best(second: int):
    """Marks in a bucket's last merge: 1 where a pair's number is the highest of its first id."""

    def run(table: pa.Table) -> pa.Table:
        pairs, held, best = [], [], []
        first, waiting = -1, 0  # numbers from `waiting` on are of the same first id

        def close() -> None:
            top = max(held[waiting:], default=0)
            best.extend(int(n == top) for n in held[waiting:])

        for pair, n in _merged(table["heads"].to_pylist()):
            if pair // second != first:
                close()
                first, waiting = pair // second, len(held)
            pairs.append(pair)
            held.append(n)
        close()
        counts = pack(_steps(np.array(pairs, np.int64)), np.array(held, np.int64), np.array(best, np.int64))
        return pa.table({"bucket": table["bucket"][:1], "counts": pa.array([counts], pa.binary())})

    return run


def counted(spilled: DataFrame, second: int, parts: int, fan: int = 64) -> DataFrame:
    """(bucket, counts): each bucket's pairs, how many documents hold them, and whether that is the first id's maximum."""
    heads = spilled.select("bucket", F.pmod(F.xxhash64("flush"), F.lit(parts)).cast("int").alias("part"), "heads")
    while parts > 1:
        parts = -(-parts // fan)
        merged = heads.groupBy("bucket", "part").applyInArrow(_merge, "bucket int, part int, heads binary")
        heads = merged.withColumn("part", F.col("part") % F.lit(parts))
    return heads.groupBy("bucket").applyInArrow(_best(second), "bucket int, counts binary")


def _back(spilled: pa.Table, counts: pa.Table) -> pa.Table:
    """For each run, by its flush's documents: times of the best pairs, and times by number of documents."""
    flushes, sums = [], []
    if spilled.num_rows:
        steps, held, best = unpack(counts["counts"][0].as_py())
        pairs = np.cumsum(steps)
        for flush, heads, body in zip(*(spilled[c].to_pylist() for c in ("flush", "heads", "body")), strict=True):
            mine, each = unpack(heads)
            at = np.repeat(np.searchsorted(pairs, np.cumsum(mine)), each)
            docs, times = unpack(body)
            total, top = np.zeros(docs.max() + 1, np.int64), np.zeros(docs.max() + 1, np.int64)
            np.add.at(total, docs, times * held[at])
            np.add.at(top, docs, times * best[at])
            flushes.append(flush)
            sums.append(pack(top, total))
    return pa.table({"flush": pa.array(flushes, pa.int64()), "sums": pa.array(sums, pa.binary())})


def _gather(table: pa.Table) -> pa.Table:
    """A flush's sums over all buckets, a row a document."""
    each = [unpack(s) for s in table["sums"].to_pylist()]
    size = max(len(top) for top, _ in each)
    top, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for a, b in each:
        top[: len(a)] += a
        total[: len(b)] += b
    flush = np.full(size, table["flush"][0].as_py())
    return pa.table({"flush": flush, "at": np.arange(size, dtype=np.int32), "best": top, "total": total})


def parts_of(spilled: DataFrame, fan: int = 64) -> int:
    """Into how many parts a bucket's runs are split."""
    return max(1, -(-spilled.select("flush").distinct().count() // fan))


def contributions(spilled: DataFrame, second: int, fan: int = 64) -> DataFrame:
    """(flush, at, best, total) for the documents of all runs (columns of RUN)."""
    parts = parts_of(spilled, fan)
    counts = staged(counted(spilled, second, parts, fan), "pair-counts")
    dealt = counts.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "counts")
    mine = spilled.withColumn("part", F.pmod(F.xxhash64("flush"), F.lit(parts)).cast("int"))
    met = mine.groupBy("bucket", "part").cogroup(dealt.groupBy("bucket", "part")).applyInArrow(_back, "flush long, sums binary")
    gathered = met.groupBy("flush").applyInArrow(_gather, "flush long, at int, best long, total long")
    out = staged(gathered, "pair-sums")
    discard(counts)
    return out
