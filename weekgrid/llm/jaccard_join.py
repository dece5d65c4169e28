"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmaps, then sorted arrays.

A document's set holds its distinct word shingles. Two sets link when their Jaccard similarity reaches a limit of 0.8
or more, given in hundredths and tested in whole numbers.

1. *Copies.* Equal sets are one set from here on; (hash of the set, size) names it.
2. *Tiles.* Let A and B link, a elements be only in A and b only in B. With s the limit, a + s*b <= (1-s)*|A|, so the
   first t = floor(2(1-s)|A|) + 2 elements of A in hash order hold t-a common ones, parted by at most a+b others into
   at most a+b+1 runs, and t - a >= a+b+2: two neighbours of the order are common and have nothing between them. The same
   holds for B, and of the two prefixes the one that ends first lies inside the other. So linked sets share a pair of
   neighbours within both prefixes. Sets that share one, in the order of their sizes and cut where a size is more than
   1/s times the one before, form segments, and each set leads to the first of its segment; the segments' components
   are small, and no link leaves one. A component's sets fall into size bands of the ratio 1/s, and large bands into blocks; a tile compares a block with
   itself, a later block of its band or a block of the next band.
3. *Bitmaps.* Every set has a bitmap of its hashed elements. Bits that only one bitmap has are elements that only one
   set has, so bit counts bound the overlap from above. The tiles first meet with bitmaps alone, a fortieth of the
   elements: sets without a possible link drop out, the others form smaller components and tiles anew.
4. *Exact.* In those, elements are moved, and every pair that the bound lets through is counted in the sorted arrays. A
   pair of sets meets in one tile only. A tile gives a row a set: its links, weighed with the other set's documents, and
   the set that stands for those it leads to; so links are counted whole and never a table of pairs.

Nothing but the sets of possible links is moved with its elements. Hot shingles (passages in a third of all
documents) make long segments, a row of two numbers a set, not pairs. Copies go before the shuffle, once per task. Elements are 64-bit
hashes; sets are taken as equal when size and 64-bit set hash agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekgrid.llm.components import connected
from weekgrid.llm.memory import few_rows, lean
from weekgrid.llm.words import chunks, mix, shingle_sets
from weekgrid.operators.staging import staged

_PAIR = np.uint64(0x9E3779B97F4A7C15)


def set_id(elements: np.ndarray) -> int:
    """A hash of a sorted set, as a signed long."""
    places = np.arange(1, len(elements) + 1, dtype=np.uint64)
    return int(mix(elements + mix(places * _PAIR)).sum(dtype=np.uint64).astype(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """Each batch with runs of its texts' sets and where the run begins."""
    for batch in batches:
        for start, raw in chunks(batch.column("text").to_pylist()):
            yield batch, start, shingle_sets(raw, size)


def bitmap(elements: np.ndarray) -> np.ndarray:
    """Bits of the elements' lowest bits, 2 to 4 for each element (at least 64), in words."""
    bits = max(64, 1 << (2 * len(elements) - 1).bit_length())
    flags = np.zeros(bits, bool)
    flags[(elements & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """The bitmaps at the size of the smallest: the halves of a larger one laid over each other."""
    words = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, words), axis=0) for m in maps])


def _sizes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start, sets in _sets(batches, size):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(start, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_id", "bitmap"],
            )

    return run


def prefix_runs(elements: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the neighbouring pairs that a linked set must share one of; none for sets that only copies link with."""
    n = len(elements)
    t = min(n, 2 * (100 - percent) * n // 100 + 2)
    if (100 - percent) * n < percent:
        return np.empty(0, np.uint64)
    return mix(elements[: t - 1] * _PAIR + elements[1:t])


_NAME_BITS, _MOST = 40, (1 << 23) - 1


def place_of(n: Column, set_id: Column) -> Column:
    """A set's size and 40 bits of its hash in one long, by size first; sets that share one only share a component."""
    low = set_id.bitwiseAND(F.lit((1 << _NAME_BITS) - 1))
    return F.shiftleft(F.least(n.cast("long"), F.lit(_MOST).cast("long")), _NAME_BITS).bitwiseOR(low)


def _runs(size: int, percent: int):
    """(key, place) of every set's prefix runs; `place` as in `place_of`, for two numbers a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, _, sets in _sets(batches, size):
            keys, places = [], []
            for s in sets:
                if not len(s) or (name := set_id(s)) in seen:
                    continue
                seen.add(name)
                keys.append(prefix_runs(s, percent))
                places.append(min(len(s), _MOST) << _NAME_BITS | name & ((1 << _NAME_BITS) - 1))
            if keys:
                times = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(places, np.int64), times))],
                    names=["key", "place"],
                )

    return run


def _elements(size: int, marks):
    """The sets of the documents that `marks` lets through: all that are wanted, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = marks.value, set()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            at = mark_of(ids, 64 * len(bits))
            keep = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
            for i in np.flatnonzero(keep).tolist():
                # Repeated rows of a document: once a task.
                keep[i] = ids[i] not in seen
                seen.add(ids[i])
            kept = batch.filter(pa.array(keep))
            for _, start, sets in _sets(iter([kept]), size):
                yield pa.RecordBatch.from_arrays(
                    [
                        kept.column("doc_id").slice(start, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n", "elements"],
                )

    return run


def mark_of(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _marked(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(mark_of(batch.column("doc_id").to_numpy(), bits))
            word, first = np.unique(at >> 6, return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    return run


def marks_of(wanted: DataFrame, most_bits: int = 1 << 26) -> np.ndarray:
    """A bitmap of hashed doc_ids, some 16 bits a document but never above `most_bits` (8 MB)."""
    bits = min(most_bits, max(64, 1 << (16 * wanted.count()).bit_length()))
    words = wanted.select("doc_id").mapInArrow(_marked(bits), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def compare(
    sizes: np.ndarray, maps: list[np.ndarray], side: np.ndarray, percent: int, within: bool = True, sets: list[np.ndarray] | None = None
) -> Iterator[tuple[int, int]]:
    """All links among the sets of side 0 (if `within`) and between the sides.

    Without the `sets` themselves: of the links that their bitmaps allow, enough to connect all that these connect.
    """
    order = np.argsort(sizes, kind="stable")
    sizes, side, maps = sizes[order], side[order], folded([maps[i] for i in order])
    group = np.arange(len(order))
    for i in range(len(order)):
        stop = int(np.searchsorted(sizes, 100 * sizes[i] // percent, "right"))
        others = np.arange(i + 1, stop)
        others = others[(side[others] != side[i]) | (within and side[i] == 0)]
        if sets is None:
            others = others[group[others] != group[i]]
        if not len(others):
            continue
        need = -(-percent * (sizes[i] + sizes[others]) // (100 + percent))
        mine, theirs = maps[i], maps[others]
        most = np.minimum(
            sizes[i] - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64),
            sizes[others] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64),
        )
        for j, least in zip(others[most >= need].tolist(), need[most >= need].tolist(), strict=True):
            if sets is not None:
                if overlap(sets[order[i]], sets[order[j]]) >= least:
                    yield int(order[i]), int(order[j])
            elif group[j] != group[i]:
                yield int(order[i]), int(order[j])
                group[group == group[j]] = group[i]


def _possible(percent: int):
    """Links that a tile's bitmaps (set_id, side, n, bitmap) allow."""

    def run(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        _, _, i, j = key
        maps = [np.frombuffer(m, np.uint64) for m in tile["bitmap"]]
        names = tile["set_id"].to_numpy()
        links = list(compare(tile["n"].to_numpy(), maps, tile["side"].to_numpy(), percent, i == j))
        return pd.DataFrame({"a": [names[i] for i, _ in links], "b": [names[j] for _, j in links]}, dtype="int64")

    return run


def _exact(percent: int):
    """Per set of a tile (set_id, side, n, copies, elements) with links: a set it leads to, and the documents it links with."""

    def run(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        _, _, i, j = key
        sets = [np.frombuffer(e, np.uint64) for e in tile["elements"]]
        names, copies = tile["set_id"].to_numpy(), tile["copies"].to_numpy()
        group, links = np.arange(len(sets)), np.zeros(len(sets), np.int64)
        for a, b in compare(tile["n"].to_numpy(), list(map(bitmap, sets)), tile["side"].to_numpy(), percent, i == j, sets):
            links[a] += copies[b]
            links[b] += copies[a]
            if group[a] != group[b]:
                group[group == group[b]] = group[a]
        some = links > 0
        return pd.DataFrame({"a": names[some], "b": names[group[some]], "links": links[some]}, dtype="int64")

    return run


_TILE = ("component", "t_band", "i", "j")


def with_tiles(members: DataFrame, percent: int, tile_elements: int) -> DataFrame:
    """`members` (component, set_id, n and more) with `tiles`, the tiles a set belongs to; sets without any are left out.

    Band k holds the sizes in [r**k, r**(k+1)), r = 100/percent, so links stay in a band or join it with the next.
    A band of more than `tile_elements` elements is dealt into blocks by the set's hash. Tile (k, i, i) compares block i
    of band k with itself and with block 0 of band k+1; tile (k, i, j) compares it with block j > i of the same band or,
    counted on from there, with block j of band k+1. So in a component of one block a band, a set is in two tiles, or
    in one where its band or the next holds no other set.
    """
    ratio = F.log(F.lit(100 / percent))
    banded = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / ratio + 1e-9).cast("int"))
    blocks = banded.groupBy("component", "band").agg(
        F.ceil(F.sum("n") / F.lit(tile_elements)).cast("int").alias("k"), F.count("*").alias("sets")
    )
    after = blocks.select("component", (F.col("band") - 1).alias("band"), F.col("k").alias("k_next"))
    before = blocks.select("component", (F.col("band") + 1).alias("band"), F.col("k").alias("k_last"))
    counts = blocks.join(after, ["component", "band"], "left").join(before, ["component", "band"], "left").na.fill(0, ["k_next", "k_last"])
    placed = banded.join(counts, ["component", "band"]).withColumn("s", F.pmod(F.xxhash64("set_id"), F.col("k")).cast("int"))
    tile = lambda band, i, j, side: F.struct(band.alias("t_band"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    k, s, band = F.col("k"), F.col("s"), F.col("band")
    spread = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<struct<t_band:int,i:int,j:int,side:int>>"))
    alone = (F.col("sets") == 1) & (F.col("k_next") == 0)
    homes = F.concat(
        # Its own tile, later blocks of its band, further blocks of the next band.
        F.filter(spread(k + F.col("k_next"), lambda j: tile(band, s, j, 0)), lambda x: (x["j"] >= s) & (x["j"] != k) & ~alone),
        F.filter(spread(k, lambda i: tile(band, i, s, 1)), lambda x: x["i"] < s),
        # The tiles of the band before.
        spread(F.col("k_last"), lambda i: tile(band - 1, i, F.when(s == 0, i).otherwise(F.col("k_last") + s), 1)),
    )
    return placed.select(*members.columns, homes.alias("tiles")).where(F.size("tiles") > 0)


def heads(runs: DataFrame, percent: int) -> DataFrame:
    """(a, b): for every key of `runs` (key, place), each place with the first of its segment of sizes without a gap."""
    chain = Window.partitionBy("key").orderBy("place")
    n = F.shiftright("place", _NAME_BITS)
    apart = F.coalesce(n * percent > F.lag(n).over(chain) * 100, F.lit(True))
    first = F.last(F.when(F.col("apart"), F.col("place")), ignorenulls=True).over(chain)
    led = runs.select("key", "place", apart.alias("apart")).select(F.col("place").alias("a"), first.alias("b"))
    return led.where("a <> b").distinct()


def jaccard_links(
    docs: DataFrame, size: int = 5, percent: int = 80, tile_elements: int = 2_000_000
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of `docs` (doc_id, text; other columns are not read).

    `component_id` is the smallest doc_id that links lead to, the document's own included; `n_links` counts the other
    doc_ids whose text links with the document's own, copies among them. Null or wordless texts have no shingles and
    only themselves; a row with a null doc_id takes part in no link and has a null component. Repeated rows are copies
    and come out as often as they came in. `percent` is the limit in hundredths, from 80 to 100.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the tiles are complete for limits from 80 to 100 hundredths")
    plain = few_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, set_id long, bitmap binary"
    sized = staged(plain.mapInArrow(lean(_sizes(size)), schema), "shingle-sizes")
    # One document stands for a set; copies are gone after the partial aggregation of each task.
    first = sized.where("set_id is not null and doc_id is not null").groupBy("set_id", F.col("n_shingles").alias("n"))
    first = staged(first.agg(F.min("doc_id").alias("doc_id"), F.first("bitmap").alias("bitmap")), "sets")
    copies = sized.where("set_id is not null and doc_id is not null").select("set_id", "doc_id").distinct()
    copies = staged(copies.groupBy("set_id").agg(F.count("*").alias("copies")), "copies")

    runs = plain.where("text is not null").select("text").mapInArrow(lean(_runs(size, percent)), "key long, place long")
    candidates = staged(connected(heads(runs, percent)), "candidates").withColumnRenamed("node", "place")
    candidates = first.withColumn("place", place_of(F.col("n"), F.col("set_id"))).join(candidates, "place").drop("place")

    tiled = with_tiles(candidates, percent, tile_elements)
    tiled = tiled.select("component", "set_id", "n", "bitmap", F.inline("tiles"))
    possible = tiled.groupBy(*_TILE).applyInPandas(_possible(percent), "a long, b long")
    nearer = staged(connected(possible), "possible").withColumnRenamed("node", "set_id")

    # Tiles are dealt on numbers alone. Then one text of each set left is read again for its elements, which are
    # shuffled to their sets and on to the tiles; a bitmap of the documents wanted keeps all other texts out.
    members = first.select("doc_id", "set_id", "n").join(nearer, "set_id").join(copies, "set_id")
    wanted = staged(with_tiles(members, percent, tile_elements).drop("n"), "wanted")
    marks = docs.sparkSession.sparkContext.broadcast(marks_of(wanted))
    sets = plain.where("doc_id is not null").mapInArrow(lean(_elements(size, marks)), "doc_id long, n long, elements binary")
    tiled = sets.join(wanted, "doc_id").select("component", "set_id", "n", "copies", "elements", F.inline("tiles"))
    links = staged(tiled.groupBy(*_TILE).applyInPandas(_exact(percent), "a long, b long, links long"), "links")
    joined = staged(connected(links.select("a", "b")), "joined")
    known = joined.join(links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), "node", "left")
    known = copies.join(known.withColumnRenamed("node", "set_id"), "set_id", "left").where("component is not null or copies > 1")
    known = known.select(F.col("set_id").alias("node"), "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))

    home = sized.join(known, sized["set_id"] == known["node"], "left").withColumn("class", F.coalesce("component", "set_id"))
    lowest = home.where("set_id is not null").groupBy("class").agg(F.min("doc_id").alias("low"))
    named = F.col("doc_id").isNotNull()
    return home.join(lowest, "class", "left").select(
        "doc_id",
        "n_shingles",
        F.when(named, F.coalesce("low", "doc_id")).alias("component_id"),
        F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"),
    )


def jaccard_components(docs: DataFrame, **options: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of `jaccard_links`."""
    return jaccard_links(docs, **options).drop("n_links")


def one_per_group(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of `docs` that are the smallest document of their group; repeated rows of one doc_id are one document.

    Rows with a null doc_id cannot be told apart and stay.
    """
    groups = jaccard_components(docs, **options)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    unnamed = docs.where(F.col("doc_id").isNull())
    return docs.dropDuplicates(["doc_id"]).join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(unnamed)
