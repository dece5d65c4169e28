"""Language-model scoring: a byte model (prediction by partial matching) beside a word base line.

1. One pass gives, per task, the distinct words of the training texts and the distinct byte runs of all texts with their
   counts; Spark sums them. Both tables grow with the input and leave nothing out.
2. The byte runs make the context trie's tables, and each distinct run has its chance from them (`context_table`).
3. The `cached` most frequent runs and the `head` most frequent words are broadcast as a cache of a fixed largest size;
   they settle most bytes and tokens inside the scan. A text's other runs and words are joined with the whole tables,
   where none is frequent enough to be hot. Texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.llm import context_table, ppm
from weekgrid.llm.memory import few_rows, lean, release
from weekgrid.llm.words import chunks, word_hashes
from weekgrid.operators.staging import staged

_WORDS, _GRAMS = 0, 1


def _merged(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, *_ in parts]), return_inverse=True)
    out = [keys]
    for column in (1, 2):
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at, np.concatenate([p[column] for p in parts]))
        out.append(counts)
    return out


def _count(order: int, most: int = 1_500_000):
    """Distinct words of training texts and byte runs of all texts, in rows of (kind, key, n, m); a text's end is counted later.

    n counts the training texts, m all.
    """

    def rows(kind: int, parts: list) -> pa.RecordBatch:
        keys, n, m = _merged(parts)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n), pa.array(m)],
            names=["kind", "key", "n", "m"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {_WORDS: [], _GRAMS: []}
        for batch in batches:
            learn = batch.column("learn").to_pylist()
            for start, raw in chunks(batch.column("text").to_pylist()):
                for taught in (True, False):
                    some = [r for r, own in zip(raw, learn[start : start + len(raw)], strict=True) if own == taught]
                    if not some:
                        continue
                    keys, m = ppm.grams(some, order)
                    held[_GRAMS].append((keys, m if taught else np.zeros_like(m), m))
                    if taught:
                        keys, m = np.unique(word_hashes(some)[0], return_counts=True)
                        held[_WORDS].append((keys, m, m))
                for kind, parts in held.items():
                    if sum(len(k) for k, *_ in parts) > most:
                        yield rows(kind, parts)
                        held[kind] = []
        for kind, parts in held.items():
            if parts:
                yield rows(kind, parts)

    return run


def _looked_up(keys: np.ndarray, names: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted names, and their values; 0 for others."""
    if not len(names):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    known = names[at] == keys
    return known, np.where(known, values[at], 0.0)


def _settled(keys: np.ndarray, begins: np.ndarray, cache: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Per text: how many of its keys the cache knows, the sum of their values, the keys left."""
    each, at = np.unique(keys, return_inverse=True)
    known, values = _looked_up(each, *cache)
    known, values = known[at], values[at]
    gain = np.concatenate([[0.0], np.cumsum(values)])
    hits = np.concatenate([[0], np.cumsum(known)])
    left = pa.ListArray.from_arrays(pa.array(begins - hits[begins], pa.int32()), pa.array(keys[~known].view(np.int64)))
    return np.diff(hits[begins]), np.diff(gain[begins]), left


def _score(order: int, runs, head):
    """Per text: its tokens, what the caches know of its words and byte runs, and those left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in chunks(batch.column("text").to_pylist()):
                hashes, begins = word_hashes(raw)
                known, gain, words = _settled(hashes, begins, head.value)
                ends = np.cumsum([0, *(len(r) + 1 for r in raw)])
                _, score, left = _settled(ppm.codes(raw, order), ends, runs.value)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(start, len(raw)),
                        batch.column("doc_id").slice(start, len(raw)),
                        pa.array(np.diff(begins) + 1),
                        pa.array(known),
                        pa.array(gain),
                        pa.array(score),
                        words,
                        left,
                    ],
                    names=["row", "doc_id", "n_tokens", "head_known", "head_gain", "head_score", "words", "runs"],
                )

    return run


def _sorted_cache(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names = keys.view(np.uint64)
    by_name = np.argsort(names)
    return names[by_name], values[by_name]


def most_frequent(counts: DataFrame, rows: int, fine: int = 100_000, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, n) and columns of `also` of the keys whose count reaches the lowest limit that at most `rows` keys reach.

    Keys are counted by count first, so nothing is sorted. Counts above `fine` are not told apart: were there more
    than `rows` of them, none would be taken.
    """
    by_count = counts.groupBy(F.least(F.col("n"), F.lit(fine)).alias("n")).count().toArrow()
    n, keys = by_count["n"].to_numpy(), by_count["count"].to_numpy()
    down = np.argsort(-n)
    fit = n[down][np.cumsum(keys[down]) <= rows]
    limit = int(fit.min()) if len(fit) else fine + 1
    return counts.where(F.col("n") >= limit).select("key", "n", *also)


def lm_scores(
    docs: DataFrame, learn: Column, order: int = 5, cached: int = 262_144, head: int = 100_000
) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score.

    `learn` marks the training rows (null: not one). `score` is the byte model's log10 probability of the whole text
    with its end, `base_score` that of the words and the end under add-one unigram counts, `n_known` the tokens met
    in training. A null text counts as empty. Repeated rows teach and come out as often as they occur. With nothing
    to learn from, every byte has an even chance and every token of the base line a chance of 1.
    """
    spark = docs.sparkSession
    plain = few_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = staged(
        plain.select("text", "learn")
        .mapInArrow(lean(_count(order)), "kind int, key long, n long, m long")
        .groupBy("kind", "key")
        .agg(F.sum("n").alias("n"), F.sum("m").alias("m")),
        "lm-counts",
    )
    words = counts.where(F.col("kind") == _WORDS).select("key", "n")
    ends = plain.where("learn").count()
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("key")).first()
    tokens, kinds = total + ends, distinct + (ends > 0)

    chances = staged(context_table.chances(counts.where(F.col("kind") == _GRAMS).select("key", "n", "m"), order), "lm-chances")
    # Both caches have a largest number of rows that the parameters fix; what they lack is joined below.
    often = most_frequent(chances.withColumnRenamed("m", "n"), cached, also=("chance",)).toArrow()
    runs = _sorted_cache(often["key"].to_numpy(), often["chance"].to_numpy())
    del often
    top = most_frequent(words, head).toArrow()
    known = _sorted_cache(top["key"].to_numpy(), np.log10(top["n"].to_numpy() + 1.0))
    cache, frequent = spark.sparkContext.broadcast(runs), spark.sparkContext.broadcast(known)
    del top, runs, known
    release()

    scored = staged(
        plain.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
            lean(_score(order, cache, frequent)),
            "row long, doc_id long, n_tokens long, head_known long, head_gain double, head_score double, words array<long>, runs array<long>",
        ),
        "lm-scores",
    )
    rare = scored.select("row", F.explode("words").alias("key")).join(words, "key")
    rare = rare.select("row", F.lit(1).alias("known"), F.log10(F.col("n") + F.lit(1.0)).alias("gain"), F.lit(0.0).alias("chance"))
    rest = scored.select("row", F.explode("runs").alias("key")).join(chances, "key")
    rest = rest.select("row", F.lit(0).alias("known"), F.lit(0.0).alias("gain"), "chance")
    found = rare.unionByName(rest).groupBy("row").agg(*(F.sum(c).alias(f"tail_{c}") for c in ("known", "gain", "chance")))
    ended = 1 if ends else 0
    base = F.col("head_gain") + F.coalesce("tail_gain", F.lit(0.0)) + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(math.log10(tokens + kinds + 1))
    return scored.drop("words", "runs").join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + ended).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("head_score") + F.coalesce("tail_chance", F.lit(0.0))).alias("score"),
    )
