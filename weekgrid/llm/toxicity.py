"""Toxicity: logistic regression, learned by FTRL-proximal, over hashed word n-grams and skip-grams.

A feature is a word, two neighbouring words, or two words with one between them, each present or not. Words here are
runs of letters and digits. Per-coordinate rates let rare features learn fast; the L1 term keeps all others at exactly
zero, so the weights to broadcast are few, and at most `2**bits`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekgrid.llm.memory import few_rows, lean
from weekgrid.llm.shared import labelled
from weekgrid.llm.words import LETTERS, chunks, mix, word_hashes

_KINDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707345), np.uint64(0xA4093822299F31D1))


def features(raw: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, repeats included, and the text each one is of."""
    words, begins = word_hashes(raw, LETTERS)
    text = np.repeat(np.arange(len(raw)), np.diff(begins))
    shift, odd = np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15)
    ids, owner = [mix(words ^ _KINDS[0]) >> shift], [text]
    for gap in (1, 2):
        same = text[gap:] == text[:-gap]
        pair = mix((words[:-gap] ^ _KINDS[gap]) * odd + words[gap:])[same]
        ids.append(pair >> shift)
        owner.append(text[gap:][same])
    return np.concatenate(ids).astype(np.int32), np.concatenate(owner)


def _examples(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in chunks(batch.column("text").to_pylist()):
                ids, owner = features(raw, bits)
                rows = [np.unique(ids[owner == i]) for i in range(len(raw))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("y").slice(start, len(raw)), pa.array(rows, pa.list_(pa.int32()))], names=["y", "ids"]
                )

    return run


def ftrl(
    examples: list[tuple[int, np.ndarray]], bits: int, epochs: int = 6, alpha: float = 3.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1
) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and values of the weights that are not zero, and the bias; the examples are learned in a fixed mixed order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = bias_n = 0.0
    order = np.random.default_rng(7)
    rate = lambda at: -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            y, at = examples[i]
            w = np.where(np.abs(z[at]) > l1, rate(at), 0.0)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            bias_n += g * g
            bias -= alpha / (beta + np.sqrt(bias_n)) * g
    places = np.flatnonzero(np.abs(z) > l1)
    return places, rate(places), float(bias)


def _score(weights, bits: int, text: int, keep: int, out: str = "score"):
    """Batches whose column at `text` is the text; the first `keep` columns are handed on, then comes the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values, bias = weights.value
        table = np.zeros(1 << bits, np.float32)
        table[places] = values
        for batch in batches:
            for start, raw in chunks(batch.column(text).to_pylist(), 256_000):
                ids, owner = features(raw, bits)
                some = np.flatnonzero(table[ids])
                # A feature counts once a text.
                pairs = np.unique(owner[some].astype(np.int64) << bits | ids[some])
                sums = np.bincount(pairs >> bits, table[pairs & ((1 << bits) - 1)], len(raw)) + bias
                scores = pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))
                kept = [batch.column(i).slice(start, len(raw)) for i in range(keep)]
                yield pa.RecordBatch.from_arrays([*kept, scores], names=[*batch.schema.names[:keep], out])

    return run


def train(docs: DataFrame, labels: DataFrame, learn: Column, bits: int = 20, per_class: int = 4_000):
    """Weights from at most `per_class` labelled documents of either class; without both classes only a bias."""
    sample = labelled(docs, labels, "toxic", learn, per_class).mapInArrow(lean(_examples(bits)), "y int, ids array<int>").toArrow()
    pairs = zip(sample["y"].to_pylist(), (np.asarray(x) for x in sample["ids"].to_numpy()), strict=True)
    examples = sorted(pairs, key=lambda e: (e[0], len(e[1]), e[1].tobytes()))
    if len({y for y, _ in examples}) < 2:
        return np.empty(0, np.int64), np.empty(0), 5.0 if any(y for y, _ in examples) else -5.0
    return ftrl(examples, bits)


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, bits: int = 20, per_class: int = 4_000) -> DataFrame:
    """(doc_id, score, predicted) for every row of `docs` (doc_id, text); score from 0 to 1, predicted 1 from 0.5 on.

    `learn` is a condition on the labels' doc_id. Null and empty texts have no features and the bias as score; null and
    repeated doc_ids come out as they came in. Without toxic labels nothing is toxic.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, learn, bits, per_class))
    plain = few_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = plain.mapInArrow(lean(_score(weights, bits, 1, 1)), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def only_clean(docs: DataFrame, labels: DataFrame, learn: Column, bits: int = 20, per_class: int = 4_000) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not predicted to be toxic; every row answers for itself."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, learn, bits, per_class))
    names = docs.columns
    carried = few_rows(docs).select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)))
    schema = T.StructType([*carried.schema.fields, T.StructField("_score", T.DoubleType())])
    judged = carried.mapInArrow(lean(_score(weights, bits, names.index("text"), len(names), "_score")), schema).where("_score < 0.5")
    return judged.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)))
