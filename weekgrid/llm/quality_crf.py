"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are buckets of its own shape (length, case, symbols, repetition) and those of
the lines before and after it; a line's label leans on its neighbours' labels by the chain's transitions. Labels come
with documents, so each line is taught its document's label. Forward-backward gives each line's chance to be good; a
document's score is their mean, weighted by the lines' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.llm.shared import labelled
from weekgrid.llm.words import chunks, word_hashes

_SYMBOLS = frozenset(b"#*$%&|<>@^~_=+{}[]\\")
_KINDS = {
    "upper": np.array([65 <= b <= 90 for b in range(256)]),
    "letter": np.array([chr(b).isalpha() and b < 128 or b > 127 for b in range(256)]),
    "digit": np.array([48 <= b <= 57 for b in range(256)]),
    "symbol": np.array([b in _SYMBOLS for b in range(256)]),
    "bar": np.array([b == 124 for b in range(256)]),
    "loud": np.array([b in b"!?" for b in range(256)]),
    "stop": np.array([b in b".,;:" for b in range(256)]),
    "blank": np.array([b in b" \t\r\v\f" for b in range(256)]),
}
#: Buckets of each feature: its values' upper borders.
_BORDERS = {
    "bytes": (0, 4, 16, 40, 80, 160, 320, 640, 1280, 5000),
    "words": (0, 1, 3, 8, 20, 60, 200),
    "upper": (0.0, 0.02, 0.06, 0.15, 0.4, 0.8),
    "letter": (0.3, 0.5, 0.65, 0.75, 0.9),
    "digit": (0.0, 0.02, 0.1, 0.3),
    "symbol": (0.0, 0.01, 0.04, 0.1, 0.25),
    "bar": (0.0, 0.02, 0.08),
    "loud": (0.0, 0.01, 0.04, 0.1),
    "stop": (0.0, 0.01, 0.03, 0.08, 0.2),
    "word_size": (2.0, 3.0, 4.0, 5.0, 6.5, 9.0, 14.0),
    "distinct": (0.2, 0.4, 0.6, 0.8, 0.95),
    "seen": (0.5,),
    "place": (0.5,),
}
_WIDTHS = [len(b) + 1 for b in _BORDERS.values()]
#: A line's features, then those of the line before and after; one more bucket each for "no such line".
N_FEATURES = 3 * (sum(_WIDTHS) + len(_WIDTHS))


def lines(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids (one row a line), weights (bytes + 1), and where each text's lines begin (one more at the end).

    Lines end at line breaks; an empty text is one empty line.
    """
    parts, repeated, begins = [], [], [0]
    for r in raw:
        own = r.split(b"\n")
        met: set[bytes] = set()
        for line in own:
            repeated.append(line in met)
            if line.strip():
                met.add(line)
        parts += own
        begins.append(len(parts))
    begins = np.array(begins)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends = np.cumsum(size + 1) - 1

    def count(kind: str) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(_KINDS[kind][data])])
        return total[ends] - total[ends - size]

    n = {kind: count(kind) for kind in _KINDS}
    ink = np.maximum(1, size - n["blank"])
    hashes, word_begins = word_hashes(parts)
    words = np.diff(word_begins)
    by_line = np.lexsort((hashes, np.repeat(np.arange(len(parts)), words)))
    line = np.repeat(np.arange(len(parts)), words)
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[by_line][1:] != hashes[by_line][:-1]) | (line[1:] != line[:-1])
    distinct = np.bincount(line, new, len(parts))
    values = {
        "bytes": size, "words": words, "upper": n["upper"] / np.maximum(1, n["letter"]), "letter": n["letter"] / ink,
        "digit": n["digit"] / ink, "symbol": n["symbol"] / ink, "bar": n["bar"] / ink, "loud": n["loud"] / ink, "stop": n["stop"] / ink,
        "word_size": ink / np.maximum(1, words), "distinct": distinct / np.maximum(1, words),
        "seen": np.array(repeated, float), "place": np.isin(np.arange(len(parts)), begins[:-1]).astype(float),
    }
    own = np.stack([np.searchsorted(_BORDERS[k], values[k], "left") for k in _BORDERS], axis=1)
    offsets = np.cumsum([0, *(w + 1 for w in _WIDTHS)])
    one = own + offsets[:-1]
    none = offsets[:-1] + np.array(_WIDTHS)
    before, after = np.roll(one, 1, axis=0), np.roll(one, -1, axis=0)
    before[begins[:-1]] = none
    after[begins[1:] - 1] = none
    return np.concatenate([one, before + offsets[-1], after + 2 * offsets[-1]], axis=1).astype(np.int16), size + 1, begins


def marginals(scores: np.ndarray, begins: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's chance to be good, and per text the expected number of each transition (text, from, to).

    `scores` are the lines' log odds to be good on their own, `chain[i, j]` the log weight of label i before label j.
    All texts advance together, a line at a time; the longest come first, so those still running are a prefix.
    """
    lengths = np.diff(begins)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = begins[:-1][order], lengths[order]
    running = lambda t: int(np.searchsorted(-lengths, -t, "left"))  # noqa: E731  texts with more than t lines
    emit = np.stack([np.zeros(len(scores)), scores], axis=1)
    ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
    longest = int(lengths[0]) if len(lengths) else 0
    for t in range(longest):
        at = starts[: running(t)] + t
        if t == 0:
            ahead[at] = emit[at]
        else:
            ahead[at] = emit[at] + np.logaddexp(ahead[at - 1, :1] + chain[0], ahead[at - 1, 1:] + chain[1])
    edges = np.zeros((len(order), 2, 2))
    whole = np.logaddexp(*ahead[starts + lengths - 1].T)
    for t in range(longest - 2, -1, -1):
        m = running(t + 1)
        at = starts[:m] + t
        later = emit[at + 1] + behind[at + 1]
        behind[at] = np.logaddexp(chain[:, 0] + later[:, :1], chain[:, 1] + later[:, 1:])
        edges[order[:m]] += np.exp(ahead[at][:, :, None] + chain + later[:, None, :] - whole[:m, None, None])
    both = ahead + behind
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60))), edges


def train(examples: list[tuple[int, bytes]], rounds: int = 120, rate: float = 0.15, l2: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and transitions that maximise the labels' likelihood, each document weighing the same."""
    weights, chain = np.zeros(N_FEATURES), np.zeros((2, 2))
    if len({y for y, _ in examples}) < 2:
        return weights, chain
    ids, _, begins = lines([raw for _, raw in examples])
    y, count = np.array([y for y, _ in examples]), np.diff(begins)
    share = np.repeat(1 / (count * len(count)), count)
    truth = np.repeat(y, count)
    steps = np.zeros((len(y), 2, 2))
    steps[np.arange(len(y)), y, y] = count - 1
    first, second = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for k in range(1, rounds + 1):
        good, edges = marginals(weights[ids].sum(axis=1), begins, chain)
        node = np.bincount(ids.ravel(), np.repeat((good - truth) * share, ids.shape[1]), N_FEATURES)
        edge = ((edges - steps) / (count * len(count))[:, None, None]).sum(axis=0).ravel()
        g = np.concatenate([node + l2 * weights, edge + 10 * l2 * chain.ravel()])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        move = rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        weights -= move[:N_FEATURES]
        chain -= move[N_FEATURES:].reshape(2, 2)
    return weights, chain


def score(weights: np.ndarray, chain: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Each text's length-weighted mean chance of its lines to be good."""
    ids, size, begins = lines(raw)
    good, _ = marginals(weights[ids].sum(axis=1), begins, chain)
    total = lambda x: np.add.reduceat(x, begins[:-1])
    return total(good * size) / total(size.astype(float))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, chain = model.value
        for batch in batches:
            for start, raw in chunks(batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(raw)), pa.array(score(weights, chain, raw))], names=["doc_id", "score"]
                )

    return run


def quality(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 2_000) -> DataFrame:
    """(doc_id, score, predicted) for every row of `docs` (doc_id, text); score from 0 to 1, predicted 1 from 0.5 on.

    `learn` is a condition on the labels' doc_id. Null and empty texts are one empty line and scored as such; null and
    repeated doc_ids come out as they came in. Without labels of both classes every score is 0.5.
    """
    sample = labelled(docs, labels, "quality", learn, per_class).toArrow()
    texts = (t.encode("utf-8", "surrogatepass") for t in sample["text"].to_pylist())
    model = train(sorted(zip(sample["y"].to_pylist(), texts, strict=True)))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = plain.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
