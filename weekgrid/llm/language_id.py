"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Subwords are runs of 2 to 4 bytes of the lower-cased text that lie in one word, its borders included as blanks. A text's
vector is the mean of its subwords' embeddings; both layers are learned by stochastic gradient descent. As the softmax
is linear, a trained model is one table of logits by bucket, so whole texts are scored by lookups and sums. A
temperature makes the largest probability a calibrated one, on documents that taught nothing; texts below a limit found
there are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekgrid.llm.memory import few_rows, lean
from weekgrid.llm.words import chunks, mix

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_BLANK = np.array([b <= 32 for b in range(256)])


@dataclass(frozen=True)
class Model:
    langs: list[str]
    logits: np.ndarray  # by bucket and language
    bias: np.ndarray
    temperature: float
    reject_below: float


def subwords(raw: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the texts, and the text each is of."""
    data = np.frombuffer(b"".join(b" " + r + b" " for r in raw), np.uint8)
    blank = _BLANK[data]
    data = np.where(blank, np.uint8(32), data).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), [len(r) + 2 for r in raw])
    shift = np.uint64(64 - bits)
    ids, owners = [], []
    for n in (2, 3, 4):
        m = len(data) - n + 1
        if m <= 0:
            continue
        inside = owner[:m] == owner[n - 1 :]
        for j in range(1, n - 1):
            inside &= ~blank[j : m + j]
        inside &= ~(blank[:m] & blank[n - 1 :]) if n > 2 else ~(blank[:m] | blank[1:])
        code = np.full(m, np.uint64(n))
        for j in range(n):
            code = (code << np.uint64(8)) | data[j : m + j]
        ids.append((mix(code[inside]) >> shift).astype(np.int32))
        owners.append(owner[:m][inside])
    if not ids:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate(ids), np.concatenate(owners)


def means(table: np.ndarray, ids: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """The mean row of `table` over each text's subwords; zero without any."""
    count = np.maximum(1, np.bincount(owner, minlength=texts))
    return np.stack([np.bincount(owner, column[ids], texts) / count for column in table.T], axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    examples: list[tuple[str, str]], bits: int = 16, width: int = 16, epochs: int = 4, rate: float = 8.0, batch: int = 32, cuts: int = 4, most: int = 4_000
) -> Model:
    """A model of (lang, text) examples. Beside each text (of longer ones a random window of
    `most` bytes), `cuts` random pieces of it teach what short texts look like."""
    rng = np.random.default_rng(11)
    langs = sorted({lang for lang, _ in examples})
    number = {lang: i for i, lang in enumerate(langs)}
    texts, y, aside = [], [], []
    for k, (lang, text) in enumerate(sorted(examples)):
        words = text.lower().encode("utf-8", "surrogatepass").split()
        for cut in range(cuts + 1):
            size = len(words) if cut == cuts else int(min(len(words), np.exp(rng.uniform(0, np.log(80)))))
            at = int(rng.integers(0, len(words) - size + 1)) if words else 0
            piece = b" ".join(words[at : at + size])
            left = int(rng.integers(0, max(1, len(piece) - most + 1)))
            texts.append(piece[left : left + most])
            y.append(number[lang])
            aside.append(k % 5 == 0)
    y, aside = np.array(y, int), np.array(aside, bool)
    counts = [np.unique(subwords([t], bits)[0], return_counts=True) for t in texts]
    emb = rng.normal(0, 0.1, (1 << bits, width)).astype(np.float32)
    out, bias = np.zeros((width, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    learn = np.flatnonzero(~aside)
    steps = max(1, epochs * -(-len(learn) // batch))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(learn)
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            part = [counts[i] for i in rows]
            ids = np.concatenate([p[0] for p in part])
            share = np.concatenate([p[1] / max(1, p[1].sum()) for p in part]).astype(np.float32)[:, None]
            of = np.repeat(np.arange(len(rows)), [len(p[0]) for p in part])
            mean = np.zeros((len(rows), width), np.float32)
            np.add.at(mean, of, emb[ids] * share)
            wrong = _softmax(mean @ out + bias)
            wrong[np.arange(len(rows)), y[rows]] -= 1
            wrong /= len(rows)
            lr = rate * (1 - step / steps)
            back = wrong @ out.T
            np.add.at(emb, ids, -lr * len(rows) * share * back[of])
            out -= lr * (mean.T @ wrong)
            bias -= lr * wrong.sum(axis=0)
            step += 1
    logits = emb @ out

    def raw_logits(rows: np.ndarray) -> np.ndarray:
        return np.stack([(logits[counts[i][0]] * counts[i][1][:, None]).sum(axis=0) / max(1, counts[i][1].sum()) for i in rows]) + bias

    temperature, limit = 1.0, 0.0
    if aside.any() and len(langs) > 1:
        test, truth = raw_logits(np.flatnonzero(aside)), y[aside]
        grid = np.exp(np.linspace(np.log(0.02), np.log(20), 60))
        loss = [-np.log(np.maximum(_softmax(test / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        sure = _softmax(test / temperature)
        best, right = sure.max(axis=1), sure.argmax(axis=1) == truth
        # The lowest limit above which 99 of 100 are right; a fair guess is never rejected.
        ranked = np.argsort(-best)
        good = np.cumsum(right[ranked]) / np.arange(1, len(ranked) + 1) >= 0.99
        limit = min(0.5, float(best[ranked][np.flatnonzero(good).max()])) if good.any() and not good.all() else (0.0 if good.all() else 0.5)
    return Model(langs, logits.astype(np.float32), bias, temperature, limit)


def _predict(model, bits: int, text: int, names: list[str], out: list[str] = ["lang_pred", "score", "accepted"]):  # noqa: B006
    """Batches whose column at `text` is the text; the first columns, as many as `names`, are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for start, raw in chunks([t and t.lower() for t in batch.column(text).to_pylist()], 256_000):
                texts = batch.column(text).slice(start, len(raw)).to_pylist()
                lettered = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
                if m.langs:
                    ids, owner = subwords(raw, bits)
                    sure = _softmax((means(m.logits, ids, owner, len(raw)) + m.bias) / m.temperature)
                    at = sure.argmax(axis=1)
                    best = np.where(lettered, sure[np.arange(len(raw)), at], 0.0)
                    lang = [m.langs[i] if ok else UNKNOWN for i, ok in zip(at, lettered, strict=True)]
                else:
                    best, lang = np.zeros(len(raw)), [UNKNOWN] * len(raw)
                accepted = lettered & (best >= m.reject_below) & bool(m.langs)
                kept = [batch.column(i).slice(start, len(raw)) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(best), pa.array(accepted)], names=[*names, *out])

    return run


def sample(docs: DataFrame, learn: Column, examples: int, max_chars: int = 30_000) -> list[tuple[str, str]]:
    """(lang, text) of at most `examples` documents, those whose key hashes lowest; for learning only.

    Keys are picked before any text is read. Texts above `max_chars` and texts without a letter teach nothing.
    """
    keys = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("_at"))
    keys = keys.distinct()
    few = F.broadcast(keys.orderBy("_at", "doc_id").limit(examples).select("doc_id"))  # a size fixed by the parameter
    texts = docs.where(F.col("text").rlike(r"\p{L}") & (F.length("text") <= max_chars) & F.col("lang").isNotNull())
    # A document that stands there several times is one example.
    once = texts.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("one"))
    rows = once.select("one.lang", "one.text").toArrow()
    return list(zip(rows["lang"].to_pylist(), rows["text"].to_pylist(), strict=True))


def _model(docs: DataFrame, learn: Column, bits: int, examples: int, reject_below: float | None):
    model = train(sample(docs, learn, examples), bits)
    if reject_below is not None:
        model = replace(model, reject_below=reject_below)
    return docs.sparkSession.sparkContext.broadcast(model)


def identify(docs: DataFrame, learn: Column, bits: int = 16, examples: int = 2_000, reject_below: float | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for every row of `docs` (doc_id, text, lang).

    `learn` marks the rows that may teach (null: not). `lang_pred` is a language of those rows, or `und` for a null
    text or one without a letter, whose score is 0; with nothing to learn from, all are `und`. `accepted` is false for
    `und` and for scores below `reject_below`, by default the calibrated limit of at most 0.5. Null and repeated
    doc_ids come out as they came in.
    """
    model = _model(docs, learn, bits, examples, reject_below)
    plain = few_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(lean(_predict(model, bits, 1, ["doc_id"])), "doc_id long, lang_pred string, score double, accepted boolean")


def only_accepted(docs: DataFrame, learn: Column, bits: int = 16, examples: int = 2_000, reject_below: float | None = None) -> DataFrame:
    """The rows of `docs`, with all their columns, whose language is accepted; no join, so every row answers for itself."""
    model = _model(docs, learn, bits, examples, reject_below)
    names = docs.columns
    carried = few_rows(docs).select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)))
    schema = T.StructType(
        [*carried.schema.fields, T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_accepted", T.BooleanType())]
    )
    found = _predict(model, bits, names.index("text"), carried.columns, ["_lang", "_score", "_accepted"])
    judged = carried.mapInArrow(lean(found), schema).where("_accepted")
    return judged.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)))
