"""Alignment of two tokenizers over the same texts.

Tokens of a byte-level tokenizer (A) and of a sentence-piece model (B) cover the same bytes: a blank and the text. Where
tokens of both end at one byte the text is cut; an A and a B token of one group are linked. Both tokenizers always end a
token before a blank that stands between visible characters. So texts are cut there, and each task tokenizes and aligns a
distinct piece once. A document is then a list of pieces, its records their pairs of ids; `spill_count` counts them.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrid.llm.memory import few_rows, lean
from weekgrid.llm.pretokens import rules, tokenizer
from weekgrid.llm.spill_count import RUN, contributions, counted, parts_of, runs, unpack
from weekgrid.operators.staging import discard, staged

#: Before a blank between two other characters, of which the second is visible.
_CUT = regex.compile(r"(?<=[^ ]) (?=\S)")
_ROW = "flush long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


@dataclass(frozen=True)
class Pair:
    """Both tokenizers as they stand in their files; `cuts` says whether pieces may be tokenized one by one."""

    a: str
    b: bytes
    cuts: bool


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def load(a_file: str, b_file: str) -> Pair:
    """Reads the files on the driver. ValueError where A is not plain byte-level."""
    with open(a_file, encoding="utf-8") as file:
        a = file.read()
    rules(a)
    with open(b_file, "rb") as file:
        b = file.read()
    model = _processor(b)
    spans = any(regex.search("[^▁]▁", model.id_to_piece(i)) for i in range(model.vocab_size()))
    kept = "".join(model.encode("  a  b c ", out_type=str)) == "▁▁▁a▁▁b▁c▁"
    apart = model.encode("a") + model.encode("b") == model.encode("a b")
    return Pair(a, b, not spans and kept and apart)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Table:
    """Distinct pieces with what they add to a document."""

    def __init__(self, pair: Pair):
        self._a, self._b = tokenizer(pair.a, special=False), _processor(pair.b)
        letters = _byte_letters()
        vocabulary = self._a.get_vocab(with_added_tokens=False)
        self._a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, number in vocabulary.items():
            self._a_bytes[number] = bytes(letters.get(ch, 63) for ch in piece)
        named = lambda i: self._b.id_to_piece(i).replace("▁", " ").encode()
        self._b_bytes = [bytes([int(self._b.id_to_piece(i)[3:5], 16)]) if self._b.is_byte(i) else named(i) for i in range(self._b.vocab_size())]
        self._a_size, self._b_size = list(map(len, self._a_bytes)), list(map(len, self._b_bytes))
        self._names = list(map(str, range(max(len(self._a_bytes), len(self._b_bytes)))))
        self.second = self._b.vocab_size()
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.texts: list[str] = []
        self.misfits: set[int] = set()
        #: By piece: its A tokens, B tokens, groups and links.
        self.facts = [array("q") for _ in range(4)]
        self._pairs, self._times, self._ends = array("q"), array("q"), array("q")

    def add(self, words: list[str]) -> None:
        """Pieces, without the blank each begins with, that the table lacks."""
        coded = self._a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)
        found = list(zip(words, [c.ids for c in coded], self._b.encode(words, num_threads=1), strict=True))
        slow = self._align_many(found)
        for word, a, b in slow:
            self.at[word] = len(self.texts)
            self._align(word, a, b)

    def _align_many(self, found: list[tuple[str, list[int], list[int]]]) -> list[tuple[str, list[int], list[int]]]:
        """Aligns the pieces side by side; those back that do not fit or have a group of very many links."""
        sizes = [np.array([len(x[i]) for x in found], np.int64) for i in (1, 2)]
        ids = [np.fromiter(chain.from_iterable(x[i] for x in found), np.int64, int(n.sum())) for i, n in zip((1, 2), sizes, strict=True)]
        raw = [(" " + x[0]).encode() for x in found]
        bytes_of = [b"".join(map(names.__getitem__, mine.tolist())) for names, mine in zip((self._a_bytes, self._b_bytes), ids, strict=True)]
        ends = [np.cumsum(np.array(lengths)[mine]) for lengths, mine in zip((self._a_size, self._b_size), ids, strict=True)]
        stops = np.cumsum([len(r) for r in raw])
        at_stop = [e[np.cumsum(n) - 1] for e, n in zip(ends, sizes, strict=True)]
        fits = (at_stop[0] == stops) & (at_stop[1] == stops)
        if not fits.all() or not bytes_of[0] == bytes_of[1] == b"".join(raw):
            if len(found) == 1:
                return found
            half = len(found) // 2  # a misfit moves all that follows it
            return self._align_many(found[:half]) + self._align_many(found[half:])
        both = np.intersect1d(*ends, assume_unique=True)
        groups = [np.searchsorted(both, e) for e in ends]
        many = [np.bincount(g, minlength=len(both)) for g in groups]
        if (many[0] * many[1]).max() > 4_096:
            if len(found) == 1:
                return found
            half = len(found) // 2
            return self._align_many(found[:half]) + self._align_many(found[half:])
        word_of = np.searchsorted(stops, both)
        links = many[0] * many[1]
        # Each A token meets its group's B tokens.
        times = many[1][groups[0]]
        first = (np.cumsum(many[1]) - many[1])[groups[0]]
        other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
        pair = np.repeat(ids[0], times) * self.second + ids[1][other]
        key, often = np.unique(np.repeat(word_of[groups[0]], times) << 40 | pair, return_counts=True)
        held = np.bincount(key >> 40, minlength=len(found))
        base = len(self._pairs)
        self._pairs.frombytes((key & ((1 << 40) - 1)).tobytes())
        self._times.frombytes(often.astype(np.int64).tobytes())
        self._ends.frombytes((base + np.cumsum(held)).tobytes())
        counts = (*sizes, np.bincount(word_of, minlength=len(found)), np.bincount(word_of, links, len(found)).astype(np.int64))
        for facts, n in zip(self.facts, counts, strict=True):
            facts.frombytes(n.astype(np.int64).tobytes())
        # All tokens by group and side, each with the sign before it.
        side = np.repeat([0, 1], [len(ids[0]), len(ids[1])])
        group, token = np.concatenate(groups), np.concatenate(ids)
        order = np.lexsort((side, group))
        side, group, token = side[order], group[order], token[order]
        sign = np.where(np.diff(side, prepend=0) > 0, 1, np.where(np.diff(group, prepend=-1) > 0, 2, 0))
        sign[(sign == 2) & (np.diff(word_of[group], prepend=-1) > 0)] = 3
        sign[0] = 4
        signs = [",", "|", ";", " ", ""]
        shown = "".join([signs[s] + self._names[t] for s, t in zip(sign.tolist(), token.tolist(), strict=True)])
        start = len(self.texts)
        self.texts += shown.split(" ")
        self.at.update(zip([x[0] for x in found], range(start, len(self.texts)), strict=True))
        return []

    def _align(self, word: str, a: list[int], b: list[int]) -> None:
        raw = b"".join([self._a_bytes[i] for i in a])
        found: dict[int, int] = {}
        shown: list[str] = []
        links = 0
        if raw == b"".join([self._b_bytes[i] for i in b]) and raw == (" " + word).encode():
            names = self._names
            for mine, other in self._groups(a, b) if len(a) > 1 and len(b) > 1 else ((a, b),):
                shown.append(",".join([names[x] for x in mine]) + "|" + ",".join([names[y] for y in other]))
                links += len(mine) * len(other)
                if len(mine) * len(other) <= 64:
                    for x in mine:
                        for y in other:
                            key = x * self.second + y
                            found[key] = found.get(key, 0) + 1
                    continue
                # By distinct ids, as a long group holds some many times.
                others = Counter(other)
                for x, n in Counter(mine).items():
                    for y, m in others.items():
                        key = x * self.second + y
                        found[key] = found.get(key, 0) + n * m
        else:
            self.misfits.add(len(self.texts))
        self.texts.append(";".join(shown))
        for facts, n in zip(self.facts, (len(a), len(b), len(shown), links), strict=True):
            facts.append(n)
        self._pairs.extend(found.keys())
        self._times.extend(found.values())
        self._ends.append(len(self._pairs))

    def _groups(self, a: list[int], b: list[int]) -> Iterator[tuple[list[int], list[int]]]:
        """Tokens between the bytes where both end; both cover the same bytes."""
        i = j = a0 = b0 = 0
        a_end, b_end = self._a_size[a[0]], self._b_size[b[0]]
        while True:
            if a_end < b_end:
                i += 1
                a_end += self._a_size[a[i]]
            elif b_end < a_end:
                j += 1
                b_end += self._b_size[b[j]]
            else:
                i, j = i + 1, j + 1
                yield a[a0:i], b[b0:j]
                if i == len(a):
                    return
                a0, b0 = i, j
                a_end += self._a_size[a[i]]
                b_end += self._b_size[b[j]]

    def sums(self, pieces: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The four facts of documents, given by their pieces one after the other and where each one's end."""
        out = []
        for facts in self.facts:
            total = np.concatenate([[0], np.cumsum(np.array(facts, np.int64)[pieces])])
            out.append(np.diff(total[ends], prepend=0))
        return out

    def records(self, pieces: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, document, times) of the documents, sorted by pair and document."""
        key = np.repeat(np.arange(len(ends), dtype=np.int64), np.diff(ends, prepend=0)) << 32 | pieces
        key, often = np.unique(key, return_counts=True)
        pieces, stops = key & 0xFFFFFFFF, np.array(self._ends, np.int64)
        many = np.diff(stops, prepend=0)[pieces]
        # Places of a piece's pairs end at its stop.
        place = np.arange(many.sum()) + np.repeat(stops[pieces] - np.cumsum(many), many)
        pair = np.array(self._pairs, np.int64)[place] << 24 | np.repeat(key >> 32, many)
        times = np.array(self._times, np.int64)[place] * np.repeat(often, many)
        order = np.argsort(pair, kind="stable")
        pair, times = pair[order], times[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        return pair[first] >> 24, pair[first] & 0xFFFFFF, np.add.reduceat(times, first) if len(first) else times


def _spill(pair, buckets: int, most_words: int, most_pieces: int, most_docs: int = 20_000):
    """Rows of documents (_ROW, no bucket) and of runs (flush, bucket, heads, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(pair.value)
        flush = TaskContext.get().partitionId() << 32
        ids, digests, docs, words = [], [], [], 0

        def written() -> pa.RecordBatch:
            pieces = np.fromiter(chain.from_iterable(docs), np.int64)
            ends = np.cumsum([len(d) for d in docs])
            spilled = list(runs(*table.records(pieces, ends), table.second, buckets))
            none, few = [None] * len(spilled), [None] * len(docs)
            counts = [pa.array([*column.tolist(), *none], pa.int64()) for column in table.sums(pieces, ends)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([flush] * (len(docs) + len(spilled)), pa.int64()), pa.array([*range(len(docs)), *none], pa.int32()),
                    pa.array([*ids, *none], pa.int64()), *counts, pa.array([*digests, *none], pa.string()),
                    *(pa.array([*few, *(s[i] for s in spilled)], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))),
                ],
                names=["flush", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "bucket", "heads", "body"],
            )

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                cut = _CUT.split if pair.value.cuts else lambda text: [text]
                texts = part.column("text").to_pylist()
                each = [cut(t) if t else [] for t in texts]
                new = {w for ws in each for w in ws if w not in table.at}
                if docs and (words > most_words or len(table.at) + len(new) > most_pieces or len(docs) > most_docs):
                    yield written()
                    flush += 1
                    ids, digests, docs, words = [], [], [], 0
                    if len(table.at) + len(new) > most_pieces:
                        table.clear()
                        new = {w for ws in each for w in ws}
                new = list(new)
                for i in range(0, len(new), 5_000):
                    table.add(new[i : i + 5_000])
                for text, ws in zip(texts, each, strict=True):
                    pieces = [table.at[w] for w in ws]
                    if not table.misfits.isdisjoint(pieces):
                        # As a whole the text may still fit.
                        if text not in table.at:
                            table.add([text])
                        pieces = [table.at[text]]
                        if pieces[0] in table.misfits:
                            pieces = []
                    digests.append(hashlib.sha256(";".join(map(table.texts.__getitem__, pieces)).encode()).hexdigest() if pieces else "")
                    docs.append(pieces)
                    words += len(pieces)
                ids += part.column("doc_id").to_pylist()
        if docs:
            yield written()

    return run


def spilled(docs: DataFrame, pair: Pair, buckets: int = 64, most_words: int = 500_000, most_pieces: int = 300_000) -> DataFrame:
    """The documents' rows and their runs of records in one written table; `bucket` is null for documents."""
    if _processor(pair.b).vocab_size() * 2**16 >= 2**39:
        raise ValueError("vocabularies too large to pack a pair and a document in one number")
    source = docs.sparkSession.sparkContext.broadcast(pair)
    plain = few_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = plain.mapInArrow(lean(_spill(source, buckets, most_words, most_pieces)), f"{_ROW}, bucket int, heads binary, body binary")
    return staged(made, "alignment")


def _run_rows(table: DataFrame) -> DataFrame:
    return table.where("bucket is not null").select(*(p.split()[0] for p in RUN.split(", ")))


def align(docs: DataFrame, a_file: str, b_file: str, buckets: int = 64, fan: int = 64, most_words: int = 500_000, most_pieces: int = 300_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of `docs` (doc_id, text).

    Special tokens' strings are plain text. A pair's count is the number of rows that hold it linked; n_best counts links whose
    pair has its A id's highest count, count_sum sums the counts over links. Null and empty texts, and those
    that either tokenizer does not give back byte by byte, have zeros and ''. Repeated rows count as often as they occur; null
    and repeated doc_ids come out as they came in, other columns are not looked at, an empty table gives an empty
    one. A task holds the distinct pieces of a flush (`most_words`, `most_pieces`); nothing of a result depends on either.
    """
    pair = load(a_file, b_file)
    table = spilled(docs, pair, buckets, most_words, most_pieces)
    sums = contributions(_run_rows(table), _processor(pair.b).vocab_size(), fan)
    rows = table.where("bucket is null").drop("bucket", "heads", "body")
    return rows.join(sums, ["flush", "at"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("total", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256",
    )


def _pair_rows(second: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                steps, held, best = unpack(blob)
                pairs = np.cumsum(steps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs // second), pa.array(pairs % second), pa.array(held), pa.array(best == 1)], names=["a", "b", "n", "best"]
                )

    return run


def pair_counts(docs: DataFrame, a_file: str, b_file: str, buckets: int = 64, fan: int = 64, **limits: int) -> DataFrame:
    """(a, b, n, best): every linked pair of ids, in how many rows, and whether no other pair of its A id has more."""
    pair = load(a_file, b_file)
    second = _processor(pair.b).vocab_size()
    table = spilled(docs, pair, buckets, **limits)
    found = counted(_run_rows(table), second, parts_of(_run_rows(table), fan), fan)
    out = staged(found.mapInArrow(_pair_rows(second), "a long, b long, n long, best boolean"), "pairs")
    discard(table)
    return out
