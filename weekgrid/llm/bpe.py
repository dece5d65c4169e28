"""BPE encoding and decoding by tables of distinct words.

Words are split at x20 and x09-x0D, which no token of a word-end vocabulary spans and no step of its normaliser joins;
so a text's ids are its words' ids in order. Each task keeps a table of the distinct words it meets: a word is encoded
once by the tokenizers library and its ids are put back at every place where it stands. Decoding looks ids up in the
id-to-piece table. Both tables are bounded: the vocabulary by its file, the word table by `table_words`, beyond which
it starts anew.

One table of all distinct words, joined back by (document, place), would shuffle a row a word.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekgrid.llm.memory import few_rows, lean
from weekgrid.llm.words import chunks


def _tokenizer(source: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(source)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pieces(source: str) -> np.ndarray:
    """The id-to-piece table; ids without a piece are empty."""
    vocabulary = _tokenizer(source).get_vocab(with_added_tokens=True)
    out = np.full(max(vocabulary.values()) + 1, "", object)
    for piece, number in vocabulary.items():
        out[number] = piece
    return out


def _encode(source, table_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(source.value)
        table: dict[bytes, bytes] = {}
        for batch in batches:
            for start, raw in chunks(batch.column("text").to_pylist(), 256_000):
                # Letters A-Z lose their case later anyway; earlier only where nothing else can depend on it.
                split = [(r.lower() if r.isascii() and b"<|" not in r else r).split() for r in raw]
                new = list({w for words in split for w in words if w not in table})
                if len(table) + len(new) > table_words:
                    table.clear()
                    new = list({w for words in split for w in words})
                for i in range(0, len(new), 10_000):
                    part = new[i : i + 10_000]
                    coded = tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
                    table.update((w, np.array(c.ids, "<u4").tobytes()) for w, c in zip(part, coded, strict=True))
                ids = [b"".join(map(table.__getitem__, words)) for words in split]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, len(raw)),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "ids"],
                )

    return run


def encode(docs: DataFrame, tokenizer_file: str, table_words: int = 100_000) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row of `docs` (doc_id, text); ids are little-endian unsigned 32-bit numbers.

    The same ids as the library gives for the whole text without added special tokens; their strings in a text are
    special tokens there. A null text counts as empty and has no ids; null and repeated doc_ids come out as they came
    in. `tokenizer_file` is read on the driver only.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    plain = few_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(lean(_encode(source, table_words)), "doc_id long, n_tokens long, ids binary")


def _decode(source, keep: list[str], most: int = 1_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pieces(source.value)

        def text(ids: bytes | None) -> str | None:
            if ids is None:
                return None
            return " ".join(filter(None, piece[np.frombuffer(ids, "<u4")].tolist()))

        for batch in batches:
            # Few rows at a time: pieces take more room than ids.
            rows = max(1, most * 4 * batch.num_rows // max(1, batch.column("ids").nbytes))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                texts = pa.array(map(text, part.column("ids").to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), texts], names=[*keep, "decoded"])

    return run


def decode(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """The rows of `encoded` with a column `decoded`: the pieces of `ids`, parted by blanks, special tokens included.

    Ids outside the vocabulary have no piece; null ids give a null text, no ids an empty one.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        source = encoded.sparkSession.sparkContext.broadcast(file.read())
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    return few_rows(encoded).mapInArrow(lean(_decode(source, encoded.columns)), schema)
