"""Token counts: pieces are counted once per distinct pre-token and summed over each document's pre-token frequencies.

1. Every task counts the distinct pre-tokens of its texts; Spark sums them to one table over the whole corpus.
2. The tokenizer encodes each row of that table once. Only the number of pieces is kept, never an id.
3. Each document's pre-token frequencies meet the table twice. The `head` most frequent pre-tokens, a table of a fixed
   largest size, are broadcast, and that join sums inside the scan. What they lack are rows (document, pre-token, frequency) of a
   shuffled join; there no pre-token is frequent enough to be hot. Texts are never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrid.llm.lm_scoring import most_frequent
from weekgrid.llm.memory import few_rows, lean
from weekgrid.llm.pretokens import Cutter, Rules, rules, tokenizer
from weekgrid.operators.staging import staged

#: Longer pre-tokens are never broadcast, so that rows bound the size of the broadcast table.
_SHORT = 64


def _texts(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Few rows at a time, so that long texts are not all held as Python strings."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, part.column(column).to_pylist()


def _distinct(rules: Rules, most: int = 200_000):
    """(key, n): the pre-tokens of a task's texts with their counts, handed on whenever there are `most` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(rules)
        words: Counter[str] = Counter()
        firsts: Counter[str] = Counter()
        size = 0

        def rows() -> pa.RecordBatch:
            counts: Counter[str] = Counter()
            for blank, table in (("", firsts), (" ", words)):
                for word, n in table.items():
                    for key in cut.pretokens(blank + word):
                        counts[key] += n
            keys, n = pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())
            return pa.RecordBatch.from_arrays([keys, n], names=["key", "n"])

        for _, texts in _texts(batches):
            for text in texts:
                for part in cut.parts(text)[1]:
                    first, rest = cut.words(part)
                    firsts[first] += 1
                    words.update(rest)
                size += len(text)
            # Each text adds at most its own length, so the tables are measured only now and then.
            if len(words) + len(firsts) > most or size > 64_000_000:
                yield rows()
                words.clear()
                firsts.clear()
                size = 0
        if words or firsts:
            yield rows()

    return run


def _count(source):
    """(key, pieces, n) of distinct pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(source.value.source, special=False)
        for batch in batches:
            for start in range(0, batch.num_rows, 5_000):
                part = batch.slice(start, 5_000)
                coded = model.encode_batch_fast(part.column("key").to_pylist(), add_special_tokens=False)
                pieces = pa.array([len(c) for c in coded], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("key"), pieces, part.column("n")], names=["key", "pieces", "n"])

    return run


def _sum(rules: Rules, head, most: int = 200_000):
    """(row, doc_id, n_bytes, tokens, open, times): sums over what the broadcast table knows, and the frequencies left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, pieces = Cutter(rules), head.value
        sums: dict[str, int] = {}
        opens: dict[str, list[str]] = {}

        def of(piece: str) -> tuple[int, list[str]]:
            keys = cut.pretokens(piece)
            return sum(pieces.get(k, 0) for k in keys), [k for k in keys if k not in pieces]

        for batch, texts in _texts(batches):
            if len(sums) > most:
                sums.clear()
                opens.clear()
            tokens, keys, times = [], [], []
            for text in texts:
                total, parts = cut.parts(text)
                left: Counter[str] = Counter()
                for part in parts:
                    first, rest = cut.words(part)
                    n, unknown = of(first)
                    total += n
                    left.update(unknown)
                    for word in rest:
                        if (n := sums.get(word)) is None:
                            n, unknown = of(" " + word)
                            sums[word] = n
                            if unknown:
                                opens[word] = unknown
                        total += n
                    for word in filter(opens.__contains__, rest):
                        left.update(opens[word])
                tokens.append(total)
                keys.append(list(left.keys()))
                times.append(list(left.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64()),
                    pa.array(keys, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64())),
                ],
                names=["row", "doc_id", "n_bytes", "tokens", "open", "times"],
            )

    return run


def distinct_pretokens(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(key, pieces, n): every distinct pre-token of the texts, how many tokens it is and how often it stands there."""
    with open(tokenizer_file, encoding="utf-8") as file:
        how = rules(file.read())
    source = docs.sparkSession.sparkContext.broadcast(how)
    found = few_rows(docs).select(F.coalesce("text", F.lit("")).alias("text")).where("text <> ''").mapInArrow(lean(_distinct(how)), "key string, n long")
    each = found.groupBy("key").agg(F.sum("n").alias("n"))
    return each.mapInArrow(lean(_count(source)), "key string, pieces long, n long")


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 1024, head: int = 200_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of `docs` (doc_id, text); other columns are not looked at.

    The number of tokens that the library's tokenizer gives for the whole text without added special tokens; their
    strings in a text are special tokens there, one each. A null text counts as empty: no bytes, no tokens. Null and repeated doc_ids
    come out as they came in; an empty table gives an empty one. `head` bounds the broadcast table and decides
    nothing else. ValueError for a tokenizer that is not plain byte-level.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        how = rules(file.read())
    spark = docs.sparkSession
    table = staged(distinct_pretokens(docs, tokenizer_file), "pretokens")
    often = most_frequent(table.where(F.length("key") <= _SHORT), head, also=("pieces",)).toArrow()
    known = spark.sparkContext.broadcast(dict(zip(often["key"].to_pylist(), often["pieces"].to_pylist(), strict=True)))
    plain = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("n_bytes", F.octet_length("text").cast("long"))
    schema = "row long, doc_id long, n_bytes long, tokens long, open array<string>, times array<long>"
    summed = staged(plain.mapInArrow(lean(_sum(how, known)), schema), "token-sums")
    left = summed.select("row", F.explode(F.arrays_zip("open", "times")).alias("one"))
    left = left.select("row", F.col("one.open").alias("key"), F.col("one.times").alias("times"))
    rest = left.join(table.select("key", "pieces"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    total = F.col("tokens") + F.coalesce("more", F.lit(0))
    whole = summed.drop("open", "times").join(rest, "row", "left").withColumn("n_tokens", total)
    return whole.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
