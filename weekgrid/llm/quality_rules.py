"""Quality rules on plain columns: counts within a text, and lines that too many documents of a host share.

1. *Within a text.* Words, their characters, symbols, repeated lines, and words that stand in a repeated window of five.
   Windows are hashes in an array of the row; only texts that hold a window twice sort theirs.
2. *Across documents.* Every line with a word is normalised (A-Z lower-cased, digit runs to 0, gaps to one blank) and
   hashed. Per host and line the distinct documents are counted, documents with the same text being one; lines in more
   than `max_docs` documents of their host are removed from the texts, by their places.
3. A document whose text has lost more than `max_removed` hundredths of its words is depleted and rejected.

Lines are counted with partial sums before any shuffle, so a line or host of a third of all rows is no hot task. Lines are
shuffled as hashes and numbers; texts move once, to their places, where those are too many to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.functions.base import bind, let
from weekgrid.operators.staging import staged

_GAP = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def window_hashes(hashes: Column, size: int) -> Column:
    """Hashes of all runs of `size` neighbours; none if there are fewer."""
    last = F.size(hashes) - size
    run = lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(size)))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), run)).otherwise(F.array().cast("array<bigint>"))


def covered_by_repeats(windows: Column, size: int) -> Column:
    """How many places lie in a window whose hash occurs twice or more: sorted by hash, twins are neighbours."""

    def repeated(sorted_: Column) -> Column:
        same = lambda p, i: F.coalesce(F.get(sorted_, i)["w"] == p["w"], F.lit(False))
        twins = F.transform(sorted_, lambda p, i: F.when(same(p, i - 1) | same(p, i + 1), p["i"]))
        return F.array_sort(F.filter(twins, lambda p: p.isNotNull()))

    def covered(places: Column) -> Column:
        width = lambda p, i: F.least(F.lit(size), F.coalesce(F.get(places, i + 1) - p, F.lit(size)))
        return F.aggregate(F.transform(places, width), F.lit(0), lambda a, b: a + b)

    pairs = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(some, let(let(F.array_sort(pairs), repeated), covered)).otherwise(F.lit(0))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, host, text, text_id and the counts within each text."""
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("host"),
        "text",
        F.coalesce("text", F.lit("")).alias("whole"),
    )
    split = bind(plain, words=words(F.col("whole")), lines=worded_lines(F.col("whole")))
    hashed = bind(split, hashes=F.transform("words", lambda w: F.xxhash64(w)))
    windowed = bind(hashed, windows=window_hashes(F.col("hashes"), 5))
    counted = windowed.select(
        "doc_id",
        "host",
        "text",
        F.xxhash64("whole").alias("text_id"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("whole", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered_by_repeats(F.col("windows"), 5).cast("long").alias("n_repeat_words"),
    )
    return counted


def lines_of(docs: DataFrame) -> DataFrame:
    """(host, text_id, place, line) of every line with a word; `place` counts all lines of the text."""
    host = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.where(F.col("text").isNotNull()).select(
        host.alias("host"), F.xxhash64("text").alias("text_id"), F.posexplode(F.split("text", "\n")).alias("place", "raw")
    )
    worded = rows.where(F.col("raw").rlike(r"[^\x20\x09-\x0D]"))
    plain = F.array_join(words(F.translate("raw", _UPPER, _LOWER)), " ")
    return worded.select("host", "text_id", "place", F.xxhash64(F.regexp_replace(plain, "[0-9]+", "0")).alias("line"))


def common_lines(docs: DataFrame, max_docs: int = 50) -> DataFrame:
    """(host, line, docs): hashes of lines in more than `max_docs` different texts of their host."""
    counted = lines_of(docs).groupBy("host", "line").agg(F.count_distinct("text_id").alias("docs"))
    return counted.where(F.col("docs") > max_docs)


def common_places(docs: DataFrame, max_docs: int = 50) -> DataFrame:
    """(host, text_id, gone): the places of a text's common lines, at most its own lines; texts without any are left out."""
    common = staged(common_lines(docs, max_docs).select("host", "line"), "common-lines")
    met = lines_of(docs).join(common, ["host", "line"], "left_semi")
    return met.groupBy("host", "text_id").agg(F.collect_set("place").alias("gone"))


def without_places(text: Column, gone: Column) -> Column:
    """The text without the lines at these places, as it is if they are null."""

    def rest(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    return F.when(gone.isNull(), text).otherwise(let(F.split(text, "\n"), rest))


def cleaned(docs: DataFrame, max_docs: int = 50, max_removed: int = 50) -> DataFrame:
    """Per row of `docs` (doc_id, text, source): `text` without its host's common lines, the counts of the whole text,
    base_failed, kept, and removed_words, the words that the text has lost.

    A null text stays null, has no words and fails; a text of common lines only becomes empty. A null source is a host of
    its own. Null and repeated doc_ids come out as they came in; rows with the same text count as one document, and all
    get the same verdict within a host.
    """
    marked = text_counts(docs).join(common_places(docs, max_docs), ["host", "text_id"], "left")
    left = bind(marked, text=without_places(F.col("text"), F.col("gone")))
    lost = F.when(F.col("gone").isNull(), 0).otherwise(F.col("n_words") - F.size(words(F.col("text")))).cast("long")
    judged = bind(left, removed_words=lost)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = 100 * F.col("removed_words") > max_removed * F.col("n_words")
    return judged.select(
        "doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_words",
    )


def quality_rules(docs: DataFrame, max_docs: int = 50, max_removed: int = 50) -> DataFrame:
    """The columns of `cleaned` without the text."""
    return cleaned(docs, max_docs, max_removed).drop("text")


def without_common_lines(docs: DataFrame, max_docs: int = 50) -> DataFrame:
    """`docs` (text, source and whatever else) with every common line of its host taken out of the text.

    Other lines, blank ones among them, stay as they are and in their order; null and empty texts stay, and a text of
    common lines only becomes empty. Rows come out as often as they came in, with their columns; an empty table gives
    an empty one.
    """
    host = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    places = common_places(docs, max_docs).select(*(F.col(c).alias(f"_{c}") for c in ("host", "text_id", "gone")))
    rows = docs.withColumns({"_host": host, "_text_id": F.xxhash64("text")}).join(places, ["_host", "_text_id"], "left")
    return rows.withColumn("text", without_places(F.col("text"), F.col("_gone"))).select(docs.columns)
