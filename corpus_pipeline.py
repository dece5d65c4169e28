"""The corpus pipeline: language, toxicity, near duplicates, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and gives a frame; all but the last give the columns of `docs`. `run` writes each
stage's frame to the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrid.llm import bpe, language_id, mixing, toxicity
from weekgrid.llm.jaccard_join import one_per_group
from weekgrid.llm.shared import table
from weekgrid.operators.staging import staged


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification accepts; those it rejects (no letter, or below its limit) go."""
    return language_id.only_accepted(docs, F.col("doc_id").isNotNull())


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from all labelled ones, does not reject."""
    return toxicity.only_clean(docs, table(spark, sf_dir, "labels"), F.col("doc_id").isNotNull())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that n-gram similarity links, the one with the smallest doc_id stays."""
    return one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources again, no source more than twice."""
    return mixing.mix(docs, repetition=2.0).select(docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and the digest of what they decode to."""
    file = public_tokenizers.path("word_bpe_49k.json")
    both = bpe.decode(bpe.encode(docs, file), file)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]

#: Trained models have no SQL; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives for the whole `documents` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
