"""The registered queries of this folder: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrid.llm import bpe, jaccard_join, language_id, lm_scoring, mixing, quality_crf, quality_rules, sql, token_alignment, token_counts, topk_search, toxicity, url_filter, whitening
from weekgrid.llm.shared import held_out, remainder, table

Query = Callable[[SparkSession, str], DataFrame]

KEY = "doc_id"
TOKENIZER = "word_bpe_49k.json"
RULES: list[url_filter.Rule] = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    hits = topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.toxicity(docs, labels, remainder(KEY, 5) != 0)
    return scored.select("doc_id", held_out(KEY, 5, 0).alias("held_out"), "score", "predicted")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(url_filter.EXAMPLES, "url string, block int")
    judged = url_filter.url_verdicts(table(spark, sf_dir, "pages"), RULES, labelled)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_crf.quality(docs, labels, remainder(KEY, 3) != 1)
    return scored.select("doc_id", held_out(KEY, 3, 1).alias("held_out"), "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = language_id.identify(table(spark, sf_dir, "documents"), remainder(KEY, 4) != 2)
    return named.select("doc_id", held_out(KEY, 4, 2).alias("held_out"), "lang_pred", "score", "accepted")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_links(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.cleaned(table(spark, sf_dir, "documents")).drop("text")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.lm_scores(table(spark, sf_dir, "documents"), remainder(KEY, 7) != 2)
    return scored.select("doc_id", held_out(KEY, 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = public_tokenizers.path(TOKENIZER)
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), file), file)
    digest = lambda column: F.sha2(F.col(column).cast("binary"), 256)
    return both.select("doc_id", "n_tokens", digest("ids").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row as often as the mixture takes it, no source more than twice; weights to six places."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), repetition=2.0)
    part = lambda name: F.col(f"_mix.{name}").alias(name)
    rounded = lambda name: F.round(F.col(f"_mix.{name}"), 6).alias(name)
    return mixed.select("doc_id", "source", part("epoch"), part("block"), part("place"), *map(rounded, ("weight", "repetition", "alpha")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align(table(spark, sf_dir, "documents"), *files)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1024, offset=100_000)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_topk_search, op2_toxicity, op3_url_filter, op4_quality_crf, op5_language_id, op6_jaccard_join, op7_quality_rules,
        op8_lm_scoring, op9_bpe, op10_mixing, op11_token_alignment,
        op12_embedding_whitening, op13_token_counts,
    )
}
ORACLES: dict[str, str] = {
    "op1_topk_search": sql.TOPK_SEARCH,
    "op6_jaccard_join": sql.JACCARD_JOIN,
    "op7_quality_rules": sql.QUALITY_RULES,
    "op10_mixing": sql.MIXING,
}
