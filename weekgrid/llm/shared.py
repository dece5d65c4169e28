"""What several operators of this folder need: folds, bounded samples, the tables, plain frames for Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the column `key` as text, modulo; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus)


def held_out(key: str, modulus: int, rest: int) -> Column:
    """Rows to be tested on. A row without a key is neither learned from nor held out."""
    return F.coalesce(remainder(key, modulus) == rest, F.lit(False))


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, max_chars: int = 30_000
) -> DataFrame:
    """`text` and `y` of a bounded sample of labelled documents.

    Of either class at most `per_class` documents take part, those whose key hashes lowest; texts above
    `max_chars` are no examples. Both bounds hold for learning only. Null keys and null labels teach nothing; a
    document labelled twice has its larger label.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .where(learn & F.col("y").isin(0, 1))
        .withColumn("_at", F.xxhash64("doc_id"))
    )
    chosen = [known.where(F.col("y") == y).orderBy("_at", "doc_id").limit(per_class) for y in (0, 1)]
    # At most 2 * per_class rows of two numbers: a size fixed by the parameter.
    few = F.broadcast(chosen[0].unionByName(chosen[1]).select("doc_id", "y"))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    # A document that stands there several times is one example.
    return texts.join(few, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y")
