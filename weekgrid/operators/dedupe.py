"""Keyed de-duplication.

Each operator ranks rows inside a key and keeps the first. Spark turns `row_number() = 1` into a
limit before the shuffle, so a key that holds a third of all rows sends one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekgrid.functions.base import blank_null, fixed3
from weekgrid.functions.text import slugify

c = F.col


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).where(c("_rank") == 1).drop("_rank")


def top_by(rows: DataFrame, keys: list[str], limit: int, *order: Column, salts: int = 32) -> DataFrame:
    """The first `limit` rows per key, in two steps.

    Rows are ranked inside salted parts of a key first, so no task ever sorts a whole hot key; the
    second step sees at most salts x limit rows of it. The result is exact. `_rank` is kept.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(part))
        .where(c("_rank") <= limit)
        .drop("_salt")
        .withColumn("_rank", F.row_number().over(whole))
        .where(c("_rank") <= limit)
    )


def numbered(rows: DataFrame, key: str, order: Column, name: str, buckets: int = 64) -> DataFrame:
    """Number the rows of each key from 1, without sorting a whole key in one task.

    Rows are numbered inside hashed buckets of the key; bucket sizes, counted beforehand, give each
    bucket its start.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(buckets)))
    sizes = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(order))
    return (
        rows.withColumn("_inside", inside)
        .join(starts, [key, "_bucket"])
        .withColumn(name, c("_start") + c("_inside"))
        .drop("_bucket", "_start", "_inside")
    )


def last_per_slug(rows: DataFrame, *position: Column) -> DataFrame:
    """The last row of every (feed_id, slug) in input order."""
    return first_by(rows, ["feed_id", "slug"], *[p.desc() for p in position])


def venue_key() -> Column:
    named = blank_null(slugify(c("location_name")))
    address = blank_null(slugify(c("address")))
    pin = F.when(
        c("lat").isNotNull() & c("lng").isNotNull(), F.concat(fixed3(c("lat")), F.lit(":"), fixed3(c("lng")))
    )
    return F.coalesce(named, address, pin, blank_null(slugify(c("city"))), F.lit("unknown"))


def duplicate_key() -> Column:
    """Listings with equal keys are one weekly event, whichever feed they came from."""
    return F.concat_ws(
        "|",
        slugify(c("name")),
        F.coalesce(c("day").cast("string"), F.lit("x")),
        F.coalesce("time", F.lit("x")),
        F.coalesce("fellowship", F.lit("aa")),
        "attendance",
        venue_key(),
    )


def completeness() -> Column:
    """How many of seven descriptive fields are filled."""
    texts = ("formatted_address", "address", "notes", "conference_url", "location_notes")
    marks = [blank_null(c(name)).isNotNull() for name in texts]
    marks += [F.size("types") > 0, c("source_verified_at").isNotNull()]
    return sum((F.coalesce(m, F.lit(False)).cast("int") for m in marks), F.lit(0))


def collapse_duplicates(rows: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Keep the richest row of each weekly event: most fields, newest stamp, smallest slug."""
    keyed = rows.withColumns({"_key": duplicate_key(), "_full": completeness()})
    best = first_by(
        keyed,
        [*within, "_key"],
        c("_full").desc(),
        c("source_verified_at").desc_nulls_last(),
        c("slug").asc(),
        c("feed_id").asc(),
    )
    return best.drop("_key", "_full")


def first_entities(parsed: DataFrame) -> DataFrame:
    """Entities named by a payload: the first item of each id describes it."""
    named = parsed.where(blank_null(c("entity_name")).isNotNull())
    rows = named.select(
        F.concat("feed_id", F.lit(":"), slugify(c("entity_name"))).alias("id"),
        "feed_id",
        c("entity_name").alias("name"),
        c("entity_phone").alias("phone"),
        c("entity_email").alias("email"),
        c("entity_url").alias("url"),
        c("entity_location").alias("location_text"),
        "feedback_emails",
        "pos",
    )
    return first_by(rows, ["id"], c("pos").asc(), c("name").asc()).drop("pos")
