"""Data-quality audit: counters, place anomalies and the safe verdict."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrid.functions.base import blank_null
from weekgrid.functions.geo import valid_pin
from weekgrid.operators.dedupe import first_by
from weekgrid.operators.predicates import is_fresh, is_malformed_city
from weekgrid.operators.rollup import CITY, scope_columns
from weekgrid.operators.serving import with_fresh_feed

c = F.col

SPAN_DEGREES = 1.5
MUST_BE_ZERO = (
    "invalid_schedule", "missing_address", "invalid_coordinates", "missing_city",
    "malformed_city_labels", "duplicate_ids",
)


def listing_counters(listings: DataFrame, feeds: DataFrame, now: datetime) -> DataFrame:
    """Counters over the listings of fresh feeds, in one pass."""
    offline = c("attendance") != "online"

    def note(pattern: str):
        return F.coalesce(c("notes").rlike(pattern), F.lit(False)) | F.coalesce(
            c("location_notes").rlike(pattern), F.lit(False)
        )

    def tagged(*codes: str):
        return F.coalesce(F.arrays_overlap("types", F.array(*[F.lit(t) for t in codes])), F.lit(False))

    counters = {
        "invalid_schedule": c("day").isNull() | c("time").isNull(),
        "missing_address": offline & blank_null(F.trim("formatted_address")).isNull(),
        "invalid_coordinates": offline & ~valid_pin(c("lat"), c("lng")),
        "missing_city": offline & blank_null(F.trim("city")).isNull(),
        "malformed_city_labels": offline & is_malformed_city(),
        "notes_missing_beginner_type": note("(?i)beginners? welcome") & ~tagged("BE", "B"),
        "notes_missing_wheelchair_type": note("(?i)wheelchair accessible") & ~tagged("X"),
    }
    return with_fresh_feed(listings, feeds, now).agg(
        F.count("*").alias("public_listings"), *[F.count_if(test).alias(n) for n, test in counters.items()]
    )


def duplicate_keys(listings: DataFrame) -> DataFrame:
    """How many (feed_id, slug) keys occur more than once, over all feeds."""
    keys = listings.groupBy("feed_id", "slug").agg(F.count("*").alias("n"))
    return keys.where(c("n") > 1).agg(F.count("*").alias("duplicate_ids"))


def stale_feeds(feeds: DataFrame, now: datetime) -> DataFrame:
    """Feeds that are not fresh, disabled ones included, and the listings they hold back."""
    stale = ~is_fresh(c("status"), c("last_ok_at"), now)
    return feeds.agg(
        F.count_if(stale).alias("stale_feeds"),
        F.coalesce(F.sum(F.when(stale, c("meeting_count"))), F.lit(0)).alias("suppressed_listings"),
    )


def incomplete_runs(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_if(c("status").isin("running", "incomplete")).alias("incomplete_runs"))


def feeds_behind(feeds: DataFrame, now: datetime) -> DataFrame:
    """Enabled feeds without a recent success; disabled ones do not count here."""
    fresh_stamp = is_fresh(F.lit("ok"), c("last_ok_at"), now)
    return feeds.agg(F.count_if((c("status") != "disabled") & ~fresh_stamp).alias("feeds_behind"))


def mapping_anomalies(
    listings: DataFrame, feeds: DataFrame, now: datetime, limit: int | None = None, span: float = SPAN_DEGREES
) -> DataFrame:
    """Cities whose dominant cluster spans too many degrees: all, or the largest `limit` in order."""
    rows = listings.where(
        (c("attendance") != "online") & c("city").isNotNull() & c("lat").isNotNull() & c("lng").isNotNull()
    ).select("feed_id", "city", "state", "country", "lat", "lng", "geohash4")
    stats = (
        with_fresh_feed(rows, feeds, now)
        .withColumns(scope_columns())
        .groupBy(*CITY, "cluster")
        .agg(
            F.count("*").alias("listings"),
            (F.max("lat") - F.min("lat")).alias("latitude_span"),
            (F.max("lng") - F.min("lng")).alias("longitude_span"),
        )
    )
    best = first_by(stats, CITY, c("listings").desc(), c("cluster").asc_nulls_last())
    wide = (c("latitude_span") > span) | (c("longitude_span") > span)
    found = best.where(c("cluster").isNotNull() & c("scope").isNotNull() & wide)
    if limit is not None:
        found = found.orderBy(c("listings").desc(), "city", "state", "country", "scope").limit(limit)
    return (
        found.select("city", "state", "country", "listings", "latitude_span", "longitude_span")
    )


def audit_counts(listings: DataFrame, feeds: DataFrame, runs: DataFrame, now: datetime) -> DataFrame:
    """All counters in one row.

    Each part is one row with its own columns; they are stacked and folded, not joined.
    """
    parts = [
        listing_counters(listings, feeds, now),
        duplicate_keys(listings),
        stale_feeds(feeds, now),
        incomplete_runs(runs),
    ]
    names = [n for p in parts for n in p.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(n).alias(n) for n in names])


def verdict(counts: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Counts plus `mapping_anomalies` and `safe`: every hard counter is zero."""
    found = anomalies.agg(F.count("*").alias("mapping_anomalies"))
    names = counts.columns
    row = counts.unionByName(found, allowMissingColumns=True).agg(
        *[F.max(n).alias(n) for n in (*names, "mapping_anomalies")]
    )
    zero = reduce(lambda a, b: a & b, [c(n) == 0 for n in (*MUST_BE_ZERO, "mapping_anomalies")])
    return row.withColumn("safe", zero)
