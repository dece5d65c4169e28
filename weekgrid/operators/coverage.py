"""Coverage: cells, totals and feed states."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrid.operators.predicates import is_fresh
from weekgrid.operators.serving import public_listings, with_fresh_feed
from weekgrid.schemas import TOP_CELLS

c = F.col


def coverage_cells(listings: DataFrame, feeds: DataFrame, now: datetime) -> DataFrame:
    """Rows and mean pin of every cell of fresh feeds, safe or not; partial on the map side."""
    rows = listings.where(c("geohash4").isNotNull()).select("feed_id", "geohash4", "lat", "lng")
    return (
        with_fresh_feed(rows, feeds, now)
        .groupBy("geohash4")
        .agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    )


def top_cells(cells: DataFrame, limit: int = TOP_CELLS) -> DataFrame:
    return cells.orderBy(c("n").desc(), c("geohash4")).limit(limit)


def feed_totals(feeds: DataFrame, now: datetime) -> DataFrame:
    """Fresh, enabled and all feeds, and their number by status as a map."""
    by_status = feeds.groupBy("status").agg(
        F.count("*").alias("n"), F.count_if(is_fresh(c("status"), c("last_ok_at"), now)).alias("fresh")
    )
    # Statuses are a handful of words; the second step sees one row per status.
    return by_status.agg(
        F.sum("fresh").alias("fresh_feeds"),
        F.sum(F.when(c("status") != "disabled", c("n")).otherwise(0)).alias("enabled_feeds"),
        F.sum("n").alias("catalog_feeds"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("by_status"),
    )


def status_counts(feeds: DataFrame) -> DataFrame:
    return feeds.groupBy("status").agg(F.count("*").alias("n"))


def fresh_occurrences(listings: DataFrame, feeds: DataFrame, now: datetime) -> DataFrame:
    return public_listings(listings, feeds, now).agg(F.count("*").alias("fresh_weekly_occurrences"))
