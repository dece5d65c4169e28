"""City and neighbourhood index.

One aggregation carries everything. Rows are counted per place, cell prefix and cell, which is
partial on the map side; the dominant prefix and the averages come from those counts, so rows
are never joined back and a city with a third of all rows is a few hundred partial counts.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.functions.base import blank_null
from weekgrid.functions.text import alnum_slug
from weekgrid.operators.dedupe import first_by
from weekgrid.operators.serving import with_fresh_feed
from weekgrid.schemas import GENERIC_CITIES, TOP_CITIES

c = F.col

CITY = ["city", "state", "country", "scope"]
HOOD = ["neighborhood", *CITY]


def scope_columns() -> dict[str, Column]:
    """Cell prefix of a row, and the prefix again where no country tells same-named cities apart."""
    prefix = F.substring("geohash4", 1, 3)
    return {"cluster": prefix, "scope": F.when(c("country").isNull(), prefix).otherwise("")}


def eligible(listings: DataFrame, feeds: DataFrame, now: datetime) -> DataFrame:
    """Scheduled rows of fresh feeds with a real city, online or located."""
    located = c("formatted_address").isNotNull() & c("lat").isNotNull() & c("lng").isNotNull()
    rows = listings.where(
        c("city").isNotNull()
        & ~F.lower("city").isin(*GENERIC_CITIES)
        & c("day").isNotNull()
        & c("time").isNotNull()
        & ((c("attendance") == "online") | located)
    ).select("feed_id", "neighborhood", "city", "state", "country", "attendance", "lat", "lng", "geohash4")
    return with_fresh_feed(rows, feeds, now).withColumns(scope_columns())


def cell_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and coordinate sums per key, cell prefix and cell; in-person rows also apart."""
    here = c("attendance") == "in-person"
    sums = {}
    for axis in ("lat", "lng"):
        for name, value in (("all", c(axis)), ("here", F.when(here, c(axis)))):
            sums[f"{axis}_{name}"] = F.sum(value)
            sums[f"n_{axis}_{name}"] = F.count(value)
    return rows.groupBy(*keys, "cluster", "geohash4").agg(
        F.count("*").alias("n"), F.count_if(here).alias("n_here"), *[v.alias(k) for k, v in sums.items()]
    )


def cluster_stats(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and cell prefix: row count, averages and modal cell, in-person rows first."""

    def mean(axis: str) -> Column:
        here = F.sum(f"{axis}_here") / F.nullif(F.sum(f"n_{axis}_here"), F.lit(0))
        every = F.sum(f"{axis}_all") / F.nullif(F.sum(f"n_{axis}_all"), F.lit(0))
        return F.coalesce(here, every).cast("float").alias(axis)

    def mode(count: str) -> Column:
        ranked = F.struct((-c(count)).alias("n"), c("geohash4").alias("cell"))
        return F.min(F.when((c(count) > 0) & c("geohash4").isNotNull(), ranked))["cell"]

    return counts.groupBy(*keys, "cluster").agg(
        F.sum("n").alias("meeting_count"),
        mean("lat"),
        mean("lng"),
        F.coalesce(mode("n_here"), mode("n")).alias("geohash4"),
    )


def dominant(stats: DataFrame, keys: list[str]) -> DataFrame:
    """The cell prefix with most rows per key; ties go to the first prefix."""
    return first_by(stats, keys, c("meeting_count").desc(), c("cluster").asc_nulls_last())


def _slug(*parts: Column) -> Column:
    def optional(value: Column) -> Column:
        return F.coalesce(blank_null(alnum_slug(value)), F.lit("xx"))

    scope = F.when(c("country").isNull(), F.concat(F.lit("-"), F.coalesce("scope", F.lit("geo")))).otherwise("")
    return F.concat(
        F.concat_ws("-", *[alnum_slug(p) for p in parts], optional(c("state")), optional(c("country"))), scope
    )


PLACE = ("slug", "label", "state", "country", "lat", "lng", "geohash4", "meeting_count", "parent_label", "aliases")


def city_places(rows: DataFrame) -> DataFrame:
    """One row per city, from its dominant cluster."""
    best = dominant(cluster_stats(cell_counts(rows.where(c("cluster").isNotNull()), CITY), CITY), CITY)
    return best.select(
        _slug(c("city")).alias("slug"),
        c("city").alias("label"),
        "state",
        "country",
        "lat",
        "lng",
        "geohash4",
        "meeting_count",
        F.lit(None).cast("string").alias("parent_label"),
        F.array("city").alias("aliases"),
    )


def neighborhood_places(rows: DataFrame) -> DataFrame:
    """One row per neighbourhood that is named otherwise than its city."""
    named = rows.where(
        c("cluster").isNotNull()
        & blank_null(F.trim("neighborhood")).isNotNull()
        & (F.lower("neighborhood") != F.lower("city"))
    )
    best = dominant(cluster_stats(cell_counts(named, HOOD), HOOD), HOOD)
    return best.select(
        _slug(c("neighborhood"), c("city")).alias("slug"),
        c("neighborhood").alias("label"),
        "state",
        "country",
        "lat",
        "lng",
        "geohash4",
        "meeting_count",
        c("city").alias("parent_label"),
        F.array("neighborhood", "city", F.concat_ws(", ", "neighborhood", "city")).alias("aliases"),
    )


def aggregated_places(rows: DataFrame) -> DataFrame:
    return city_places(rows).unionByName(neighborhood_places(rows))


def unique_places(places: DataFrame) -> DataFrame:
    """One row per label and cell, cities before neighbourhoods; then one row per slug."""
    named = places.withColumns(
        {"_state": F.coalesce("state", F.lit("")), "_country": F.coalesce("country", F.lit(""))}
    )
    spot = first_by(
        named,
        ["label", "_state", "_country", "geohash4"],
        F.when(c("parent_label").isNull(), 0).otherwise(1).asc(),
        c("meeting_count").desc(),
        c("slug").asc(),
    )
    return first_by(
        spot, ["slug"], c("meeting_count").desc(), c("label").asc(), c("geohash4").asc(), c("parent_label").asc_nulls_first()
    ).select(*PLACE)


def city_index(listings: DataFrame, feeds: DataFrame, now: datetime) -> DataFrame:
    return unique_places(aggregated_places(eligible(listings, feeds, now)))


# --- incremental ---------------------------------------------------------------------------


def rebuild_plan(dirty: bool, written_feeds: int) -> str:
    """full after a catalog change, incremental when feeds were written, else skip."""
    return "full" if dirty else "incremental" if written_feeds else "skip"


def touched_cells(listings: DataFrame, written: DataFrame) -> DataFrame:
    """Cells holding a row of a written feed."""
    mine = listings.join(written.select("feed_id").distinct(), "feed_id", "left_semi")
    return mine.where(c("geohash4").isNotNull()).select("geohash4").distinct()


def null_safe_match(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Key equality with null equal to null; still a hash join."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def touched_places(rows: DataFrame, previous: DataFrame, cells: DataFrame) -> DataFrame:
    """Keys of the cities with a row, or a previous place, in a touched cell."""
    now = rows.join(cells, "geohash4", "left_semi").select(*CITY)
    before = keyed(previous).join(cells, "geohash4", "left_semi").select(*CITY)
    return now.union(before).distinct()


def keyed(places: DataFrame) -> DataFrame:
    """Places with the key columns of their city."""
    return places.withColumns(
        {
            "city": F.coalesce("parent_label", "label"),
            "scope": F.when(c("country").isNull(), F.regexp_extract("slug", "([^-]*)$", 1)).otherwise(""),
        }
    )


def refresh_places(previous: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Aggregated places after a change of the listings in `cells` (old and new cells of the change).

    Every row of a touched city is rolled up again, not only its rows in the touched cells, so the
    result equals a full roll-up.
    """
    hit = touched_places(rows, previous, cells)
    again = aggregated_places(rows.join(hit, null_safe_match(rows, hit, CITY), "left_semi"))
    old = keyed(previous)
    kept = old.join(hit, null_safe_match(old, hit, CITY), "left_anti")
    return kept.select(*PLACE).unionByName(again.select(*PLACE))


def simple_city_rollup(listings: DataFrame) -> DataFrame:
    """Plain roll-up by city and country, for places with any coordinate."""
    rows = listings.where(c("city").isNotNull()).withColumn("cluster", F.lit(""))
    keys = ["city", "country"]
    stats = cluster_stats(cell_counts(rows, keys), keys).where(c("lat").isNotNull())
    slug = F.concat(
        F.lower(F.regexp_replace("city", "[^a-zA-Z0-9]+", "-")), F.lit("-"), F.coalesce(F.lower("country"), F.lit("xx"))
    )
    return stats.select(
        slug.alias("slug"), c("city").alias("label"), "country", "lat", "lng", "geohash4", "meeting_count"
    )


def top_cities(cities: DataFrame, limit: int = TOP_CITIES) -> DataFrame:
    return cities.orderBy(c("meeting_count").desc(), c("slug")).limit(limit)
