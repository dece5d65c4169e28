"""Row rules: which feeds are fresh, which listings are safe to show, which rows ingest keeps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.functions.base import blank_null
from weekgrid.functions.clock import at
from weekgrid.functions.text import slugify
from weekgrid.schemas import CACHE_STALE_HOURS, FRESHNESS_HOURS, GENERIC_CITIES, OLD_LISTING_DAYS

c = F.col


def hours_before(now: Column, hours: int) -> Column:
    return now - F.make_dt_interval(hours=F.lit(hours))


def is_fresh(status: Column, last_ok_at: Column, now: datetime) -> Column:
    """Source that succeeded within the freshness window, bounds included; null is not fresh."""
    since = hours_before(at(now), FRESHNESS_HOURS)
    return F.coalesce((status == "ok") & (last_ok_at >= since), F.lit(False))


def is_safe() -> Column:
    """Scheduled, and online or fully placed under a plausible city label."""
    city = F.trim(c("city"))
    placed = (
        c("formatted_address").isNotNull()
        & c("lat").isNotNull()
        & c("lng").isNotNull()
        & ~F.lower(city).isin(*GENERIC_CITIES)
        & ~city.rlike("^[A-Z]{2,3}$")
        & (F.length(city) <= 80)
    )
    return F.coalesce(
        c("day").isNotNull() & c("time").isNotNull() & ((c("attendance") == "online") | placed), F.lit(False)
    )


def is_malformed_city() -> Column:
    """City labels the audit counts as malformed; stricter than the safety rule."""
    city = F.trim(c("city"))
    return F.coalesce(
        F.lower(city).isin(*GENERIC_CITIES)
        | city.rlike(r"^[A-Z]{2,3}$|^[A-Z]{2}\s+\d|^\d{5}")
        | (F.length(city) > 80),
        F.lit(False),
    )


def attendance_is(wanted: str) -> Column:
    """`online` and `in-person` both keep hybrid listings; `either` keeps all."""
    other = {"online": "in-person", "in-person": "online"}.get(wanted)
    return F.lit(True) if other is None else c("attendance") != other


def fellowship_is(wanted: str) -> Column:
    return F.lit(True) if wanted == "all" else F.coalesce(blank_null(c("fellowship")), F.lit("aa")) == wanted


def open_closed_is(wanted: str) -> Column:
    return F.lit(True) if wanted == "any" else F.array_contains("types", wanted)


def has_all_types(wanted: list[str] | tuple[str, ...]) -> Column:
    if not wanted:
        return F.lit(True)
    return F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), c("types"))) == 0


# Time windows as [from, to) minutes; the evening has no end.
WINDOWS = {"morning": (300, 720), "afternoon": (720, 1020), "evening": (1020, None)}


def in_window(start: Column, window: str) -> Column:
    """Start minute inside the window; unknown starts pass."""
    if window == "any":
        return F.lit(True)
    low, high = WINDOWS[window]
    inside = start >= low if high is None else (start >= low) & (start < high)
    return start.isNull() | inside


def within(distance: Column, radius_km: float) -> Column:
    """Unlocated rows pass any radius."""
    return distance.isNull() | (distance <= radius_km)


def keep_rules(rows: DataFrame) -> DataFrame:
    """The ordered ingest rules up to enrichment, as a `drop_reason` (null = kept).

    Rows without a pin but with a join link become online first.
    """
    pinned = c("lat").isNotNull() & c("lng").isNotNull()
    coerced = ~pinned & (blank_null(c("conference_url")).isNotNull())
    types = F.when(
        coerced & ~F.array_contains("types", "ONL"), F.array_append("types", "ONL")
    ).otherwise(c("types"))
    rows = rows.withColumns(
        {"types": types, "attendance": F.when(coerced, "online").otherwise(c("attendance"))}
    )
    offline = c("attendance") != "online"
    return rows.withColumn(
        "drop_reason",
        F.when(offline & ~pinned, "no coordinates")
        .when(c("day").isNull() | c("time").isNull(), "no schedule")
        .when(offline & blank_null(c("formatted_address")).isNull(), "no address"),
    )


def city_rule(rows: DataFrame) -> DataFrame:
    """The rule after enrichment: a placed listing needs a city."""
    missing = (c("attendance") != "online") & blank_null(c("city")).isNull()
    return rows.withColumn(
        "drop_reason", F.coalesce("drop_reason", F.when(missing, "no city"))
    )


def cache_class(fetched_at: Column, now: datetime) -> Column:
    """expired, stale or fresh by the age of a stored slice."""
    instant = at(now)
    return (
        F.when(fetched_at < hours_before(instant, FRESHNESS_HOURS), "expired")
        .when(fetched_at < hours_before(instant, CACHE_STALE_HOURS), "stale")
        .otherwise("fresh")
    )


def usable_slices(stored: DataFrame, now: datetime) -> DataFrame:
    """Stored slice rows that may still be shown, with their class.

    Expired slices go; rows are judged by their own source stamp; a slice whose rows all fail goes
    with them.
    """
    current = c("source_verified_at") >= hours_before(at(now), FRESHNESS_HOURS)
    return (
        stored.withColumn("cache_class", cache_class(c("fetched_at"), now))
        .where((c("cache_class") != "expired") & F.coalesce(current, F.lit(False)))
    )


def is_old(updated_at: Column, now: datetime) -> Column:
    cutoff = at(now) - F.make_dt_interval(days=F.lit(OLD_LISTING_DAYS))
    return F.coalesce(updated_at < cutoff, F.lit(False))


def without_details(rows: DataFrame) -> DataFrame:
    """List form of a listing: long texts emptied."""
    return rows.withColumns(
        {
            "notes": F.lit(None).cast("string"),
            "location_notes": F.lit(None).cast("string"),
            "feedback_emails": F.array().cast("array<string>"),
        }
    )


TOOL_COLUMNS = (
    "feed_id", "slug", "name", "group_name", "day", "time", "end_time", "types", "attendance",
    "fellowship", "location_name", "address", "city", "neighborhood", "notes", "location_notes",
    "conference_url", "conference_phone",
)


def without_coordinates(rows: DataFrame, distance: Column) -> DataFrame:
    """Listing fields without any pin, plus a whole-kilometre distance and a link."""
    have = [n for n in TOOL_COLUMNS if n in rows.columns]
    return rows.select(
        *have,
        F.coalesce(distance, F.lit(0)).alias("distance_km"),
        F.concat(F.lit("/meetings/"), "feed_id", F.lit("/"), "slug").alias("href"),
    )


def city_matches(query: str) -> Column:
    """Query is part of the label, the slug, the parent or an alias, whatever its case."""
    needle = F.lit(query.lower())
    aliases = F.concat_ws(",", "aliases")
    return F.greatest(
        *[
            F.coalesce(F.contains(F.lower(v), needle), F.lit(False))
            for v in (c("label"), c("slug"), c("parent_label"), aliases)
        ]
    )


def entity_id(feed_id: Column, name: Column) -> Column:
    return F.when(
        blank_null(name).isNotNull(), F.concat(feed_id, F.lit(":"), slugify(name))
    )
