"""Filter and rank listings around a moment and an origin."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.functions.base import bind, let
from weekgrid.functions.clock import (
    DAY_MINUTES,
    at,
    end_minutes,
    listing_zone,
    local_weekday,
    minutes_of,
    running,
    week_title,
    zone_of_point,
)
from weekgrid.functions.geo import haversine_km
from weekgrid.functions.labels import type_label
from weekgrid.functions.text import search_fold
from weekgrid.operators.dedupe import collapse_duplicates
from weekgrid.operators.predicates import (
    attendance_is,
    fellowship_is,
    has_all_types,
    in_window,
    open_closed_is,
    within,
    without_coordinates,
)
from weekgrid.schemas import MAX_REFS, MAX_TOOL_ROWS

c = F.col

# Display order of the groups, and how long "soon" is.
GROUPS = ("happening", "soon", "later", "week", "other")
SOON_MINUTES = 120
NO_MINUTES, NO_DISTANCE = 99999, 9999.0


@dataclass(frozen=True)
class Filters:
    """What a visitor asks for; `day` is 0-6, 'today' or 'any'."""

    attendance: str = "either"
    fellowship: str = "all"
    day: int | str = "today"
    time_window: str = "any"
    open_closed: str = "any"
    types: tuple[str, ...] = ()
    query: str = ""
    radius_km: float = 15.0
    week: bool = False


SEARCHED = (
    "name", "group_name", "location_name", "city", "neighborhood", "state", "country", "address",
    "formatted_address", "notes", "location_notes", "attendance", "fellowship",
)


def haystack(columns: list[str]) -> Column:
    """Folded text of the searchable fields, the type codes and their labels."""
    texts = [c(n) for n in SEARCHED if n in columns]
    labels = F.transform("types", lambda code: type_label(code))
    return search_fold(F.concat_ws(" ", *texts, F.concat_ws(" ", "types"), F.concat_ws(" ", labels)))


def contains_all(text: Column, query: str) -> Column:
    """Every term of the query is part of the folded text."""
    terms = F.split(search_fold(F.lit(query)), " ")
    return let(text, lambda folded: F.forall(terms, lambda term: F.contains(folded, term)))


def keyword_filter(rows: DataFrame, query: str, semantic_keys: DataFrame | None = None) -> DataFrame:
    """Keyword hits, plus the rows a note search found (feed_id, slug)."""
    if not query.strip():
        return rows
    hit = contains_all(haystack(rows.columns), query)
    if semantic_keys is None:
        return rows.where(hit)
    marked = semantic_keys.select("feed_id", "slug", F.lit(True).alias("_semantic")).distinct()
    return (
        rows.join(marked, ["feed_id", "slug"], "left")
        .where(hit | F.coalesce("_semantic", F.lit(False)))
        .drop("_semantic")
    )


def key_filters(rows: DataFrame, filters: Filters) -> DataFrame:
    """Filters on parts of the duplicate key: duplicates pass or fail together, so they come before the collapse."""
    return rows.where(
        fellowship_is(filters.fellowship)
        & attendance_is(filters.attendance)
        & in_window(minutes_of(c("time")), filters.time_window)
    )


def static_filters(rows: DataFrame, filters: Filters) -> DataFrame:
    """Everything that needs neither clock nor origin."""
    return key_filters(rows, filters).where(open_closed_is(filters.open_closed) & has_all_types(filters.types))


def with_distance(rows: DataFrame, origin: tuple[float, float] | None) -> DataFrame:
    """Kilometres from the origin; null without an origin or a pin."""
    distance = F.lit(None).cast("double")
    if origin:
        distance = haversine_km(F.lit(float(origin[0])), F.lit(float(origin[1])), c("lat"), c("lng"))
    return rows.withColumn("distance_km", distance)


def with_schedule(
    rows: DataFrame, now: datetime, origin: tuple[float, float] | None = None, default_zone: str = "UTC"
) -> DataFrame:
    """Days and minutes until the next start on each listing's own wall clock."""
    zone = listing_zone(c("timezone"), c("lat"), c("lng"), c("country"), c("state"), origin)
    rows = bind(rows, zone=F.coalesce(zone, F.lit(default_zone)))
    wall = F.from_utc_timestamp(at(now), c("zone"))
    rows = bind(
        rows,
        _start=minutes_of(c("time")),
        _end=end_minutes(c("time"), c("end_time")),
        _minute=F.hour(wall) * 60 + F.minute(wall),
        _days=F.pmod(c("day") - F.dayofweek(wall) + 8, F.lit(7)),
    )
    rows = rows.withColumn("_days", F.when(c("_start").isNotNull(), c("_days")))
    rows = rows.withColumn("_ahead", c("_start") - c("_minute") + c("_days") * DAY_MINUTES)
    rows = rows.withColumn("in_progress", running(c("_ahead"), c("_start"), c("_end")))
    # A start that has passed comes round again in a week, unless the listing still runs.
    rows = rows.withColumn("_weeks", F.when(~c("in_progress") & (c("_ahead") < 0), 1).otherwise(0))
    return rows.withColumns(
        {
            "minutes_until_start": c("_ahead") + c("_weeks") * (7 * DAY_MINUTES),
            "days_until": c("_days") + c("_weeks") * 7,
        }
    ).drop("_start", "_end", "_minute", "_days", "_ahead", "_weeks")


def group_of(filters: Filters, local_day: int) -> Column:
    """Group of a row, null where the day and week choice leaves it out."""
    selected = local_day if filters.day == "today" else filters.day
    any_day = selected == "any"
    chosen = F.lit(True)
    if not any_day:
        chosen = c("day") == F.lit(selected)
        if selected == local_day:
            chosen = chosen | c("in_progress")
    wanted = chosen | F.lit(bool(filters.week))
    minutes = c("minutes_until_start")
    scheduled = (
        F.when(~wanted, F.lit(None).cast("string"))
        .when(c("in_progress"), "happening")
        .when(minutes.between(0, SOON_MINUTES) & chosen, "soon")
        .when((c("days_until") == 0) & chosen, "later")
    )
    if filters.week:
        scheduled = scheduled.otherwise("week")
    elif not any_day and filters.day != "today":
        scheduled = scheduled.when(chosen, "later")
    unscheduled = "week" if filters.week else "other" if any_day else None
    return F.when(minutes.isNull(), F.lit(unscheduled).cast("string")).otherwise(scheduled)


def rank_order(*tiebreak: str) -> list[Column]:
    """Groups in display order; inside, running first, then sooner, then nearer."""
    group = F.array_position(F.array(*[F.lit(g) for g in GROUPS]), c("group"))
    first = F.when(c("in_progress"), -1).otherwise(F.coalesce("minutes_until_start", F.lit(NO_MINUTES)))
    near = F.coalesce("distance_km", F.lit(NO_DISTANCE))
    return [group, first, near, c("feed_id"), c("slug"), *[c(t) for t in tiebreak]]


def ranked(
    listings: DataFrame,
    filters: Filters,
    now: datetime,
    origin: tuple[float, float] | None = None,
    semantic_keys: DataFrame | None = None,
    default_zone: str = "UTC",
    collapse: bool = True,
) -> DataFrame:
    """Kept rows with distance, schedule and group, not yet ordered."""
    rows = key_filters(listings, filters)
    rows = collapse_duplicates(rows) if collapse else rows
    rows = rows.where(open_closed_is(filters.open_closed) & has_all_types(filters.types))
    rows = keyword_filter(rows, filters.query, semantic_keys)
    rows = with_distance(rows, origin).where(within(c("distance_km"), filters.radius_km))
    rows = with_schedule(rows, now, origin, default_zone)
    origin_zone = (zone_of_point(*origin) if origin else None) or default_zone
    group = group_of(filters, local_weekday(now, origin_zone))
    return rows.withColumn("group", group).where(c("group").isNotNull()).withColumn("next_day", c("day"))


def rank_listings(listings: DataFrame, filters: Filters, now: datetime, **options) -> DataFrame:
    """The ranked listing page: one range-partitioned global sort, no window over a whole group."""
    return ranked(listings, filters, now, **options).orderBy(*rank_order())


def group_counts(rows: DataFrame) -> DataFrame:
    """Rows per group and, under a null group, in all."""
    return rows.rollup("group").agg(F.count("*").alias("n"))


def week_headings(rows: DataFrame) -> DataFrame:
    """Headings of the week view: rows per day distance, with their title, nulls last."""
    heads = rows.groupBy("days_until").agg(F.count("*").alias("n"), F.min("next_day").alias("day"))
    return heads.select(
        "days_until", "day", "n", week_title(c("days_until"), c("day")).alias("title")
    ).orderBy(F.coalesce("days_until", F.lit(99)))


# --- references and tool rows --------------------------------------------------------------


def nearest_refs(
    listings: DataFrame, origin: tuple[float, float] | None, radius_km: float, limit: int = MAX_REFS
) -> DataFrame:
    """Keys of the nearest listings with whole kilometres; unlocated ones count as 0."""
    near = with_distance(listings, origin).where(within(c("distance_km"), radius_km))
    whole = F.coalesce(F.floor(c("distance_km") + 0.5), F.lit(0)).cast("int")
    refs = near.select("feed_id", "slug", whole.alias("distance_km"))
    return refs.orderBy("distance_km", "feed_id", "slug").limit(limit)


def allowed_only(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose key is on the list; an empty list keeps nothing."""
    return rows.join(allowed.select("feed_id", "slug").distinct(), ["feed_id", "slug"], "left_semi")


def search_allowed(
    listings: DataFrame,
    allowed: DataFrame,
    filters: Filters,
    now: datetime,
    limit: int = MAX_TOOL_ROWS,
    default_zone: str = "UTC",
) -> DataFrame:
    """First rows of the ranking among allowed keys, without pins.

    The distance is the one given with the key; the ranking itself has no origin.
    """
    scoped = allowed_only(listings, allowed)
    rows = ranked(scoped, filters, now, default_zone=default_zone).orderBy(*rank_order()).limit(limit)
    given = allowed.groupBy("feed_id", "slug").agg(F.max("distance_km").alias("_given"))
    return without_coordinates(rows.drop("distance_km").join(given, ["feed_id", "slug"], "left"), c("_given"))
