"""Registered queries: serving, ranking and note search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrid.functions.base import bind
from weekgrid.functions.geo import cosine_similarity, format_distance
from weekgrid.functions.text import search_fold
from weekgrid.operators import cities as city_ops
from weekgrid.operators import coverage, dedupe, notes, predicates, rank, rollup, serving, slices
from weekgrid.operators.staging import staged
from weekgrid.plans.registry import query
from weekgrid.plans.views import CTES, NOW, NOW_SQL, entities, feeds, haversine_sql, listings, slug_sql, table
from weekgrid.schemas import SLICE_CAP

c = F.col

ORIGIN = (0.5, 0.3)
BERLIN = (51.2, 6.8)


def _safe(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    need = ("feed_id", "day", "time", "attendance", "city", "lat", "lng", "formatted_address")
    return serving.public_listings(listings(spark, sf, *dict.fromkeys((*need, *columns))), feeds(spark, sf), NOW)


@query(CTES + "select feed_id, feed_name, source_verified_at from fresh")
def fresh_feeds(spark: SparkSession, sf: str) -> DataFrame:
    return serving.fresh_feeds(feeds(spark, sf), NOW).select(
        c("id").alias("feed_id"), c("name").alias("feed_name"), c("last_ok_at").alias("source_verified_at")
    )


@query(CTES + "select feed_id, slug, day, time, city, source_verified_at from safe")
def safe_listings(spark: SparkSession, sf: str) -> DataFrame:
    return _safe(spark, sf, "slug").select("feed_id", "slug", "day", "time", "city", "source_verified_at")


@query(
    CTES
    + "select geohash4, count(*) as n, cast(cast(avg(lat) as real) as double) as lat, "
    "cast(cast(avg(lng) as real) as double) as lng from public where geohash4 is not null group by geohash4"
)
def coverage_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = coverage.coverage_cells(listings(spark, sf, "feed_id", "lat", "lng", "geohash4"), feeds(spark, sf), NOW)
    real = lambda n: c(n).cast("float").cast("double").alias(n)
    return cells.select("geohash4", "n", real("lat"), real("lng"))


@query(
    CTES
    + "select geohash4, n from (select geohash4, count(*) as n from public where geohash4 is not null group by geohash4) "
    "order by n desc, geohash4 limit 400"
)
def top_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = coverage.coverage_cells(listings(spark, sf, "feed_id", "lat", "lng", "geohash4"), feeds(spark, sf), NOW)
    return coverage.top_cells(cells).select("geohash4", "n")


@query(CTES + "select count(*) as fresh_weekly_occurrences from safe")
def fresh_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, "feed_id", "day", "time", "attendance", "city", "lat", "lng", "formatted_address")
    return coverage.fresh_occurrences(rows, feeds(spark, sf), NOW)


@query(
    CTES
    + f"""select
  count(*) filter (where status = 'ok' and last_ok_at >= {NOW_SQL} - interval '48' hour) as fresh_feeds,
  cast(count(*) filter (where status <> 'disabled') as bigint) as enabled_feeds, count(*) as catalog_feeds,
  count(*) filter (where status = 'ok') as ok_feeds, count(*) filter (where status = 'error') as error_feeds,
  count(*) filter (where status = 'disabled') as disabled_feeds
from feeds"""
)
def feed_totals(spark: SparkSession, sf: str) -> DataFrame:
    totals = coverage.feed_totals(feeds(spark, sf), NOW)
    by = lambda s: F.coalesce(F.try_element_at("by_status", F.lit(s)), F.lit(0)).alias(f"{s}_feeds")
    return totals.select("fresh_feeds", "enabled_feeds", "catalog_feeds", by("ok"), by("error"), by("disabled"))


@query(CTES + "select status, count(*) as n from feeds group by status")
def feed_status(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.status_counts(feeds(spark, sf))


# --- duplicates ----------------------------------------------------------------------------

_KEY_SQL = f"""coalesce({slug_sql("name")}, '') || '|' || coalesce(cast(day as varchar), 'x') || '|' || coalesce(time, 'x')
  || '|' || coalesce(fellowship, 'aa') || '|' || attendance || '|' || coalesce({slug_sql("location_name")},
  {slug_sql("address")}, printf('%.3f', lat) || ':' || printf('%.3f', lng), {slug_sql("city")})"""
_FULL_SQL = """(case when formatted_address <> '' then 1 else 0 end + case when address <> '' then 1 else 0 end
  + case when notes <> '' then 1 else 0 end + case when conference_url <> '' then 1 else 0 end
  + case when location_notes <> '' then 1 else 0 end + 1
  + case when source_verified_at is not null then 1 else 0 end)"""
_COLLAPSED = (
    CTES
    + f""", keyed as (select *, {_KEY_SQL} as k, {_FULL_SQL} as filled from public),
collapsed as (select * from (select *, row_number() over (partition by k
  order by filled desc, source_verified_at desc nulls last, slug, feed_id, price) as rn from keyed) where rn = 1)
"""
)


def _public(spark: SparkSession, sf: str) -> DataFrame:
    return serving.with_fresh_feed(listings(spark, sf), feeds(spark, sf), NOW)


@query(_COLLAPSED + "select feed_id, slug, filled, k as duplicate_key from collapsed")
def collapse_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedupe.collapse_duplicates(_public(spark, sf))
    return kept.select(
        "feed_id", "slug", dedupe.completeness().alias("filled"), dedupe.duplicate_key().alias("duplicate_key")
    )


@query(
    CTES
    + "select feed_id, slug, updated_at, price from (select *, row_number() over (partition by feed_id, slug "
    "order by updated_at desc, price desc) as rn from listings) where rn = 1"
)
def dedupe_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, "feed_id", "slug", "updated_at", "price")
    return dedupe.last_per_slug(rows, c("updated_at"), c("price"))


# --- ranking -------------------------------------------------------------------------------

# Offsets of the zones in the views at the fixed moment, Monday 2001-11-05 00:00 UTC.
_BOX_SQL = """case
  when lat between 18.5 and 22.5 and lng between -161 and -154 then 'Pacific/Honolulu'
  when lat between 51 and 72 and lng between -172 and -129 then 'America/Anchorage'
  when lat between 24 and 72 and lng between -135 and -52 then case when lng >= -85 then 'America/New_York'
    when lng >= -101 then 'America/Chicago' when lat <= 37.5 and lng between -115 and -109 then 'America/Phoenix'
    when lng >= -115 then 'America/Denver' else 'America/Los_Angeles' end
  when lat between 49 and 61 and lng between -11 and 2 then 'Europe/London'
  when lat between 51 and 56 and lng between 2 and 8 then 'Europe/Berlin' end"""


def _schedule_sql(source: str, origin_zone: str | None) -> str:
    """Zone, wall clock and weekly distance of every row of `source`."""
    named = "case when timezone in ('Europe/London', 'America/New_York', 'UTC') then timezone end"
    origin = f"'{origin_zone}'" if origin_zone else "null"
    return f"""zoned as (select *, coalesce(case when {named} <> 'UTC' then {named} end, {_BOX_SQL}, {origin},
  {named}, 'UTC') as zone from {source}),
walled as (select *, 0 + case zone when 'Europe/London' then 0 when 'UTC' then 0 when 'Europe/Berlin' then 60
  when 'America/New_York' then -300 when 'America/Chicago' then -360 when 'America/Denver' then -420
  when 'America/Phoenix' then -420 when 'America/Los_Angeles' then -480 when 'America/Anchorage' then -540
  when 'Pacific/Honolulu' then -600 end as shift,
  cast(substr(time, 1, 2) as int) * 60 + cast(substr(time, 4, 2) as int) as starts,
  cast(substr(end_time, 1, 2) as int) * 60 + cast(substr(end_time, 4, 2) as int) as ends from zoned),
clocked as (select *, case when shift < 0 then 0 else 1 end as wday, (shift + 1440) % 1440 as wmin,
  coalesce(ends, (starts + 60) % 1440) as stops from walled),
ahead as (select *, case when day is not null and starts is not null then (day - wday + 7) % 7 end as dd,
  case when stops - starts <= 0 then stops - starts + 1440 else stops - starts end as lasts from clocked),
moved as (select *, starts - wmin + dd * 1440 as dm from ahead),
timed as (select *, coalesce(dm <= 0 and dm > -lasts, false) as in_progress,
  case when not coalesce(dm <= 0 and dm > -lasts, false) and dm < 0 then dm + 10080 else dm end as minutes_until_start,
  case when not coalesce(dm <= 0 and dm > -lasts, false) and dm < 0 then dd + 7 else dd end as days_until from moved)"""


_NEAR_SQL = f""", near as (select *, {haversine_sql("0.5", "0.3", "lat", "lng")} as km from collapsed),
inside as (select * from near where km is null or km <= 4000),
{_schedule_sql("inside", None)},
grouped as (select *, case when dm is null then null
  when not (day = 1 or in_progress) then null
  when in_progress then 'happening' when minutes_until_start between 0 and 120 and (day = 1 or in_progress) then 'soon'
  when days_until = 0 then 'later' end as grp from timed)
"""


@query(
    _COLLAPSED
    + _NEAR_SQL
    + 'select feed_id, slug, grp as "group", round(km, 6) as distance_km, cast(minutes_until_start as int) as minutes_until_start, '
    "cast(days_until as int) as days_until, in_progress, zone from grouped where grp is not null"
)
def rank_nearby(spark: SparkSession, sf: str) -> DataFrame:
    rows = rank.rank_listings(_public(spark, sf), rank.Filters(radius_km=4000.0), NOW, origin=ORIGIN)
    return rows.select(
        "feed_id", "slug", "group", F.round("distance_km", 6).alias("distance_km"),
        "minutes_until_start", "days_until", "in_progress", "zone",
    )


_WEEK = rank.Filters(day="any", week=True, radius_km=6000.0)
_WEEK_SQL = (
    _COLLAPSED
    + f""", near as (select *, {haversine_sql("51.2", "6.8", "lat", "lng")} as km from collapsed),
inside as (select * from near where km is null or km <= 6000),
{_schedule_sql("inside", "Europe/Berlin")},
grouped as (select *, case when dm is null then 'week' when in_progress then 'happening'
  when minutes_until_start between 0 and 120 then 'soon' when days_until = 0 then 'later' else 'week' end as grp from timed)
"""
)


def _week_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rank.ranked(_public(spark, sf), _WEEK, NOW, origin=BERLIN)


@query(_WEEK_SQL + 'select grp as "group", count(*) as n from grouped group by rollup (grp)')
def rank_week_groups(spark: SparkSession, sf: str) -> DataFrame:
    return rank.group_counts(_week_rows(spark, sf))


@query(
    _WEEK_SQL
    + """select cast(days_until as int) as days_until, cast(min(day) as int) as day, count(*) as n,
  case when days_until = 0 then 'today' when days_until = 1 then 'tomorrow'
    when days_until = 7 and min(day) is not null then 'next ' || array_extract(['sun', 'mon', 'tue', 'wed', 'thu', 'fri', 'sat'], min(day) + 1)
    when min(day) is not null then array_extract(['sun', 'mon', 'tue', 'wed', 'thu', 'fri', 'sat'], min(day) + 1)
    else 'upcoming' end as title
from grouped group by days_until"""
)
def week_headings(spark: SparkSession, sf: str) -> DataFrame:
    return rank.week_headings(_week_rows(spark, sf))


@query(
    CTES
    + "select feed_id, slug, time from public where time is null or (cast(substr(time, 1, 2) as int) >= 12 and cast(substr(time, 1, 2) as int) < 17)"
)
def time_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = serving.with_fresh_feed(listings(spark, sf, "feed_id", "slug", "time"), feeds(spark, sf), NOW)
    return rows.where(predicates.in_window(rank.minutes_of(c("time")), "afternoon")).select("feed_id", "slug", "time")


@query(
    CTES
    + "select feed_id, slug, types_text from public where list_contains(types, 'O') and list_contains(types, 'BE') and "
    "list_contains(types, 'X')"
)
def types_all_of(spark: SparkSession, sf: str) -> DataFrame:
    rows = serving.with_fresh_feed(listings(spark, sf, "feed_id", "slug", "types"), feeds(spark, sf), NOW)
    return rows.where(predicates.has_all_types(("O", "BE", "X"))).select("feed_id", "slug", "types_text")


@query(
    CTES
    + f"select feed_id, slug, round({haversine_sql('0.5', '0.3', 'lat', 'lng')}, 6) as distance_km from public "
    f"where lat is null or {haversine_sql('0.5', '0.3', 'lat', 'lng')} <= 1500"
)
def radius_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = serving.with_fresh_feed(listings(spark, sf, "feed_id", "slug", "lat", "lng"), feeds(spark, sf), NOW)
    near = rank.with_distance(rows, ORIGIN).where(predicates.within(c("distance_km"), 1500.0))
    return near.select("feed_id", "slug", F.round("distance_km", 6).alias("distance_km"))


@query(
    CTES
    + "select feed_id, slug, attendance, fellowship, types_text from public where coalesce(nullif(fellowship, ''), 'aa') = 'aa' "
    "and attendance <> 'in-person' and list_contains(types, 'C')"
)
def static_filters(spark: SparkSession, sf: str) -> DataFrame:
    columns = ("feed_id", "slug", "attendance", "fellowship", "types", "time")
    rows = serving.with_fresh_feed(listings(spark, sf, *columns), feeds(spark, sf), NOW)
    kept = rank.static_filters(rows, rank.Filters(attendance="online", fellowship="aa", open_closed="C"))
    return kept.select("feed_id", "slug", "attendance", "fellowship", "types_text")


@query(
    CTES
    + """select feed_id, slug, name from public where
  contains(lower(concat_ws(' ', name, location_name, city, neighborhood, state, country, address, formatted_address, notes,
    location_notes, attendance, fellowship, array_to_string(types, ' '),
    array_to_string(list_transform(types, lambda t: case t when 'O' then 'Open' when 'C' then 'Closed' when 'BE' then 'Newcomer'
      when 'X' then 'Wheelchair Access' when 'ONL' then 'Online Meeting' else t end), ' '))), 'newcomer')
  and contains(lower(concat_ws(' ', name, location_name, city, neighborhood, state, country, address, formatted_address, notes,
    location_notes, attendance, fellowship)), 'hall 1')"""
)
def keyword_listings(spark: SparkSession, sf: str) -> DataFrame:
    rows = _public(spark, sf)
    newcomers = rank.keyword_filter(rows, "  NÉWcomer ")
    text = rank.haystack(rows.columns)
    return newcomers.where(F.contains(text, search_fold(F.lit("Hall  1")))).select("feed_id", "slug", "name")


_FOLD_SQL = "trim(regexp_replace(lower(strip_accents({0})), '\\s+', ' ', 'g'))"


@query(
    f"select doc_id, lang, length({_FOLD_SQL.format('text')}) as folded_chars from documents "
    f"where contains({_FOLD_SQL.format('text')}, 'tion') and contains({_FOLD_SQL.format('text')}, 'er')"
)
def keyword_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = bind(table(spark, sf, "documents"), folded=search_fold(c("text"))).select("doc_id", "lang", "folded")
    hits = docs.where(rank.contains_all(c("folded"), "TIÔN  Ér"))
    return hits.select("doc_id", "lang", F.length("folded").cast("bigint").alias("folded_chars"))


@query(
    CTES
    + f"""select feed_id, slug, distance_km from (select feed_id, slug, price,
  cast(coalesce(floor({haversine_sql('0.5', '0.3', 'lat', 'lng')} + 0.5), 0) as int) as distance_km from public
  where lat is null or {haversine_sql('0.5', '0.3', 'lat', 'lng')} <= 1500) order by distance_km, feed_id, slug limit 200"""
)
def nearest_refs(spark: SparkSession, sf: str) -> DataFrame:
    rows = serving.with_fresh_feed(listings(spark, sf, "feed_id", "slug", "lat", "lng"), feeds(spark, sf), NOW)
    return rank.nearest_refs(rows, ORIGIN, 1500.0)


# Allowed keys: one per labelled document, which names a listing by its number.
_ALLOWED_SQL = """, allowed as (select concat('feed-', l_suppkey) as feed_id, concat('m-', l_orderkey, '-', l_linenumber) as slug,
  max(cast(d.doc_id % 30 as int)) as distance_km from lineitem join labels d on l_orderkey = d.doc_id group by 1, 2)
"""


def _allowed(spark: SparkSession, sf: str) -> DataFrame:
    keys = listings(spark, sf, "feed_id", "slug").withColumn(
        "order_no", F.split("slug", "-")[1].cast("bigint")
    )
    labels = table(spark, sf, "labels").select(c("doc_id").alias("order_no"))
    near = (c("order_no") % 30).cast("int")
    return keys.join(labels, "order_no").groupBy("feed_id", "slug").agg(F.max(near).alias("distance_km"))


@query(
    CTES + _ALLOWED_SQL + "select feed_id, slug, price from listings where (feed_id, slug) in (select feed_id, slug from allowed)"
)
def allow_list_semi(spark: SparkSession, sf: str) -> DataFrame:
    return rank.allowed_only(listings(spark, sf, "feed_id", "slug", "price"), _allowed(spark, sf))


@query(
    _COLLAPSED.replace("keyed as (", _ALLOWED_SQL.strip()[2:] + ", keyed as (").replace(
        "from public),", "from public where (feed_id, slug) in (select feed_id, slug from allowed)),"
    )
    + f""", {_schedule_sql("collapsed", None)},
grouped as (select *, case when dm is null then 'week' when in_progress then 'happening'
  when minutes_until_start between 0 and 120 then 'soon' when days_until = 0 then 'later' else 'week' end as grp from timed),
best as (select * from grouped order by array_position(['happening', 'soon', 'later', 'week', 'other'], grp),
  case when in_progress then -1 else coalesce(minutes_until_start, 99999) end, feed_id, slug limit 8)
select b.feed_id, b.slug, b.name, a.distance_km, '/meetings/' || b.feed_id || '/' || b.slug as href
from best b join allowed a on a.feed_id = b.feed_id and a.slug = b.slug"""
)
def search_allowed(spark: SparkSession, sf: str) -> DataFrame:
    rows = rank.search_allowed(
        _public(spark, sf), _allowed(spark, sf), rank.Filters(day="any", week=True), NOW
    )
    return rows.select("feed_id", "slug", "name", "distance_km", "href")


# --- single rows and pages -----------------------------------------------------------------


@query(
    CTES
    + """select s.feed_id, s.slug, coalesce(e.name, s.feed_name) as entity_name, e.phone as entity_phone,
  coalesce(s.fellowship, 'aa') as fellowship, s.source_verified_at
from safe s left join entities e on e.id = s.entity_id"""
)
def served_listings(spark: SparkSession, sf: str) -> DataFrame:
    rows = serving.with_entity(
        _safe(spark, sf, "slug", "fellowship", "types", "entity_id"), entities(spark, sf)
    )
    return rows.select("feed_id", "slug", "entity_name", "entity_phone", "fellowship", "source_verified_at")


@query(
    CTES
    + """, firstkey as (select feed_id, min(slug) as slug from safe where feed_id = (select min(feed_id) from safe) group by 1)
select distinct s.feed_id, s.slug, s.name, coalesce(e.name, s.feed_name) as entity_name
from safe s join firstkey k on k.feed_id = s.feed_id and k.slug = s.slug left join entities e on e.id = s.entity_id"""
)
def get_listing(spark: SparkSession, sf: str) -> DataFrame:
    first = _safe(spark, sf, "slug").agg(F.min(F.struct("feed_id", "slug")).alias("k")).first()
    rows = serving.get_listing(
        listings(spark, sf), feeds(spark, sf), entities(spark, sf), first.k.feed_id, first.k.slug, NOW
    )
    return rows.select("feed_id", "slug", "name", "entity_name")


@query(
    CTES
    + f""", page as (select * from safe where attendance in ('online', 'hybrid')
  order by day nulls last, time nulls last, feed_id, slug, updated_at, price limit 200 offset 150),
keyed as (select *, {_KEY_SQL} as k, {_FULL_SQL} as filled from page),
kept as (select * from (select *, row_number() over (partition by k order by filled desc, source_verified_at desc nulls last,
  slug, feed_id) as rn from keyed) where rn = 1)
select k.feed_id, k.slug, k.day, k.time, coalesce(e.name, k.feed_name) as entity_name
from kept k left join entities e on e.id = k.entity_id"""
)
def online_page(spark: SparkSession, sf: str) -> DataFrame:
    page = serving.online_page(
        listings(spark, sf), feeds(spark, sf), entities(spark, sf), NOW, limit=200, offset=150,
        tiebreak=("updated_at", "price"),
    )
    return page.select("feed_id", "slug", "day", "time", "entity_name")


# --- slices --------------------------------------------------------------------------------

# Cells around a cell, from its letters: 10 bits per axis, longitude wraps, latitude stops.
_RING_SQL = """, cells as (select distinct geohash4 as g from {source} where geohash4 is not null),
codes as (select g, list_transform(string_split(g, ''), lambda x: instr('0123456789bcdefghjkmnpqrstuvwxyz', x) - 1) as v from cells),
bits as (select g, [(v[1] >> 4) & 1, (v[1] >> 3) & 1, (v[1] >> 2) & 1, (v[1] >> 1) & 1, v[1] & 1,
  (v[2] >> 4) & 1, (v[2] >> 3) & 1, (v[2] >> 2) & 1, (v[2] >> 1) & 1, v[2] & 1,
  (v[3] >> 4) & 1, (v[3] >> 3) & 1, (v[3] >> 2) & 1, (v[3] >> 1) & 1, v[3] & 1,
  (v[4] >> 4) & 1, (v[4] >> 3) & 1, (v[4] >> 2) & 1, (v[4] >> 1) & 1, v[4] & 1] as b from codes),
axes as (select g, list_sum(list_transform([1, 3, 5, 7, 9, 11, 13, 15, 17, 19], lambda p, i: b[p] << (10 - i))) as x,
  list_sum(list_transform([2, 4, 6, 8, 10, 12, 14, 16, 18, 20], lambda p, i: b[p] << (10 - i))) as y from bits),
moves as (select * from (values (-1), (0), (1)) a(dx), (values (-1), (0), (1)) b(dy)),
shifted as (select g, cast((x + dx + 1024) % 1024 as bigint) as x, cast(least(greatest(y + dy, 0), 1023) as bigint) as y from axes, moves),
ring as (select distinct g as geohash4, list_reduce(list_transform([1, 2, 3, 4], lambda k, i:
  substr('0123456789bcdefghjkmnpqrstuvwxyz', cast(case when k % 2 = 1 then
    ((x >> (case k when 1 then 9 else 4 end)) & 1) * 16 + ((y >> (case k when 1 then 9 else 4 end)) & 1) * 8
    + ((x >> (case k when 1 then 8 else 3 end)) & 1) * 4 + ((y >> (case k when 1 then 8 else 3 end)) & 1) * 2
    + ((x >> (case k when 1 then 7 else 2 end)) & 1)
  else ((y >> (case k when 2 then 7 else 2 end)) & 1) * 16 + ((x >> (case k when 2 then 6 else 1 end)) & 1) * 8
    + ((y >> (case k when 2 then 6 else 1 end)) & 1) * 4 + ((x >> (case k when 2 then 5 else 0 end)) & 1) * 2
    + ((y >> (case k when 2 then 5 else 0 end)) & 1) end as int) + 1, 1)), lambda p, q: p || q) as cell from shifted)
"""


@query(
    CTES + _RING_SQL.format(source="safe")
    + "select r.cell, count(*) as n, count(distinct s.feed_id) as feeds from safe s join ring r on r.geohash4 = s.geohash4 group by r.cell"
)
def slice_cells(spark: SparkSession, sf: str) -> DataFrame:
    near = slices.with_cells(_safe(spark, sf, "geohash4").select("feed_id", "geohash4"))
    per_feed = near.groupBy("cell", "feed_id").agg(F.count("*").alias("n"))
    return per_feed.groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("feeds"))


@query(
    CTES + _RING_SQL.format(source="public") + "select distinct cell from ring"
)
def touched_slices(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, "feed_id", "lat", "lng", "geohash4")
    fresh = serving.fresh_feeds(feeds(spark, sf), NOW).select(c("id").alias("feed_id"))
    return slices.touched_slices(rollup.touched_cells(rows, fresh))


def _index(spark: SparkSession, sf: str) -> DataFrame:
    columns = (
        "feed_id", "neighborhood", "city", "state", "country", "attendance", "day", "time", "lat", "lng",
        "geohash4", "formatted_address",
    )
    return rollup.city_index(listings(spark, sf, *columns), feeds(spark, sf), NOW)


def _members(spark: SparkSession, sf: str) -> DataFrame:
    need = (
        "slug", "name", "state", "country", "geohash4", "fellowship", "location_name", "address", "notes",
        "location_notes", "conference_url", "types", "entity_id", "updated_at", "price",
    )
    rows = _safe(spark, sf, *need)
    cities = staged(_index(spark, sf), "cities")
    members = slices.with_cells(rows).unionByName(slices.online_members(rows, cities).select(*rows.columns, "cell"))
    return members


# --- cities --------------------------------------------------------------------------------


def real(name: str):
    return c(name).cast("double").alias(name)


# The city index in SQL: rows per place and prefix, the dominant prefix, averages and modal cells.
_SLUG = "trim(regexp_replace(lower({0}), '[^[:alnum:]]+', '-', 'g'), '-')"


def _places_sql(name: str, keys: str, slug: str, label: str, parent: str, where: str) -> str:
    join = " and ".join(f"d.{k} is not distinct from e.{k}" for k in keys.split(", "))
    own = ", ".join(f"e.{k}" for k in keys.split(", "))
    tail = (
        f"'-' || coalesce(nullif({_SLUG.format('state')}, ''), 'xx') || '-' || coalesce(nullif({_SLUG.format('country')}, ''), 'xx') "
        "|| case when country is null then '-' || coalesce(scope, 'geo') else '' end"
    )
    return f"""{name}_rows as (select * from eligible where cluster is not null{where}),
{name}_best as (select * from (select {keys}, cluster, count(*) as n, row_number() over (partition by {keys}
  order by count(*) desc, cluster) as rn from {name}_rows group by {keys}, cluster) where rn = 1),
{name}_in as (select e.* from {name}_rows e join {name}_best d on {join} and d.cluster = e.cluster),
{name}_mode as (select {keys}, max(case when r1 = 1 and nh > 0 then geohash4 end) as here, max(case when r2 = 1 then geohash4 end) as every
  from (select *, row_number() over (partition by {keys} order by nh desc, geohash4) as r1, row_number() over (partition by {keys}
  order by n desc, geohash4) as r2 from (select {keys}, geohash4, count(*) as n, count(*) filter (where attendance = 'in-person') as nh
  from {name}_in group by {keys}, geohash4)) group by {keys}),
{name}_avg as (select {keys}, count(*) as meeting_count,
  cast(coalesce(avg(lat) filter (where attendance = 'in-person'), avg(lat)) as real) as lat,
  cast(coalesce(avg(lng) filter (where attendance = 'in-person'), avg(lng)) as real) as lng from {name}_in group by {keys}),
{name} as (select {slug} || {tail} as slug, {label} as label, state, country, cast(lat as double) as lat,
  cast(lng as double) as lng, coalesce(here, every) as geohash4, meeting_count, {parent} as parent_label
  from (select {own}, e.meeting_count, e.lat, e.lng, d.here, d.every from {name}_avg e join {name}_mode d on {join}))"""


ELIGIBLE_SQL = (
    CTES
    + """, eligible as (select *, substr(geohash4, 1, 3) as cluster,
  case when country is null then substr(geohash4, 1, 3) else '' end as scope from public
  where city is not null and lower(city) not in ('online', 'virtual', 'regional') and day is not null and time is not null
  and (attendance = 'online' or (formatted_address is not null and lat is not null and lng is not null)))
"""
)
CITY_SQL = _places_sql(
    "city_places", "city, state, country, scope", _SLUG.format("city"), "city", "cast(null as varchar)", ""
)
HOOD_SQL = _places_sql(
    "hood_places", "neighborhood, city, state, country, scope",
    f"{_SLUG.format('neighborhood')} || '-' || {_SLUG.format('city')}", "neighborhood", "city",
    " and trim(neighborhood) <> '' and lower(neighborhood) <> lower(city)",
)
INDEX_SQL = (
    ELIGIBLE_SQL
    + f""", {CITY_SQL}, {HOOD_SQL},
aggregated as (select * from city_places union all select * from hood_places),
spots as (select * from (select *, row_number() over (partition by label, coalesce(state, ''), coalesce(country, ''), geohash4
  order by case when parent_label is null then 0 else 1 end, meeting_count desc, slug) as r from aggregated) where r = 1),
cities as (select slug, label, state, country, lat, lng, geohash4, meeting_count, parent_label from (select *, row_number() over
  (partition by slug order by meeting_count desc, label, geohash4, parent_label nulls first) as rk from spots) where rk = 1)
"""
)


@query(INDEX_SQL + "select slug, label, meeting_count from cities order by meeting_count desc, slug limit 200")
def top_cities(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.top_cities(_index(spark, sf)).select("slug", "label", "meeting_count")


@query(
    INDEX_SQL
    + """, matched as (select *, case when lower(label) = 'city 1' then 0 when lower(label) like 'city 1%' then 1
  when lower(coalesce(parent_label, '')) = 'city 1' then 2 else 3 end as tier from cities
  where contains(lower(label), 'city 1') or contains(slug, 'city 1') or contains(lower(coalesce(parent_label, '')), 'city 1'))
select slug, label, parent_label, meeting_count from matched order by tier, meeting_count desc, slug limit 20"""
)
def city_matches(spark: SparkSession, sf: str) -> DataFrame:
    return city_ops.match_cities(_index(spark, sf), "City 1").select("slug", "label", "parent_label", "meeting_count")


_MATCH_SQL = INDEX_SQL + """, matched as (select *, row_number() over (order by case when lower(label) = 'city 1' then 0
  when lower(label) like 'city 1%' then 1 when lower(coalesce(parent_label, '')) = 'city 1' then 2 else 3 end, meeting_count desc, slug) as o
  from cities where contains(lower(label), 'city 1') or contains(slug, 'city 1') or contains(lower(coalesce(parent_label, '')), 'city 1')),
"""


@query(
    _MATCH_SQL.replace("with feeds as", "with recursive feeds as", 1)
    + f"""top as (select * from matched where o <= 20),
pairs as (select b.o as o, a.o as earlier from top a join top b on a.o < b.o and a.country is not distinct from b.country
  and ((lower(a.label) = lower(b.label) and coalesce(a.parent_label, '') = coalesce(b.parent_label, ''))
    or (lower(a.label) = lower(coalesce(b.state, '')) and lower(b.label) = lower(coalesce(a.state, ''))))
  and {haversine_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} < 40),
walk as (select cast(0 as bigint) as step, cast([] as bigint[]) as kept union all
  select step + 1, case when exists (select 1 from pairs p where p.o = step + 1 and list_contains(kept, p.earlier)) then kept
    else list_append(kept, step + 1) end from walk where step < (select max(o) from top))
select t.slug, t.label, t.parent_label, t.meeting_count from top t
where list_contains((select kept from walk order by step desc limit 1), t.o)"""
)
def city_search(spark: SparkSession, sf: str) -> DataFrame:
    return city_ops.search_cities(_index(spark, sf), "City 1").select("slug", "label", "parent_label", "meeting_count")


# --- slice members -------------------------------------------------------------------------

_AREA_SQL = (
    INDEX_SQL
    + _RING_SQL.format(source="(select geohash4 from safe union select geohash4 from cities)")
    + """, near_cities as (select r.cell, c.* from cities c join ring r on r.geohash4 = c.geohash4),
area_labels as (select distinct cell, label from near_cities union select distinct cell, parent_label from near_cities where parent_label is not null),
area_countries as (select distinct cell, case when length(country) = 2 then upper(country) else country end as country from near_cities where country is not null),
area_states as (select distinct cell, state from near_cities where state is not null),
members as (select r.cell, s.feed_id, s.slug, s.price, s.updated_at from safe s join ring r on r.geohash4 = s.geohash4
  union all
  select l.cell, s.feed_id, s.slug, s.price, s.updated_at from safe s join area_labels l on l.label = s.city
  where s.attendance = 'online'
  and not exists (select 1 from ring r where r.geohash4 = s.geohash4 and r.cell = l.cell)
  and exists (select 1 from area_countries a where a.cell = l.cell and a.country = s.country)
  and (s.state is null or not exists (select 1 from area_states a where a.cell = l.cell)
    or exists (select 1 from area_states a where a.cell = l.cell and a.state = s.state)))
"""
)


@query(_AREA_SQL + "select cell, feed_id, slug, price from members")
def slice_members(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf).select("cell", "feed_id", "slug", "price")


@query(_AREA_SQL + "select distinct m.cell, m.feed_id, f.feed_name from members m join fresh f on f.feed_id = m.feed_id")
def slice_sources(spark: SparkSession, sf: str) -> DataFrame:
    return slices.slice_sources(_members(spark, sf))


@query(
    _AREA_SQL
    + f"""select distinct cell, 'label' as kind, {slug_sql('label')} as value from area_labels
union all select cell, 'country', country from area_countries union all select cell, 'state', state from area_states"""
)
def area_sets(spark: SparkSession, sf: str) -> DataFrame:
    return slices.area_sets(staged(_index(spark, sf), "cities"))


_SLICE_SQL = (
    f""", keyed as (select m.cell, s.*, {_KEY_SQL.replace(chr(10), ' ')} as k, {_FULL_SQL} as filled from members m
  join safe s on s.feed_id = m.feed_id and s.slug = m.slug and s.price = m.price and s.updated_at = m.updated_at),
kept as (select * from (select *, row_number() over (partition by cell, k order by filled desc, source_verified_at desc nulls last,
  slug, feed_id) as rn from keyed) where rn = 1)
select c.cell, c.feed_id, c.slug, coalesce(e.name, c.feed_name) as entity_name from kept c left join entities e on e.id = c.entity_id"""
)


@query(_AREA_SQL + _SLICE_SQL)
def slice_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every member of every slice, as `slices.slices` makes them."""
    cities = staged(_index(spark, sf), "cities")
    rows = slices.slices(listings(spark, sf), feeds(spark, sf), entities(spark, sf), cities, NOW)
    return rows.select("cell", "feed_id", "slug", "entity_name")


@query(
    _AREA_SQL
    + _SLICE_SQL.replace("select c.cell", "select count(*) over () > 1500 as truncated, c.cell")
    + " where c.cell = (select geohash4 from safe where geohash4 is not null group by geohash4 order by count(*) desc, geohash4 limit 1) "
    "order by c.feed_id, c.slug limit 1500"
)
def slice_read(spark: SparkSession, sf: str) -> DataFrame:
    """The slice of the fullest cell as a reader gets it: cut when read, with a flag where more was found."""
    cell = _safe(spark, sf, "geohash4").where(c("geohash4").isNotNull()).groupBy(c("geohash4").alias("cell")).count()
    cell = cell.orderBy(c("count").desc(), "cell").limit(1).select("cell")
    cities = staged(_index(spark, sf), "cities")
    rows = slices.slices(listings(spark, sf), feeds(spark, sf), entities(spark, sf), cities, NOW, cells=cell, cap=SLICE_CAP)
    return rows.select("truncated", "cell", "feed_id", "slug", "entity_name")


# --- note vectors --------------------------------------------------------------------------

# Notes: documents keyed by source; vectors: embeddings of some of them, one in seven stale.
_NOTES_SQL = """with notes as (select source as feed_id, concat('d-', doc_id) as slug, lang as name,
  case when doc_id % 5 = 0 then ' ' else text end as notes, case when doc_id % 4 = 0 then concat('in ', lang) end as location_notes
  from documents),
hashed as (select *, nullif(concat_ws(chr(10) || chr(10), nullif(trim(notes, E' \\n\\t\\r'), ''), nullif(trim(location_notes), '')), '') as content from notes),
vectors as (select coalesce(source, 'src-none') as feed_id, concat('d-', vec_id) as slug, case when vec_id % 7 = 0 then 'old' else sha256(h.content) end as content_hash,
  embedding from embeddings left join documents on doc_id = vec_id left join hashed h on h.slug = concat('d-', vec_id))
"""


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "source as feed_id", "concat('d-', doc_id) as slug", "lang as name",
        "case when doc_id % 5 = 0 then ' ' else text end as notes",
        "case when doc_id % 4 = 0 then concat('in ', lang) end as location_notes",
    )


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    hashed = _notes(spark, sf).select(
        "slug", c("feed_id").alias("_feed"), notes.content_hash(notes.combined_notes(c("notes"), c("location_notes"))).alias("_hash")
    )
    rows = table(spark, sf, "embeddings").select(
        F.concat(F.lit("d-"), "vec_id").alias("slug"), (c("vec_id") % 7 == 0).alias("_old"), "embedding"
    )
    return rows.join(hashed, "slug", "left").select(
        F.coalesce("_feed", F.lit("src-none")).alias("feed_id"), "slug",
        F.when(c("_old"), "old").otherwise(c("_hash")).alias("content_hash"), "embedding",
    )


@query(
    _NOTES_SQL
    + """select coalesce(h.feed_id, v.feed_id) as feed_id, coalesce(h.slug, v.slug) as slug,
  case when h.content is null then 'delete' else 'embed' end as action, case when h.content is not null then sha256(h.content) end as content_hash
from (select * from hashed where content is not null) h full join vectors v on v.feed_id = h.feed_id and v.slug = h.slug
where h.content is null or v.slug is null or v.content_hash is null or v.content_hash <> sha256(h.content)"""
)
def vector_plan(spark: SparkSession, sf: str) -> DataFrame:
    return notes.vector_plan(_notes(spark, sf), _vectors(spark, sf)).select("feed_id", "slug", "action", "content_hash")


@query(
    _NOTES_SQL
    + "select h.feed_id, h.slug from hashed h where h.content is not null and not exists (select 1 from vectors v "
    "where v.feed_id = h.feed_id and v.slug = h.slug)"
)
def missing_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return notes.missing_vectors(_notes(spark, sf), _vectors(spark, sf), None).select("feed_id", "slug")


@query(
    _NOTES_SQL
    + "select v.feed_id, v.slug from vectors v where not exists (select 1 from hashed h where h.content is not null "
    "and h.feed_id = v.feed_id and h.slug = v.slug)"
)
def orphan_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return notes.orphan_vectors(_vectors(spark, sf), _notes(spark, sf)).select("feed_id", "slug")


_DIMENSIONS = 64
_TARGET = [((i * 7) % 11 - 5) / 10 for i in range(_DIMENSIONS)]
_TARGET_SQL = "cast([" + ", ".join(str(v) for v in _TARGET) + "] as double[])"


@query(
    _NOTES_SQL
    + f"""select v.feed_id, v.slug, n.name, round(list_cosine_similarity(cast(v.embedding as double[]), {_TARGET_SQL}), 6) as score
from vectors v join notes n on n.feed_id = v.feed_id and n.slug = v.slug
where list_cosine_similarity(cast(v.embedding as double[]), {_TARGET_SQL}) >= 0.1 order by score desc, v.feed_id, v.slug limit 12"""
)
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = notes.note_hits(_vectors(spark, sf), _notes(spark, sf), _TARGET, k=12, min_similarity=0.1)
    return hits.select("feed_id", "slug", "name", F.round("score", 6).alias("score"))


@query(
    f"select vec_id, round(list_cosine_similarity(cast(embedding as double[]), {_TARGET_SQL}), 6) as score from embeddings"
)
def cosine_scores(spark: SparkSession, sf: str) -> DataFrame:
    target = F.array(*[F.lit(v) for v in _TARGET])
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(cosine_similarity(c("embedding"), target), 6).alias("score")
    )


@query(
    CTES
    + f"""select feed_id, slug, case when d < 1 then cast(floor(d * 1000 + 0.5) as bigint) || ' m' when d < 10 then printf('%.1f km', d)
  else cast(floor(d + 0.5) as bigint) || ' km' end as distance from (select feed_id, slug, {haversine_sql('0.5', '0.3', 'lat', 'lng')} as d
  from listings where lat is not null)"""
)
def distance_captions(spark: SparkSession, sf: str) -> DataFrame:
    rows = rank.with_distance(listings(spark, sf, "feed_id", "slug", "lat", "lng"), ORIGIN)
    return rows.where(c("lat").isNotNull()).select("feed_id", "slug", format_distance(c("distance_km")).alias("distance"))
