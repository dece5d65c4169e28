"""Registered queries: roll-ups, audit and feed bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrid.functions.text import alnum_slug, slugify
from weekgrid.operators import audit, dedupe, predicates, rollup, sinks
from weekgrid.operators import feeds as feed_ops
from weekgrid.plans.registry import query
from weekgrid.plans.serving import ELIGIBLE_SQL, INDEX_SQL, real
from weekgrid.plans.views import CTES, NOW, NOW_SQL, entities, feeds, listings, slug_sql, table
from weekgrid.schemas import TOP_ANOMALIES
from weekgrid.streaming.incremental import next_places

c = F.col

PLACE_NEEDS = (
    "feed_id", "neighborhood", "city", "state", "country", "attendance", "day", "time", "lat", "lng", "geohash4",
    "formatted_address",
)


def _eligible(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.eligible(listings(spark, sf, *PLACE_NEEDS), feeds(spark, sf), NOW)


@query(
    ELIGIBLE_SQL
    + "select city, state, country, attendance, scope, cluster, count(*) as n from eligible "
    "group by city, state, country, attendance, scope, cluster"
)
def eligible_listings(spark: SparkSession, sf: str) -> DataFrame:
    return _eligible(spark, sf).groupBy("city", "state", "country", "attendance", "scope", "cluster").agg(
        F.count("*").alias("n")
    )


@query(
    ELIGIBLE_SQL
    + """select city, state, country, scope, cluster, n from (select *, row_number() over (partition by city, state, country, scope
  order by n desc, cluster) as rn from (select city, state, country, scope, cluster, count(*) as n from eligible
  where cluster is not null group by all)) where rn = 1"""
)
def dominant_cluster(spark: SparkSession, sf: str) -> DataFrame:
    rows = _eligible(spark, sf).where(c("cluster").isNotNull())
    stats = rollup.cluster_stats(rollup.cell_counts(rows, rollup.CITY), rollup.CITY)
    best = rollup.dominant(stats, rollup.CITY)
    return best.select(*rollup.CITY, "cluster", c("meeting_count").alias("n"))


_PLACE = "slug, label, state, country, lat, lng, geohash4, meeting_count, parent_label"


def _place_columns(places: DataFrame) -> DataFrame:
    return places.select(
        "slug", "label", "state", "country", real("lat"), real("lng"), "geohash4", "meeting_count", "parent_label"
    )


@query(INDEX_SQL + f"select {_PLACE} from city_places")
def city_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _place_columns(rollup.city_places(_eligible(spark, sf)))


@query(INDEX_SQL + f"select {_PLACE} from hood_places")
def neighborhood_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _place_columns(rollup.neighborhood_places(_eligible(spark, sf)))


@query(INDEX_SQL + f"select {_PLACE} from cities")
def place_unique_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _place_columns(rollup.city_index(listings(spark, sf, *PLACE_NEEDS), feeds(spark, sf), NOW))


@query(INDEX_SQL + f"select {_PLACE} from cities")
def incremental_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Index after an update: places rolled up without the na listings, then refreshed where those lie."""
    rows = listings(spark, sf, *PLACE_NEEDS, "fellowship")
    before = rows.where(~c("fellowship").eqNullSafe("na"))
    cells = rows.where((c("fellowship") == "na") & c("geohash4").isNotNull()).select("geohash4").distinct()
    source = feeds(spark, sf)
    previous = next_places(None, before, source, None, NOW, "full")
    return _place_columns(rollup.unique_places(next_places(previous, rows, source, cells, NOW, "incremental")))


@query(
    CTES
    + """, cells as (select city, country, geohash4, count(*) as n, count(*) filter (where attendance = 'in-person') as nh
  from listings where geohash4 is not null group by all),
modes as (select city, country, max(case when r1 = 1 and nh > 0 then geohash4 end) as here, max(case when r2 = 1 then geohash4 end) as every
  from (select *, row_number() over (partition by city, country order by nh desc, geohash4) as r1,
    row_number() over (partition by city, country order by n desc, geohash4) as r2 from cells) group by all)
select regexp_replace(lower(l.city), '[^a-zA-Z0-9]+', '-', 'g') || '-' || coalesce(lower(l.country), 'xx') as slug, l.city as label,
  l.country, cast(cast(coalesce(avg(lat) filter (where attendance = 'in-person'), avg(lat)) as real) as double) as lat,
  cast(cast(coalesce(avg(lng) filter (where attendance = 'in-person'), avg(lng)) as real) as double) as lng,
  max(coalesce(m.here, m.every)) as geohash4, count(*) as meeting_count
from listings l left join modes m on m.city = l.city and m.country is not distinct from l.country
where l.city is not null group by l.city, l.country having avg(lat) is not null"""
)
def simple_city_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = rollup.simple_city_rollup(listings(spark, sf, "city", "country", "attendance", "lat", "lng", "geohash4"))
    return rows.select("slug", "label", "country", real("lat"), real("lng"), "geohash4", "meeting_count")


# --- audit ---------------------------------------------------------------------------------

# Runs: one per event type and user, from the event log.
_RUNS_SQL = """, runs as (select row_number() over (order by event_type, user_id) as id, min(ts) as started_at,
  case when user_id % 4 = 0 then null else max(ts) end as finished_at, cast(count(*) as int) as feeds_ok,
  cast(user_id % 3 as int) as feeds_fail, case when event_type = 'error' then 'running' when event_type = 'signup' then 'incomplete'
  else 'completed' end as status from events group by event_type, user_id)
"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy("event_type", "user_id")
        .agg(F.min("ts").alias("started_at"), F.max("ts").alias("_last"), F.count("*").cast("int").alias("feeds_ok"))
        .select(
            "event_type", "user_id", "started_at",
            F.when(c("user_id") % 4 != 0, c("_last")).alias("finished_at"),
            "feeds_ok", (c("user_id") % 3).cast("int").alias("feeds_fail"),
            F.when(c("event_type") == "error", "running").when(c("event_type") == "signup", "incomplete")
            .otherwise("completed").alias("status"),
        )
    )


_AUDIT_SQL = (
    CTES
    + _RUNS_SQL
    + f""", counted as (select count(*) as public_listings,
  count(*) filter (where day is null or time is null) as invalid_schedule,
  count(*) filter (where attendance <> 'online' and nullif(trim(formatted_address), '') is null) as missing_address,
  count(*) filter (where attendance <> 'online' and (lat is null or lng is null or lat not between -90 and 90 or lng not between -180 and 180)) as invalid_coordinates,
  count(*) filter (where attendance <> 'online' and nullif(trim(city), '') is null) as missing_city,
  count(*) filter (where attendance <> 'online' and (lower(trim(city)) in ('online', 'virtual', 'regional')
    or regexp_matches(trim(city), '^[A-Z]{{2,3}}$') or regexp_matches(trim(city), '^[A-Z]{{2}}\\s+\\d')
    or regexp_matches(trim(city), '^\\d{{5}}') or length(trim(city)) > 80)) as malformed_city_labels,
  count(*) filter (where (regexp_matches(coalesce(notes, ''), '(?i)beginners? welcome') or regexp_matches(coalesce(location_notes, ''), '(?i)beginners? welcome'))
    and not (list_contains(types, 'BE') or list_contains(types, 'B'))) as notes_missing_beginner_type,
  count(*) filter (where (regexp_matches(coalesce(notes, ''), '(?i)wheelchair accessible') or regexp_matches(coalesce(location_notes, ''), '(?i)wheelchair accessible'))
    and not list_contains(types, 'X')) as notes_missing_wheelchair_type from public),
stale as (select count(*) as stale_feeds, cast(coalesce(sum(meeting_count), 0) as bigint) as suppressed_listings from feeds
  where status <> 'ok' or last_ok_at is null or last_ok_at < {NOW_SQL} - interval '48' hour),
repeated as (select count(*) as duplicate_ids from (select 1 from listings group by feed_id, slug having count(*) > 1)),
open_runs as (select count(*) as incomplete_runs from runs where status in ('running', 'incomplete'))
"""
)
_AUDIT_NEEDS = (
    "feed_id", "slug", "day", "time", "attendance", "formatted_address", "lat", "lng", "city", "notes",
    "location_notes", "types",
)


@query(_AUDIT_SQL + "select * from counted, repeated, stale, open_runs")
def audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_counts(listings(spark, sf, *_AUDIT_NEEDS), feeds(spark, sf), _runs(spark, sf), NOW)


_ANOMALY_SQL = """, spans as (select city, state, country, case when country is null then substr(geohash4, 1, 3) else '' end as scope,
  substr(geohash4, 1, 3) as cluster, count(*) as listings, max(lat) - min(lat) as latitude_span, max(lng) - min(lng) as longitude_span
  from public where attendance <> 'online' and city is not null and lat is not null and lng is not null group by 1, 2, 3, 4, 5),
anomalies as (select * from (select *, row_number() over (partition by city, state, country, scope order by listings desc, cluster) as rn
  from spans) where rn = 1 and (latitude_span > {0} or longitude_span > {0}) order by listings desc, city, state nulls first, country nulls first, scope limit 100)
"""


@query(
    CTES + _ANOMALY_SQL.format(0.9)
    + "select city, state, country, listings, round(latitude_span, 6) as latitude_span, round(longitude_span, 6) as longitude_span from anomalies"
)
def mapping_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """At 0.9 degrees, so that cities within one prefix of the views show up."""
    columns = ("feed_id", "city", "state", "country", "attendance", "lat", "lng", "geohash4")
    rows = audit.mapping_anomalies(listings(spark, sf, *columns), feeds(spark, sf), NOW, TOP_ANOMALIES, span=0.9)
    spans = [F.round(n, 6).alias(n) for n in ("latitude_span", "longitude_span")]
    return rows.select("city", "state", "country", "listings", *spans)


@query(
    _AUDIT_SQL + _ANOMALY_SQL.format(1.5)
    + """, found as (select count(*) as mapping_anomalies from anomalies)
select public_listings, duplicate_ids, mapping_anomalies, invalid_schedule = 0 and missing_address = 0 and invalid_coordinates = 0
  and missing_city = 0 and malformed_city_labels = 0 and duplicate_ids = 0 and mapping_anomalies = 0 as safe
from counted, repeated, found"""
)
def audit_verdict(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, *dict.fromkeys((*_AUDIT_NEEDS, *PLACE_NEEDS)))
    source = feeds(spark, sf)
    counts = audit.audit_counts(rows, source, _runs(spark, sf), NOW)
    report = audit.verdict(counts, audit.mapping_anomalies(rows, source, NOW))
    return report.select("public_listings", "duplicate_ids", "mapping_anomalies", "safe")


@query(
    CTES
    + f"select count(*) as feeds_behind from feeds where status <> 'disabled' and (last_ok_at is null or last_ok_at < {NOW_SQL} - interval '48' hour)"
)
def feeds_behind(spark: SparkSession, sf: str) -> DataFrame:
    return audit.feeds_behind(feeds(spark, sf), NOW)


# --- feeds ---------------------------------------------------------------------------------


@query(
    CTES
    + f"""select id, last_attempt_at, last_ok_at from feeds where status <> 'disabled' and (leased_until is null or leased_until < {NOW_SQL})
order by last_attempt_at nulls first, last_ok_at nulls first, id limit 20"""
)
def stale_first(spark: SparkSession, sf: str) -> DataFrame:
    page = feed_ops.stale_first(feed_ops.claimable(feeds(spark, sf), NOW))
    return page.select("id", "last_attempt_at", "last_ok_at")


# The catalog: every second supplier under its own or a moved id, every third as a federated root.
_CATALOG_SQL = """, general as (select case when s_suppkey % 10 = 0 then concat('moved-', s_suppkey) else concat('feed-', s_suppkey) end as id,
  upper(s_name) as name, concat('http://feeds', s_suppkey % 50, '.example.org:80/list/', s_suppkey) as url, 'GB' as region_hint,
  case s_suppkey % 3 when 0 then 'na' else 'zz' end as fellowship, case s_suppkey % 5 when 0 then 'oiaa' else 'nope' end as format,
  case when s_suppkey % 7 = 0 then 'disabled' end as status, s_suppkey % 9 = 0 as refresh, s_suppkey as pos from supplier),
federated as (select concat('root-', s_suppkey) as id, s_name as name, concat('https://www.Root', s_suppkey % 40, '.example.org/main_server',
  case when s_suppkey % 2 = 0 then '/' else '' end) as url, 'US' as region_hint, s_suppkey as pos from supplier),
every as (select id, name, replace(replace(replace(url, 'http://www.', 'http://'), ':80/', '/'), 'x', 'x') as url, region_hint,
  case when fellowship = 'na' then 'na' else 'aa' end as fellowship, case when format = 'oiaa' then 'oiaa' else 'tsml' end as format,
  status, refresh, 0 as src, pos from general
  union all select id, name, lower(replace(rtrim(url, '/'), 'www.', '')) || '/client_interface/json/?switcher=GetSearchResults', region_hint, 'na', 'bmlt', null, false, 1, pos from federated),
catalog as (select id, name, url, region_hint, fellowship, format, case when status = 'disabled' then 'disabled' else 'pending' end as status, refresh
  from (select *, row_number() over (partition by url order by src, pos, id) as rn from every) where rn = 1)
"""


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier")
    general = rows.selectExpr(
        "case when s_suppkey % 10 = 0 then concat('moved-', s_suppkey) else concat('feed-', s_suppkey) end as id",
        "upper(s_name) as name", "concat('http://feeds', s_suppkey % 50, '.example.org:80/list/', s_suppkey) as url",
        "'GB' as regionHint", "case s_suppkey % 3 when 0 then 'na' else 'zz' end as fellowship",
        "case s_suppkey % 5 when 0 then 'oiaa' else 'nope' end as format",
        "case when s_suppkey % 7 = 0 then 'disabled' end as status", "s_suppkey % 9 = 0 as refresh", "s_suppkey as pos",
    )
    federated = rows.selectExpr(
        "concat('root-', s_suppkey) as id", "s_name as name",
        "concat('https://www.Root', s_suppkey % 40, '.example.org/main_server', case when s_suppkey % 2 = 0 then '/' else '' end) as url",
        "'US' as regionHint", "s_suppkey as pos",
    )
    return feed_ops.merge_catalog(general, federated)


@query(CTES + _CATALOG_SQL + "select * from catalog")
def catalog_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).select(
        "id", "name", "url", "region_hint", "fellowship", "format", "status", "refresh"
    )


_STORED = "replace(rtrim(f.url, '/'), 'www.', '')"


@query(
    CTES + _CATALOG_SQL
    + f"select distinct f.id from feeds f join catalog k on k.url = replace({_STORED}, 'https:', 'http:') where k.id <> f.id"
)
def catalog_replace(spark: SparkSession, sf: str) -> DataFrame:
    stored = feeds(spark, sf).withColumn("url", F.replace("url", F.lit("https:"), F.lit("http:")))
    return feed_ops.replaced_feeds(_catalog(spark, sf), stored)


@query(
    CTES + _CATALOG_SQL
    + """select coalesce(k.id, f.id) as id, coalesce(k.name, f.name) as name, coalesce(k.url, f.url) as url,
  case when k.id is null then f.status when k.status = 'disabled' then 'disabled' when f.id is null or f.status = 'disabled' then 'pending' else f.status end as status,
  case when k.id is null then f.last_error when k.status = 'disabled' then 'No public JSON feed' when f.status = 'disabled' then null else f.last_error end as last_error,
  case when k.refresh then null else f.etag end as etag, coalesce(f.meeting_count, 0) as meeting_count
from feeds f full join catalog k on k.id = f.id"""
)
def catalog_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = feed_ops.upsert_catalog(feeds(spark, sf), _catalog(spark, sf))
    return rows.select("id", "name", "url", "status", "last_error", "etag", "meeting_count")


@query(
    "select source, count(*) as n, sum(case when sha256(text || chr(0) || lang) <> '' then 1 else 0 end)::bigint as hashed, "
    "min(sha256(text || chr(0) || lang)) as first_hash from documents group by source"
)
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("source", feed_ops.catalog_hash(c("text"), c("lang")).alias("h"))
    return rows.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(c("h") != "").alias("hashed"), F.min("h").alias("first_hash")
    )


@query(
    CTES
    + """, landed as (select id as feed_id, case when meeting_count % 3 = 0 then etag else 'new' end as etag, last_modified from feeds)
select l.feed_id, not coalesce(l.etag = f.etag or ((l.etag is null or f.etag is null) and l.last_modified = f.last_modified), false) as changed
from landed l left join feeds f on f.id = l.feed_id"""
)
def payload_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    stored = feeds(spark, sf)
    landed = stored.select(
        c("id").alias("feed_id"), F.when(c("meeting_count") % 3 == 0, c("etag")).otherwise("new").alias("etag"),
        "last_modified",
    )
    return feed_ops.split_unchanged(landed, stored).select("feed_id", "changed")


_RESULTS_SQL = """, results as (select feed_id, case when max(price) > 95000 then 'error' when min(price) < 950 then 'unchanged' else 'written' end as outcome,
  count(*) as n, case when max(price) > 95000 then repeat('x', 600) end as error, 'e2' as etag, cast(null as varchar) as last_modified
  from listings group by feed_id)
"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    top, low = F.max("price") > 95000, F.min("price") < 950
    return listings(spark, sf, "feed_id", "price").groupBy("feed_id").agg(
        F.when(top, "error").when(low, "unchanged").otherwise("written").alias("outcome"),
        F.count("*").alias("n"), F.when(top, F.repeat(F.lit("x"), 600)).alias("error"), F.lit("e2").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
    )


@query(
    CTES + _RESULTS_SQL
    + f"""select f.id, case when outcome in ('written', 'unchanged') then 'ok' when outcome = 'error' then 'error' else f.status end as status,
  case when outcome is not null then {NOW_SQL} else f.last_attempt_at end as last_attempt_at,
  case when outcome in ('written', 'unchanged') then {NOW_SQL} else f.last_ok_at end as last_ok_at,
  case when outcome in ('written', 'unchanged') then null when outcome = 'error' then substr(error, 1, 500) else f.last_error end as last_error,
  cast(case when outcome = 'written' then n else f.meeting_count end as int) as meeting_count,
  case when outcome = 'written' then r.etag else f.etag end as etag
from feeds f left join results r on r.feed_id = f.id"""
)
def feed_state(spark: SparkSession, sf: str) -> DataFrame:
    rows = feed_ops.apply_results(feeds(spark, sf), _results(spark, sf), NOW)
    return rows.select("id", "status", "last_attempt_at", "last_ok_at", "last_error", "meeting_count", "etag")


@query(
    CTES + _RESULTS_SQL
    + """, notes as (select feed_id || ': ' || error as note from results where outcome = 'error' order by note limit 20)
select count(*) as feeds_processed, count(*) filter (where outcome <> 'error') as feeds_ok, count(*) filter (where outcome = 'error') as feeds_fail,
  count(*) filter (where outcome = 'unchanged') as feeds_not_modified, count(*) filter (where outcome = 'written') as feeds_written,
  cast(coalesce(sum(n) filter (where outcome = 'written'), 0) as bigint) as meetings_upserted,
  (select nullif(string_agg(note, chr(10) order by note), '') from notes) as error_summary from results"""
)
def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    return feed_ops.run_totals(_results(spark, sf))


@query(
    "with r as (select event_type, user_id, min(ts) as started_at, max(ts) as last_at from events group by all) select event_type, user_id, "
    "case when event_type = 'error' and started_at < timestamp '2024-01-02 00:00:00' - interval '10' minute then 'incomplete' "
    "when event_type = 'error' then 'running' when event_type = 'signup' then 'incomplete' else 'completed' end as status, "
    "case when event_type = 'error' and started_at < timestamp '2024-01-02 00:00:00' - interval '10' minute then timestamp '2024-01-02 00:00:00' "
    "when user_id % 4 <> 0 then last_at end as finished_at from r"
)
def stale_runs(spark: SparkSession, sf: str) -> DataFrame:
    from datetime import datetime

    runs = feed_ops.close_stale_runs(_runs(spark, sf), datetime(2024, 1, 2))
    return runs.select("event_type", "user_id", "status", "finished_at")


@query(
    "select event_type, user_id, case when user_id % 4 = 0 then 'incomplete' when user_id % 3 > 0 then 'completed_with_errors' "
    "else 'completed' end as status from events group by event_type, user_id"
)
def run_status_backfill(spark: SparkSession, sf: str) -> DataFrame:
    return feed_ops.backfill_run_status(_runs(spark, sf)).select("event_type", "user_id", "status")


@query(
    CTES
    + "select feed_id, slug, price from listings where feed_id not in (select id from feeds where status = 'disabled')"
)
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = feeds(spark, sf).where(c("status") == "disabled")
    return feed_ops.without_feeds(listings(spark, sf, "feed_id", "slug", "price"), gone)


@query(
    CTES
    + "select l.feed_id, l.slug, l.price, case when e.id is not null then l.entity_id end as entity_id from listings l "
    "left join (select id from entities where phone is not null) e on e.id = l.entity_id"
)
def unlink_entities(spark: SparkSession, sf: str) -> DataFrame:
    alive = entities(spark, sf).where(c("phone").isNotNull())
    return feed_ops.unlink_entities(listings(spark, sf, "feed_id", "slug", "price", "entity_id"), alive)


@query(
    CTES + "select l.feed_id, l.slug, l.price, f.last_ok_at as verified_at from listings l join feeds f on f.id = l.feed_id"
)
def backfill_verified(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, "feed_id", "slug", "price").withColumn("verified_at", F.lit(None).cast("timestamp"))
    return feed_ops.backfill_verified(rows, feeds(spark, sf))


@query(
    CTES
    + "select coalesce(n.id, e.id) as id, coalesce(n.name, e.name) as name, coalesce(n.email, e.email) as email from "
    "entities e full join (select id, 'New ' || name as name, 'x' as email from entities where location_text < 'City 3') n on n.id = e.id"
)
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf).select("id", "name", "email", "phone", "location_text")
    old = rows.select("id", "name", "email")
    new = rows.where(c("location_text") < "City 3").select(
        "id", F.concat(F.lit("New "), "name").alias("name"), F.lit("x").alias("email")
    )
    return sinks.upsert(old, new, ["id"])


@query(
    CTES
    + ", kept as (select feed_id, slug from listings where attendance <> 'online' and fellowship = 'aa') select distinct feed_id, slug from listings "
    "where feed_id in (select feed_id from kept) and (feed_id, slug) not in (select feed_id, slug from kept)"
)
def stale_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, "feed_id", "slug", "attendance", "fellowship")
    kept = rows.where((c("attendance") != "online") & (c("fellowship") == "aa"))
    return sinks.stale_keys(rows, kept).distinct()


@query(
    CTES
    + f"""select id, case when last_ok_at < {NOW_SQL} - interval '48' hour then 'expired' when last_ok_at < {NOW_SQL} - interval '12' hour then 'stale'
  else 'fresh' end as cache_class from feeds where last_ok_at is not null"""
)
def cache_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds(spark, sf).where(c("last_ok_at").isNotNull())
    return rows.select("id", predicates.cache_class(c("last_ok_at"), NOW).alias("cache_class"))


@query(
    CTES
    + f"""select l.feed_id, l.slug, l.price, case when f.last_attempt_at < {NOW_SQL} - interval '12' hour then 'stale' else 'fresh' end as cache_class
from listings l join feeds f on f.id = l.feed_id
where f.last_attempt_at >= {NOW_SQL} - interval '48' hour and f.last_ok_at >= {NOW_SQL} - interval '48' hour"""
)
def usable_slices(spark: SparkSession, sf: str) -> DataFrame:
    stamps = feeds(spark, sf).select(
        c("id").alias("feed_id"), c("last_attempt_at").alias("fetched_at"), c("last_ok_at").alias("source_verified_at")
    )
    stored = listings(spark, sf, "feed_id", "slug", "price").join(stamps, "feed_id")
    rows = predicates.usable_slices(stored.where(c("fetched_at").isNotNull()), NOW)
    return rows.select("feed_id", "slug", "price", "cache_class")


@query(
    CTES + f"select feed_id, slug, price, updated_at < {NOW_SQL} - interval '90' day as is_old from listings"
)
def old_listings(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, "feed_id", "slug", "price", "updated_at")
    return rows.select("feed_id", "slug", "price", predicates.is_old(c("updated_at"), NOW).alias("is_old"))


@query(
    CTES
    + f"""select feed_id || ':' || {slug_sql("name")} as id, min(price) as price from (select feed_id, price, entity_id as name from listings where entity_id is not null) group by 1"""
)
def first_entities(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    parsed = listings(spark, sf, "feed_id", "price", "entity_id").select(
        "feed_id", c("entity_id").alias("entity_name"), none.alias("entity_phone"), none.alias("entity_email"),
        none.alias("entity_url"), c("price").cast("string").alias("entity_location"),
        F.array().cast("array<string>").alias("feedback_emails"), c("price").alias("pos"),
    )
    rows = dedupe.first_entities(parsed)
    return rows.select("id", c("location_text").cast("double").alias("price"))


@query(
    f"select distinct lang, {slug_sql('source || lang')} as slug, trim(regexp_replace(lower(p_name), '[^[:alnum:]]+', '-', 'g'), '-') as part_slug "
    "from documents left join part on doc_id = p_partkey"
)
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    parts = table(spark, sf, "part").select(c("p_partkey").alias("doc_id"), "p_name")
    return docs.join(parts, "doc_id", "left").select(
        "lang", slugify(F.concat("source", "lang")).alias("slug"), alnum_slug(c("p_name")).alias("part_slug")
    ).distinct()


