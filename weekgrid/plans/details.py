"""Registered queries of small rules: region hints, place keys, several days, list payloads, captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrid.functions import clock, place
from weekgrid.operators import predicates, rollup
from weekgrid.plans.registry import query
from weekgrid.plans.serving import _safe
from weekgrid.plans.views import CTES, feeds, listings, slug_sql
from weekgrid.sources import dialects, envelope

c = F.col

_HINT = "case s_suppkey % 6 when 0 then 'us-ny' when 1 then ' GB ' when 2 then 'ONLINE' when 3 then 'EU' when 4 then 'NZ-' else null end"


@query(
    f"""with hints as (select s_suppkey, upper(trim({_HINT})) as h from supplier)
select concat('feed-', s_suppkey) as id, case when h in ('US-NY', 'GB', 'NZ-') then h[:2] end as country,
  case when h = 'US-NY' then 'NY' when h = 'NZ-' then '' end as state from hints"""
)
def region_hints(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds(spark, sf).withColumn("s_suppkey", F.split("id", "-")[1].cast("bigint"))
    return rows.select("id", place.region_hint(F.expr(_HINT)).alias("p")).select("id", "p.country", "p.state")


def _part(value: str, default: str) -> str:
    return f"coalesce(nullif({slug_sql(value)}, ''), '{default}')"


_KEY_SQL = (
    f"{_part('city', 'city')} || '-' || {_part('state', 'xx')} || '-' || {_part('country', 'xx')} || "
    "case when country is null then '-' || coalesce(geohash4[:3], 'geo') else '' end"
)


@query(
    CTES
    + f"""select distinct concat_ws('|', lower(coalesce(city, '')), lower(coalesce(neighborhood, '')), lower(coalesce(state, '')),
  lower(coalesce(postal_code, '')), lower(coalesce(country, '')), coalesce(printf('%.3f', lat), ''), coalesce(printf('%.3f', lng), '')) as fingerprint,
  {_KEY_SQL} as city_key, case when neighborhood is not null then {slug_sql('neighborhood')} || '-' || {_KEY_SQL} else {_KEY_SQL} end as area_key,
  concat_ws(', ', coalesce(neighborhood, city), case when neighborhood is not null and {slug_sql('neighborhood')} <> {slug_sql('city')} then city end,
  state, country) as caption from listings"""
)
def place_keys(spark: SparkSession, sf: str) -> DataFrame:
    columns = ("city", "neighborhood", "state", "postal_code", "country", "lat", "lng", "geohash4")
    rows = listings(spark, sf, *columns).select(*columns).distinct()
    key = (c("city"), c("state"), c("country"), c("geohash4"))
    label = F.coalesce("neighborhood", "city")
    return rows.select(
        place.place_fingerprint(*(c(n) for n in columns[:7])).alias("fingerprint"), place.city_key(*key).alias("city_key"),
        place.city_key(*key, c("neighborhood")).alias("area_key"),
        place.city_caption(label, F.when(c("neighborhood").isNotNull(), c("city")), c("state"), c("country")).alias("caption"),
    ).distinct()


_LONG = "repeat('long-', 13)"


@query(
    CTES
    + f""", items as (select feed_id, {_LONG} || slug as slug, [day, (day + 3) % 7, day] as days from listings where day is not null and conference_url is not null),
each as (select feed_id, slug, unnest(list_distinct(days)) as day from items)
select feed_id, substr(slug, 1, 43) || '-' || substr(sha256(slug), 1, 16) || '-' || day as slug, cast(day as int) as day from each"""
)
def listing_days(spark: SparkSession, sf: str) -> DataFrame:
    """Listings of several days, whose keys differ only beyond the length of a key."""
    day = c("day").cast("string")
    rows = listings(spark, sf, "feed_id", "slug", "name", "day", "conference_url").where(c("day").isNotNull() & c("conference_url").isNotNull())
    days = F.array(day, ((c("day") + 3) % 7).cast("string"), day, F.lit("9"))
    item = F.struct(F.concat(F.expr(_LONG), c("slug")).alias("slug"), "name", days.alias("day"), F.lit("19:00").alias("time"), "conference_url")
    landed = rows.select("feed_id", F.lit("aa").alias("fellowship"), F.lit("tsml").alias("format"), F.to_json(F.array(item)).alias("body"))
    return dialects.parse_items(envelope.items(landed)).select("feed_id", "slug", "day")


@query(CTES + "select feed_id, slug, name, cast(null as varchar) as notes, cast(null as varchar) as location_notes, cast(0 as int) as emails from safe")
def list_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Listings in list form: long texts and addresses for feedback emptied, the rest kept."""
    rows = _safe(spark, sf, "slug", "name", "notes", "location_notes").withColumn("feedback_emails", F.array(F.lit("a@example.org")))
    return predicates.without_details(rows).select("feed_id", "slug", "name", "notes", "location_notes", F.size("feedback_emails").alias("emails"))


@query(
    """select s_suppkey, case when s_suppkey % 4 = 0 then 'full' when s_suppkey % 3 > 0 then 'incremental' else 'skip' end as plan,
  case when s_suppkey % 11 = 0 then 'Happening now' when m < 1 then 'Starting now' when m < 60 then 'in ' || m || ' min'
    when m // 60 < 24 and m % 60 > 0 then 'in ' || (m // 60) || 'h ' || (m % 60) || 'm' when m // 60 < 24 then 'in ' || (m // 60) || 'h'
    when d = 1 then 'tomorrow' when d > 1 then 'in ' || d || ' days' when near = 1 then 'tomorrow' else 'in ' || near || ' days' end as until
from (select *, cast(floor((m // 60) / 24.0 + 0.5) as int) as near from (select s_suppkey, (s_suppkey * 37) % 4000 - 5 as m,
  case s_suppkey % 5 when 1 then 1 when 2 then 3 end as d from supplier))"""
)
def rebuild_plans(spark: SparkSession, sf: str) -> DataFrame:
    """The mode of a rebuild by catalog state and written feeds, and the caption of a wait."""
    rows = feeds(spark, sf).select(F.split("id", "-")[1].cast("bigint").alias("s_suppkey"))
    modes = [(dirty, n, rollup.rebuild_plan(dirty, n)) for dirty in (True, False) for n in (0, 1, 2)]
    table = spark.createDataFrame(modes, "dirty boolean, n bigint, plan string")
    found = rows.withColumns({"dirty": c("s_suppkey") % 4 == 0, "n": c("s_suppkey") % 3, "m": (c("s_suppkey") * 37) % 4000 - 5})
    days = F.when(c("s_suppkey") % 5 == 1, 1).when(c("s_suppkey") % 5 == 2, 3)
    until = clock.format_until(c("m"), c("s_suppkey") % 11 == 0, days)
    return found.join(table, ["dirty", "n"]).select("s_suppkey", "plan", until.alias("until"))
