"""Feeds, listings and other domain tables as views over the given tables.

Every column is one SQL expression that Spark and DuckDB read alike; the same text makes the Spark
frame and the common table expression of the comparison SQL.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weekgrid.functions.base import bind
from weekgrid.functions.geo import geohash4

NOW = datetime(2001, 11, 5, 0, 0)
NOW_SQL = "timestamp '2001-11-05 00:00:00'"

FEED_COLUMNS = {
    "id": "concat('feed-', s_suppkey)",
    "name": "s_name",
    "url": "concat('https://www.feeds', s_suppkey % 50, '.example.org/list/', s_suppkey, '/')",
    "region_hint": "case s_suppkey % 4 when 0 then 'US-CA' when 1 then 'GB' when 2 then 'ONLINE' else null end",
    "fellowship": "case s_suppkey % 3 when 0 then 'na' else 'aa' end",
    "format": "case s_suppkey % 3 when 0 then 'bmlt' else 'tsml' end",
    "status": "case when s_acctbal < 0 then 'error' when s_suppkey % 17 = 0 then 'disabled' else 'ok' end",
    "last_attempt_at": f"case when s_suppkey % 19 = 0 then null else {NOW_SQL} - (s_suppkey % 30) * interval '1' hour end",
    "last_ok_at": f"case when s_suppkey % 23 = 0 then null else {NOW_SQL} - (s_suppkey % 72) * interval '1' hour end",
    "last_error": "case when s_acctbal < 0 then 'timeout' else null end",
    "meeting_count": "cast(s_suppkey % 200 as int)",
    "etag": "case when s_suppkey % 2 = 0 then concat('tag-', s_suppkey) else null end",
    "last_modified": "case when s_suppkey % 5 = 0 then 'Mon, 05 Nov 2001' else null end",
    "leased_until": f"case when s_suppkey % 13 = 0 then {NOW_SQL} + interval '3' minute else null end",
}
ENTITY_COLUMNS = {
    "id": "concat('feed-', s_suppkey, ':main')",
    "feed_id": "concat('feed-', s_suppkey)",
    "name": "concat('Office ', s_suppkey % 20)",
    "phone": "case when s_suppkey % 4 = 0 then null else concat('0123-', s_suppkey) end",
    "email": "concat('office', s_suppkey, '@example.org')",
    "url": "concat('https://office', s_suppkey, '.example.org/')",
    "location_text": "concat('City ', s_suppkey % 40)",
}
LISTING_COLUMNS = {
    "feed_id": "concat('feed-', l_suppkey)",
    "slug": "concat('m-', l_orderkey, '-', l_linenumber)",
    "name": "p_name",
    "day": "case when l_orderkey % 8 = 7 then null else cast(l_orderkey % 8 as int) end",
    "time": (
        "case when l_partkey % 31 = 0 then null else concat(lpad(cast(l_partkey % 24 as string), 2, '0'), ':', "
        "lpad(cast((l_suppkey % 4) * 15 as string), 2, '0')) end"
    ),
    "end_time": (
        "case when l_linenumber % 2 = 0 then null else concat(lpad(cast((l_partkey + 1) % 24 as string), 2, '0'), ':', "
        "lpad(cast((l_suppkey % 4) * 15 as string), 2, '0')) end"
    ),
    "timezone": (
        "case o_custkey % 6 when 0 then 'Europe/London' when 1 then 'UTC' when 2 then 'America/New_York' "
        "when 3 then 'Nowhere/Land' else null end"
    ),
    "types_text": (
        "concat(case when l_returnflag = 'R' then 'C' else 'O' end, case when l_linenumber % 3 = 0 then ',BE' else '' end, "
        "case when l_quantity > 40 then ',X' else '' end, case when l_orderkey % 5 in (3, 4) then ',ONL' else '' end)"
    ),
    "attendance": "case l_orderkey % 5 when 3 then 'hybrid' when 4 then 'online' else 'in-person' end",
    "fellowship": "case l_partkey % 7 when 4 then null when 5 then 'na' when 6 then 'ca' else 'aa' end",
    "location_name": "case when l_partkey % 5 = 0 then null else concat('Hall ', l_partkey % 50) end",
    "address": "case when l_orderkey % 11 = 0 then null else concat(l_partkey % 200 + 1, ' High Street') end",
    "city": "case when o_custkey % 40 = 39 then 'online' else concat('City ', o_custkey % 40) end",
    "neighborhood": (
        "case l_partkey % 3 when 0 then concat('Area ', l_partkey % 12) when 1 then concat('City ', o_custkey % 40) "
        "else null end"
    ),
    "state": "case when n_nationkey % 4 = 0 then null else n_name end",
    "postal_code": (
        "case when l_suppkey % 4 = 0 then null else concat('BH', l_suppkey % 9 + 1, ' ', l_partkey % 9 + 1, 'AB') end"
    ),
    "country": "case when n_nationkey % 5 = 0 then null else concat('C', n_regionkey) end",
    "formatted_address": (
        "case when l_orderkey % 11 = 0 then null else concat(l_partkey % 200 + 1, ' High Street, City ', o_custkey % 40) end"
    ),
    "lat": (
        "case when l_orderkey % 13 = 0 then null else (o_custkey % 40) * 3e0 - 60e0 + (l_partkey % 100) / 100e0 + "
        "case when l_orderkey % 97 = 0 then 4e0 else 0e0 end end"
    ),
    "lng": (
        "case when l_orderkey % 13 = 0 then null else (o_custkey % 40) * 8e0 - 160e0 + (l_suppkey % 100) / 100e0 end"
    ),
    "conference_url": (
        "case when l_orderkey % 5 in (3, 4) then concat('https://meet.example.org/', l_suppkey) else null end"
    ),
    "notes": (
        "case when l_quantity > 45 then 'Beginners welcome, tea served' when l_quantity > 35 then "
        "'Wheelchair accessible entrance' when l_quantity > 30 then '  ' else null end"
    ),
    "location_notes": "case when l_discount > 0.08 then 'Use the side door' else null end",
    "updated_at": "l_shipdate",
    "entity_id": "case when l_linenumber % 2 = 0 then concat('feed-', l_suppkey, ':main') else null end",
    "price": "l_extendedprice",
}
# (table, join condition, column prefix), each joined only when a wanted column needs it.
LISTING_JOINS = (
    ("orders", "l_orderkey = o_orderkey", "o_"),
    ("customer", "o_custkey = c_custkey", "c_"),
    ("nation", "c_nationkey = n_nationkey", "n_"),
    ("part", "l_partkey = p_partkey", "p_"),
)
# Texts and pins no table has; absent columns of the listing schema.
ABSENT = {"group_name": "string", "conference_phone": "string"}


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once per process."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _select(columns: dict[str, str], source: str) -> str:
    return "select " + ", ".join(f"{text} as {name}" for name, text in columns.items()) + f" from {source}"


FEEDS_SQL = _select(FEED_COLUMNS, "supplier")
ENTITIES_SQL = _select(ENTITY_COLUMNS, "supplier")
_FROM = "lineitem " + " ".join(f"join {name} on {on}" for name, on, _ in LISTING_JOINS)
LISTINGS_SQL = _select(LISTING_COLUMNS, _FROM)


def feeds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(*[f"{v} as {k}" for k, v in FEED_COLUMNS.items()])


def entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").selectExpr(*[f"{v} as {k}" for k, v in ENTITY_COLUMNS.items()])
    return rows.withColumn("feedback_emails", F.array("email"))


def listings(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Listings with the wanted columns, all by default; only the tables they need are joined.

    Every line item has its order, customer, nation and part, so leaving a join out keeps the rows.
    """
    derived = {"geohash4": ("lat", "lng"), "types": ("types_text",)}
    wanted = columns or (*LISTING_COLUMNS, *derived, *ABSENT)
    base = [n for n in wanted if n in LISTING_COLUMNS]
    base += [n for d in wanted if d in derived for n in derived[d] if n not in base]
    text = " ".join(LISTING_COLUMNS[n] for n in base)
    need = {prefix for _, _, prefix in LISTING_JOINS if re.search(rf"\b{prefix}", text)}
    need |= {"c_"} if "n_" in need else set()
    need |= {"o_"} if "c_" in need else set()
    # Orders meet their customer and nation before the line items, which are several times as many rows.
    rows, owners = table(spark, sf, "lineitem"), None
    for name, on, prefix in LISTING_JOINS:
        if prefix in need and prefix != "p_":
            owners = table(spark, sf, name) if owners is None else owners.join(table(spark, sf, name), F.expr(on))
    if owners is not None:
        rows = rows.join(owners, F.expr(LISTING_JOINS[0][1]))
    if "p_" in need:
        rows = rows.join(table(spark, sf, "part"), F.expr(LISTING_JOINS[-1][1]))
    rows = rows.selectExpr(*[f"{LISTING_COLUMNS[n]} as {n}" for n in base])
    if "geohash4" in wanted:
        rows = bind(rows, lat=F.col("lat"), lng=F.col("lng"))
        rows = rows.withColumn("geohash4", geohash4(F.col("lat"), F.col("lng")))
    if "types" in wanted:
        rows = rows.withColumn("types", F.split("types_text", ","))
    absent = [F.lit(None).cast(ABSENT[n]).alias(n) for n in wanted if n in ABSENT]
    return rows.select("*", *absent)


# --- the same in SQL text ------------------------------------------------------------------

ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash4_sql(lat: str, lng: str) -> str:
    """Four letters from ten bits per axis; a value on a border belongs to the lower cell. No pin, no cell."""

    def axis(value: str, low: float, span: float) -> str:
        return f"least(greatest(cast(ceil(({value} + {low}) / {span} * 1024) as integer) - 1, 0), 1023)"

    x, y = axis(lng, 180.0, 360.0), axis(lat, 90.0, 180.0)
    bits = [f"((({x if i % 2 == 0 else y}) >> {9 - i // 2}) & 1)" for i in range(20)]
    letters = []
    for at in range(0, 20, 5):
        code = " + ".join(f"{bits[at + k]} * {16 >> k}" for k in range(5))
        letters.append(f"substr('{ALPHABET}', {code} + 1, 1)")
    return f"(case when {lat} is not null and {lng} is not null then " + " || ".join(letters) + " end)"


def slug_text_sql(value: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({value})), '[^a-z0-9]+', '-', 'g'), '-')"


def slug_sql(value: str) -> str:
    return f"substr({slug_text_sql(value)}, 1, 80)"


def short_key_sql(value: str, most: int) -> str:
    return f"case when length({value}) <= {most} then {value} else substr({value}, 1, {most - 17}) || '-' || substr(sha256({value}), 1, 16) end"


def haversine_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = (
        f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
        f"power(sin(radians({lng2} - {lng1}) / 2), 2))"
    )
    return f"(12742 * atan2(sqrt({a}), sqrt(greatest(0, 1 - {a}))))"


CTES = f"""with feeds as ({FEEDS_SQL}),
entities as ({ENTITIES_SQL}),
listings as (
  select l.*, {geohash4_sql("l.lat", "l.lng")} as geohash4, string_split(types_text, ',') as types
  from ({LISTINGS_SQL}) l
),
fresh as (
  select id as feed_id, name as feed_name, last_ok_at as source_verified_at from feeds
  where status = 'ok' and last_ok_at >= {NOW_SQL} - interval '48' hour
),
public as (select l.*, f.feed_name, f.source_verified_at from listings l join fresh f on f.feed_id = l.feed_id),
safe as (
  select * from public where day is not null and time is not null and (attendance = 'online' or (
    formatted_address is not null and city is not null and lat is not null and lng is not null
    and lower(trim(city)) not in ('online', 'virtual', 'regional')
    and not regexp_matches(trim(city), '^[A-Z]{{2,3}}$') and length(trim(city)) <= 80))
)
"""
