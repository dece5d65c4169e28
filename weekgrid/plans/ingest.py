"""Registered queries: payloads, pages, URLs, cleaning and text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrid.functions import clock, html, notes, place, urls
from weekgrid.functions.base import bind
from weekgrid.functions.labels import as_feed_format, as_fellowship
from weekgrid.functions.text import slugify
from weekgrid.operators import clean, dedupe, feeds as feed_ops, predicates, sinks
from weekgrid.plans.registry import query
from weekgrid.plans.views import CTES, NOW, feeds, geohash4_sql, listings, short_key_sql, slug_sql, slug_text_sql, table
from weekgrid.sources import dialects, envelope, pages

c = F.col


# --- JSON payloads -------------------------------------------------------------------------


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One payload per listing: the dialect and the envelope change with the line number."""
    rows = listings(spark, sf).withColumn("line", F.split("slug", "-")[2].cast("int"))
    tsml = F.to_json(
        F.struct(
            "name", "slug", F.array(c("day").cast("string")).alias("day"), "time", "end_time",
            c("types_text").alias("types"), c("location_name").alias("location"), "address", "formatted_address",
            "city", "state", "country", F.concat_ws(",", "lat", "lng").alias("coordinates"), "conference_url", "notes",
        )
    )
    bmlt = F.to_json(
        F.struct(
            c("slug").alias("id_bigint"), c("name").alias("meeting_name"), (c("day") + 1).alias("weekday_tinyint"),
            F.concat("time", F.lit(":00")).alias("start_time"), F.lit("01:30:00").alias("duration_time"),
            F.split("types_text", ",").alias("formats"), c("city").alias("location_municipality"),
            c("country").alias("location_nation"), c("lat").cast("string").alias("latitude"), c("lng").alias("longitude"),
            c("conference_url").alias("virtual_meeting_link"), c("notes").alias("comments"),
        )
    )
    oiaa = F.to_json(
        F.struct(
            c("slug").alias("groupID"), "name", F.lit("America/New_York").alias("timezone"),
            F.concat(F.lit("2001-11-05T"), "time", F.lit(":00Z")).alias("timeUTC"), F.lit(60).alias("duration"),
            "conference_url", c("types_text").alias("formats"), F.array(F.lit("EN"), F.lit("es")).alias("languages"), "notes",
        )
    )
    kind = c("line") % 3
    item = F.when(kind == 0, tsml).when(kind == 1, bmlt).otherwise(oiaa)
    body = (
        F.when(c("line") % 4 == 0, F.concat(F.lit('{"meetings":['), item, F.lit("]}")))
        .when(c("line") % 4 == 1, F.concat(F.lit('{"results":['), item, F.lit("]}")))
        .when(c("line") == 7, F.concat(F.lit("{broken"), item))
        .otherwise(F.concat(F.lit("["), item, F.lit("]")))
    )
    return rows.select("feed_id", F.lit("aa").alias("fellowship"), F.lit("tsml").alias("format"), body.alias("body"), "price")


_CLOCK = "lpad(cast((({0}) % 1440) // 60 as varchar), 2, '0') || ':' || lpad(cast((({0}) % 1440) % 60 as varchar), 2, '0')"
_MIN = "(cast(substr(time, 1, 2) as int) * 60 + cast(substr(time, 4, 2) as int))"
_TYPED = """list_concat({0}, list_concat(case when notes like 'Beginners welcome%' and not list_contains({0}, 'BE') then ['BE'] else [] end,
  case when notes like 'Wheelchair accessible%' and not list_contains({0}, 'X') then ['X'] else [] end))"""
_ROUTE_SQL = (
    CTES
    + f""", numbered as (select *, cast(string_split(slug, '-')[3] as int) as line from listings),
lines as (select * from numbered where line <> 7),
tsml as (select feed_id, price, slug, name, cast(day as int) as day, time, end_time,
  case when conference_url is null then 'in-person' when lat is not null or (location_name is not null and coalesce(address, formatted_address) is not null
    and length(coalesce(address, formatted_address)) - length(replace(coalesce(address, formatted_address), ',', '')) >= 1) then 'hybrid' else 'online' end as attendance,
  case when city <> 'online' then city when formatted_address is not null then 'City 39' else state end as city, country,
  {_TYPED.format("types")} as typed, lat, notes from lines where line % 3 = 0),
bmlt as (select feed_id, price, {short_key_sql(slug_text_sql("slug || '-' || name"), 64)} as slug, name, cast(day as int) as day, time, {_CLOCK.format(_MIN + " + 90")} as end_time,
  case when conference_url is not null then 'hybrid' else 'in-person' end as attendance, case when city <> 'online' then city end as city, country,
  {_TYPED.format("types")} as typed, lat, notes from lines where line % 3 = 1),
oiaa as (select feed_id, price, slug, name, case when {_MIN} >= 300 then 1 else 0 end as day, {_CLOCK.format(_MIN + " + 1140")} as time,
  {_CLOCK.format(_MIN + " + 1200")} as end_time, 'online' as attendance, cast(null as varchar) as city, cast(null as varchar) as country,
  {_TYPED.format("case when list_contains(types, 'ONL') then list_append(types, 'SP') else list_concat(types, ['SP', 'ONL']) end")} as typed,
  cast(null as double) as lat, notes from lines where line % 3 = 2 and conference_url is not null and time is not null),
odd as (select feed_id, price, {slug_sql("name")} as slug, name, cast(null as int) as day, cast(null as varchar) as time, cast(null as varchar) as end_time,
  case when conference_url is null then 'in-person' else 'online' end as attendance, cast(null as varchar) as city, cast(null as varchar) as country,
  {_TYPED.format("case when conference_url is null then cast([] as varchar[]) else ['ONL'] end")} as typed, cast(null as double) as lat, notes
  from lines where line % 3 = 2 and time is null),
parsed as (select * from tsml union all select * from bmlt union all select * from oiaa union all select * from odd)
"""
)


@query(
    _ROUTE_SQL
    + "select feed_id, slug, name, day, time, end_time, attendance, city, country, array_to_string(typed, ',') as types, "
    f"case when lat is not null then {geohash4_sql('lat', '0.0')}[1:1] end as lat_band, nullif(trim(notes), '') as notes from parsed"
)
def json_route(spark: SparkSession, sf: str) -> DataFrame:
    rows = dialects.parse_items(envelope.items(_payloads(spark, sf)))
    band = F.when(c("lat").isNotNull(), F.substring(dialects.with_geo(c("lat"), F.lit(0.0))["geohash4"], 1, 1))
    return rows.select(
        "feed_id", "slug", "name", "day", "time", "end_time", "attendance", "city", "country",
        F.array_join("types", ",").alias("types"), band.alias("lat_band"), "notes",
    )


@query(
    CTES
    + "select feed_id, count(*) as n, 'payload is not JSON' as error from listings where slug like '%-7' group by feed_id"
)
def payload_errors(spark: SparkSession, sf: str) -> DataFrame:
    return envelope.payload_errors(_payloads(spark, sf)).groupBy("feed_id", "error").agg(F.count("*").alias("n"))


@query(
    CTES
    + """, numbered as (select *, cast(string_split(slug, '-')[3] as int) as line from listings)
select feed_id, line <> 7 as ok, cast(case when line <> 7 then 1 else 0 end as int) as count,
  case when line = 7 or line % 3 = 0 then 'tsml' when line % 3 = 1 then 'bmlt' when time is null then 'tsml' else 'oiaa' end as format from numbered"""
)
def probe_shapes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _payloads(spark, sf).withColumn("_s", envelope.probe_shape(c("body")))
    return rows.select("feed_id", "_s.ok", "_s.count", "_s.format")


@query(
    "select event_id, cast(regexp_extract(props, '([0-9]+)', 1) as double) as k, regexp_matches(props, '\"(lat|lng|latitude|longitude)\"\\s*:') "
    "as has_coordinates from events"
)
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("raw", F.try_parse_json("props"))
    return rows.select(
        "event_id", dialects.as_number(dialects.field("k")).alias("k"),
        notes.has_coordinate_key(c("props")).alias("has_coordinates"),
    )


# --- pages of listings ---------------------------------------------------------------------

_NAMES = "['sunday', 'monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday']"
_SOURCE = CTES + f""", slots as (select *, {_NAMES}[day + 1] as weekday from listings where day is not null and time is not null)
"""


def _slots(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, "feed_id", "slug", "name", "day", "time", "address", "postal_code", "attendance", "lat", "lng", "price", "city")
    rows = rows.where(c("day").isNotNull() & c("time").isNotNull())
    return rows.withColumn("weekday", clock.weekday_name(c("day")))


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


@query(
    _SOURCE
    + f"""select feed_id, price, name, {slug_sql("name || ' ' || weekday || ' ' || time")} as slug, cast(day as int) as day, time, postal_code,
  case when city = 'online' then 'Leeds' else city end as city, case when attendance = 'hybrid' then 'O,X' else 'C,X' end as types, lat as latitude
from slots where attendance <> 'online' and lat is not null"""
)
def table_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each listing as a row of a table page; online rows point at the centre pin."""
    cell = lambda v: F.concat(F.lit("<td class='x'>"), v, F.lit("</td>"))
    rows = _slots(spark, sf).where((c("lat").isNotNull()) | (c("attendance") == "online"))
    online = c("attendance") == "online"
    town = F.when(c("city") == "online", "Leeds").otherwise(c("city"))
    formatted = F.concat_ws(", ", F.lit("1 High St"), town, "postal_code")
    cells = [
        F.initcap("weekday"), F.concat(c("time"), F.lit(" start")), F.concat(F.lit("<b>"), c("name"), F.lit("</b>")),
        F.when(online, "Zoom").otherwise("Hall"), formatted, F.lit("Online"), F.lit("-"),
        F.concat(F.when(c("attendance") == "hybrid", "Open").otherwise("closed"), F.lit(", Wheelchair ok")),
        F.when(online, "55.378").otherwise(c("lat").cast("string")), F.when(online, "-3.436").otherwise(c("lng").cast("string")),
    ]
    page = rows.select(
        "feed_id", "price", F.concat(F.lit("<table><TR>"), *[cell(v) for v in cells], F.lit("</tr><tr><td>short</td></tr></table>")).alias("html")
    )
    out = pages.table_rows(page, ["feed_id", "price"])
    return out.select(
        "feed_id", "price", "name", "slug", "day", "time", "postal_code", "city", F.array_join("types", ",").alias("types"), "latitude"
    )


@query(
    _SOURCE
    + f"""select feed_id, price, name, {slug_sql("name || ' ' || weekday || ' ' || time")} as slug, cast(day as int) as day, time,
  {_CLOCK.format(_MIN + " + 75")} as end_time, postal_code, 'Poole' as city, 'St Mary' as location, case when attendance = 'hybrid' then 'O' else 'C' end as types
from slots where attendance <> 'online'"""
)
def weekday_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each listing as a weekday section with a paragraph; online rows are marked closed down."""
    remark = F.when(c("attendance") == "hybrid", "All meetings are &lsquo;open&rsquo;").otherwise("Ring first")
    paragraph = F.concat(
        F.lit("<h3><b>"), F.initcap("weekday"), F.lit("</b></h3><div>x</div><p>"), c("name"), F.lit("*<br/>St Mary (back door), 5 High St, Poole<br>Time: "),
        F.replace("time", F.lit(":"), F.lit(".")), F.lit(", Duration: 1 hour 15 mins."),
        _text(F.concat(F.lit(" Postcode: "), c("postal_code"), F.lit("."))), F.lit(" "), remark,
        F.when(c("attendance") == "online", " Closed down").otherwise(""), F.lit("</p><h3>Notes</h3><p>Time: 8pm</p>"),
    )
    page = _slots(spark, sf).select("feed_id", "price", paragraph.alias("html"))
    out = pages.intergroup_pages(page, ["feed_id", "price"])
    return out.select(
        "feed_id", "price", "name", "slug", "day", "time", "end_time", "postal_code", "city", "location", F.array_join("types", ",").alias("types")
    )


@query(
    _SOURCE
    + f"""select feed_id, price, name, {slug_sql("name || ' ' || weekday || ' ' || time")} as slug, cast(day as int) as day, time,
  '21:30' as end_time, postal_code, 'York' as city from slots union all
select feed_id, price, 'Crypt', {slug_sql("'Crypt ' || weekday || ' 09:05'")}, cast(day as int), '09:05', null, null, 'Hull' from slots"""
)
def card_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each listing as a titled card, followed by a card without a title of its own."""
    card = F.concat(
        F.lit("<h2>"), c("name"), F.lit("</h2>"), F.initcap("weekday"), F.lit(" / "), c("time"), F.lit(" – 21:30 / Hall, 2 Mill Lane, York"),
        _text(F.concat(F.lit(", "), c("postal_code"))), F.lit("<br>"), c("weekday"), F.lit(" / 9:05 / Crypt, HULL<br>"), c("weekday"), F.lit(" / 25:00 / Nowhere"),
    )
    page = _slots(spark, sf).select("feed_id", "price", card.alias("html"))
    out = pages.intergroup_pages(page, ["feed_id", "price"])
    return out.select("feed_id", "price", "name", "slug", "day", "time", "end_time", "postal_code", "city")


@query(
    _SOURCE
    + f"""select feed_id, price, name, {slug_sql("name || ' ' || weekday || ' ' || time")} as slug, cast(day as int) as day, time,
  '22:15' as end_time, postal_code, 'Dorchester' as city, 'Church Hall' as location from slots where postal_code is not null"""
)
def line_list_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each listing as lines around its weekday; rows without a postcode cannot be placed."""
    lines = F.concat(
        F.lit("<script>Monday 10:00</script><h2 id=a>"), c("name"), F.lit("</h2><div>Some words</div><p>"), F.initcap("weekday"), F.lit("</p><li>"),
        c("time"), F.lit(" ~ 22:15</li><div>Church Hall</div><div>12 High Street, Dorchester, Dorset</div><td>"), _text(c("postal_code")),
        F.lit("</td><div>Dorset Area</div>"),
    )
    page = _slots(spark, sf).select("feed_id", "price", lines.alias("html"))
    out = pages.line_list(page, ["feed_id", "price"])
    return out.select("feed_id", "price", "name", "slug", "day", "time", "end_time", "postal_code", "city", "location")


@query(
    _SOURCE
    + f"""select feed_id, price, name, {slug_sql("name || ' ' || weekday || ' ' || time")} as slug, cast(day as int) as day, time,
  {_CLOCK.format(_MIN + " + 90")} as end_time, postal_code, 'Poole' as city, 'C,X' as types from slots union all
select feed_id, price, 'Harbour Group', {slug_sql("'Harbour Group ' || weekday || ' 20:30'")}, cast(day as int), '20:30', '21:45', null, 'Bournemouth', 'O' from slots"""
)
def print_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each listing in a printed list, running into a second entry and then a closed one."""
    text = F.concat(
        F.lit("Front matter "), F.upper("weekday"), F.lit(" "), c("name"), F.lit(" ♿ St Mary, 5 Quay St, Poole. Time: "),
        F.replace("time", F.lit(":"), F.lit(".")), F.lit(" Duration: 1 hour 30 mins."), _text(F.concat(F.lit(" Postcode: "), c("postal_code"), F.lit("."))),
        F.lit(" Parking available Harbour Group, 12 Sea Road, Bournemouth. Time: 8.30pm to 9.45pm All meetings are open. "
              "This meeting has closed down. Time: 9pm Duration: 1 hour. Sort code: 1 Time: 3"),
    )
    page = _slots(spark, sf).select("feed_id", "price", text.alias("text"))
    out = pages.print_list(page, ["feed_id", "price"])
    return out.select(
        "feed_id", "price", "name", "slug", "day", "time", "end_time", "postal_code", "city", F.array_join("types", ",").alias("types")
    )


# --- given pages ---------------------------------------------------------------------------


@query(
    r"""select distinct host from (select unnest(list_transform(regexp_extract_all(html, '(?i)https?://((?:www\.)?[a-z0-9.-]+\.[a-z]{2,})', 1),
  lambda h: lower(h))) as host from pages union all
  select regexp_extract(url, '^https?://([^/?#]+)', 1) from pages)
where host not in ('www.aa.org', 'aa.org', 'www.na.org', 'na.org', 'ca.org', 'www.ca.org') and not ends_with(host, '.aa.org')
  and not contains(host, 'googleapis') and not contains(host, 'gstatic')"""
)
def page_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return pages.hosts(table(spark, sf, "pages").select(F.concat_ws(" ", "html", "url").alias("html")))


@query(
    """select page_id, count(*) as links from (select page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*href=["'']([^"'']+)["''][^>]*>', 1)) as href from pages)
group by page_id"""
)
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select(
        "page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(pages.ANCHOR), F.lit(1))).alias("href")
    )
    found = rows.where(urls.resolve(c("href"), c("url")).isNotNull())
    return found.groupBy("page_id").agg(F.count("*").alias("links"))


_HOMES_HTML = (
    "concat('<a href=\"/intergroups/zed-', page_id % 7, '/\">Find out more</a><h2>North &amp; ', page_id % 5, '</h2><a href=\"/intergroups/abc-', "
    "page_id % 9, '/\">x</a><a href=\"https://elsewhere.example.org/intergroups/no/\">y</a>')"
)


@query(
    r"""with p as (select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) as origin from pages)
select page_id, 'aa-abc-' || (page_id % 9) as id, 'North & ' || (page_id % 5) as name, origin || '/intergroups/abc-' || (page_id % 9) || '/' as url from p
union all select page_id, 'aa-zed-' || (page_id % 7), 'Zed ' || (page_id % 7), origin || '/intergroups/zed-' || (page_id % 7) || '/' from p"""
)
def intergroup_homes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").selectExpr("page_id", "url as page_url", f"concat(html, {_HOMES_HTML}) as html")
    return pages.intergroup_homes(rows, ["page_id"], url="page_url").select("page_id", "id", "name", "url")


@query(
    r"""with p as (select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) as origin from pages)
select page_id, origin || '/intergroups/g' || (page_id % 9) || '/meetings/' as link from p
union all select page_id, origin || '/intergroups/g' || (page_id % 9) || '/in-person-meetings' from p"""
)
def list_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").selectExpr(
        "page_id", "concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/intergroups/g', page_id % 9, '/') as url",
        "concat(html, '<a href=\"meetings/?x=1#y\">a</a><a class=z href=\"/intergroups/g', page_id % 9, '/in-person-meetings\">b</a>"
        "<a href=\"/intergroups/g', page_id % 9, '/online-meetings/\">c</a><a href=\"/intergroups/other/meetings/\">d</a>') as html",
    )
    return pages.list_links(rows, ["page_id"])


@query(
    r"""select page_id, case when path <> '/' and ends_with(path, '/') then base || path[:-2] || query else base || path || query end as canonical
from (select page_id, lower(regexp_extract(url, '^(https?)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\.', '') as base,
  case when regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) end as path,
  regexp_extract(url, '(\?[^#]*)', 1) as query from pages)"""
)
def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.canonical_url(c("url")).alias("canonical"))


_POLICY = (
    "concat(case page_id % 9 when 0 then 'http://' when 1 then 'ftp://' else 'https://' end, case page_id % 9 when 2 then concat('10.0.0.', page_id % 250) "
    "when 3 then concat('172.', page_id % 64, '.1.1') when 4 then 'me@host.org' when 5 then concat('h', page_id, '.internal') when 6 then '[::ffff:7f00:1]' "
    "when 7 then 'LOCALHOST' else 'www.example.org:443' end, '/x')"
)


@query(
    f"""select page_id, case when page_id % 9 in (0, 1, 4) then 'not public https' when page_id % 9 in (5, 7) then 'private host'
  when page_id % 9 in (2, 6) then 'private address' when page_id % 9 = 3 and page_id % 64 between 16 and 31 then 'private address' end as problem,
  case when starts_with(url, 'https') then null else 'not public https' end as own_problem from (select *, {_POLICY} as made from pages)"""
)
def url_policy(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").selectExpr("page_id", "url", f"{_POLICY} as made")
    return rows.select("page_id", urls.url_problem(c("made")).alias("problem"), urls.url_problem(c("url")).alias("own_problem"))


_SEEDS_SQL = """with seeds as (select 'http://seed' || (s_suppkey % 60) || '.example.org/list' as canonical, arg_min(s_name, s_suppkey) as name,
  case when min(s_suppkey) % 2 = 0 then 'GB' end as region_hint from supplier group by s_suppkey % 60),
roots as (select 'https://root' || (s_suppkey % 40) || '.example.org/main_server/client_interface/json/?switcher=GetSearchResults' as canonical,
  arg_min(s_name, s_suppkey) as name, 'US-TX' as region_hint from supplier group by s_suppkey % 40)"""
_PATHS_SQL = """(values ('/wp-admin/admin-ajax.php?action=meetings'), ('/?tsml-feed=1'), ('/?post_type=tsml_meeting&feed=tsml'),
  ('/wp-json/tsml/v1/meetings'), ('/api/meetingguide'), ('/api/meetingguide.json'), ('/meetings.json')) t(path)"""


@query(
    _SEEDS_SQL + rf""", hosts as (select distinct regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\.', '') as host from pages)
select canonical, name, region_hint from seeds union all select canonical, name, region_hint from roots
union all select 'https://' || host || path, host, 'US' from hosts, {_PATHS_SQL}"""
)
def feed_candidates(spark: SparkSession, sf: str) -> DataFrame:
    hosts = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")).distinct()
    rows = table(spark, sf, "supplier")
    seeds = rows.selectExpr(
        "concat('http://www.Seed', s_suppkey % 60, '.example.org:80/list/') as url", "'aa' as fellowship", "'tsml' as format",
        "concat('seed-', s_suppkey) as id", "s_name as name", "case when s_suppkey % 2 = 0 then 'GB' end as regionHint", "s_suppkey as pos",
    )
    roots = rows.selectExpr(
        "concat('https://root', s_suppkey % 40, '.example.org/main_server/') as url", "concat('root-', s_suppkey) as id",
        "s_name as name", "'US-TX' as regionHint", "s_suppkey as pos",
    )
    return feed_ops.candidates(seeds, roots, hosts).select("canonical", "name", "region_hint")


@query(
    """select page_id, regexp_matches(html, '(?i)just a moment|cf-browser-verification|challenge-platform|performing security verification') as blocked,
  cast(len(regexp_extract_all(regexp_replace(html, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>')) as int) as tags from pages"""
)
def page_markup(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.size(F.regexp_extract_all(F.regexp_replace("html", html.BREAK, "\n"), F.lit(html.TAG), F.lit(0)))
    return table(spark, sf, "pages").select("page_id", html.is_bot_challenge(c("html")).alias("blocked"), tags.alias("tags"))


@query(
    r"""with plain as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?i)<script(.|\n)*?</script>', ' ', 'g'), '(?i)<style(.|\n)*?</style>', ' ', 'g'), '(?i)<h2\b[^>]*>', chr(10) || '## ', 'g'),
  '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|li|h[1-6]|tr|td|dt|dd|article|section)>', chr(10), 'g'), '<[^>]+>', ' ', 'g') as t from pages),
lines as (select page_id, unnest(string_split(replace(regexp_replace(replace(t, '&amp;', '&'), '&#0?39;|&apos;', '''', 'g'), chr(160), ' '), chr(10))) as line from plain)
select page_id, count(*) as lines, cast(sum(length(trim(regexp_replace(line, '\s+', ' ', 'g')))) as bigint) as chars from lines
where trim(regexp_replace(line, '\s+', ' ', 'g')) <> '' group by page_id"""
)
def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "pages").select("page_id", F.explode(html.page_lines(c("html"))).alias("line"))
    return lines.groupBy("page_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


# --- conversations and notes ---------------------------------------------------------------


@query(
    """select conv_id, trim(text, E' \\n\\t\\r') as text, regexp_matches(text, '(?i)\\b(suicid(?:e|al)|kill(?:ing)? myself|want to die|end my life|overdos(?:e|ing)|self[-\\s]harm)\\b') as crisis
from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations where role = 'user') where rn = 1"""
)
def latest_user_turn(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "conversations").where(c("role") == "user")
    last = dedupe.first_by(users, ["conv_id"], c("turn").desc())
    return last.select("conv_id", F.btrim("text", F.lit(" \n\t\r")).alias("text"), notes.is_crisis(c("text")).alias("crisis"))


@query(
    CTES + f"select feed_id, slug, price, array_to_string({_TYPED.format('types')}, ',') as types from listings"
)
def note_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, "feed_id", "slug", "price", "types", "notes", "location_notes")
    typed = notes.with_note_types(c("types"), c("notes"), c("location_notes"))
    return rows.select("feed_id", "slug", "price", F.array_join(typed, ",").alias("types"))


@query(
    "select doc_id, regexp_matches(text, '(?i)\\bbeginners? welcome\\b') as beginners, sha256(trim(text, E' \\n\\t\\r')) as content_hash from documents "
    "where trim(text, E' \\n\\t\\r') <> ''"
)
def note_hashes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("content", notes.combined_notes(c("text"), F.lit(None).cast("string")))
    return docs.where(c("content").isNotNull()).select(
        "doc_id", c("text").rlike(notes.BEGINNERS).alias("beginners"), notes.content_hash(c("content")).alias("content_hash")
    )


# --- cleaning ------------------------------------------------------------------------------


@query(
    CTES
    + f"""select feed_id, slug, price, coalesce(lat, p.plat) as lat, coalesce(lng, p.plng) as lng from (select *, case when location_name is not null and postal_code is not null
  then feed_id || '|' || {slug_sql("location_name")} || '|' || replace(postal_code, ' ', '') end as k from listings) l
left join (select k, arg_min(lat, (updated_at, price)) as plat, arg_min(lng, (updated_at, price)) as plng from (select *, case when location_name is not null and postal_code is not null
  then feed_id || '|' || {slug_sql("location_name")} || '|' || replace(postal_code, ' ', '') end as k from listings) where k is not null and lat is not null group by k) p
on p.k = l.k and l.lat is null"""
)
def venue_borrow(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, "feed_id", "slug", "price", "updated_at", "location_name", "postal_code", "lat", "lng", "geohash4")
    return clean.borrow_pins(rows, "updated_at", "price").select("feed_id", "slug", "price", "lat", "lng")


_QUERIES_SQL = """case when (lat is null or lng is null) and attendance <> 'online' and postal_code is not null then [concat_ws(', ', postal_code, city, country)]
  when (lat is null or lng is null) and attendance <> 'online' then list_filter([formatted_address, nullif(concat_ws(', ', city, state, country), '')], lambda v: v is not null)
  when attendance = 'online' and geohash4 is null then [concat_ws(', ', city, state, country)] else [] end"""


@query(CTES + f"select distinct unnest({_QUERIES_SQL}) as query from listings")
def geocode_queries(spark: SparkSession, sf: str) -> DataFrame:
    return clean.wanted_geocodes(listings(spark, sf))


# Geocodes: customers name the postcode and city queries of the views.
_GEOCODES_SQL = """, geocodes as (select query, min(lat) as lat, min(lng) as lng from (
  select concat('BH', c_custkey % 9 + 1, ' ', c_custkey % 7 + 1, 'AB, City ', c_custkey % 40, ', C', c_nationkey % 5) as query, 50e0 + c_custkey % 9 as lat, -2e0 as lng from customer
  union all select concat('City ', c_custkey % 40), 40e0 + c_custkey % 40, 3e0 from customer
  union all select concat(c_custkey % 200 + 1, ' High Street, City ', c_custkey % 40), 30e0 + c_custkey % 40, 4e0 from customer) group by query)
"""


def _geocodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").selectExpr(
        "explode(array(struct(concat('BH', c_custkey % 9 + 1, ' ', c_custkey % 7 + 1, 'AB, City ', c_custkey % 40, ', C', c_nationkey % 5) as query, 50e0 + c_custkey % 9 as lat, -2e0 as lng), "
        "struct(concat('City ', c_custkey % 40) as query, 40e0 + c_custkey % 40 as lat, 3e0 as lng), "
        "struct(concat(c_custkey % 200 + 1, ' High Street, City ', c_custkey % 40) as query, 30e0 + c_custkey % 40 as lat, 4e0 as lng))) as g"
    ).select("g.*")
    return rows.groupBy("query").agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))


_PINNED_SQL = (
    CTES + _GEOCODES_SQL
    + f""", asked as (select *, case when attendance <> 'online' and (lat is null or lng is null) then coalesce(concat_ws(', ', nullif(postal_code, ''), city, country), '') end as pq from listings),
joined as (select a.*, coalesce(p.lat, t.lat) as glat, coalesce(p.lng, t.lng) as glng,
  (attendance <> 'online' and (a.lat is null or a.lng is null)) as offline_open from asked a
  left join geocodes p on p.query = case when attendance <> 'online' and a.lat is null then coalesce(case when postal_code is not null then concat_ws(', ', postal_code, city, country) end, formatted_address) end
  left join geocodes t on t.query = case when (attendance <> 'online' and a.lat is null and p.query is null and postal_code is null) or (attendance = 'online' and geohash4 is null) then concat_ws(', ', city, state, country) end),
pinned as (select * exclude (lat, lng, geohash4), case when offline_open then coalesce(glat, lat) else lat end as lat, case when offline_open then coalesce(glng, lng) else lng end as lng,
  coalesce(case when offline_open or geohash4 is null then {geohash4_sql("glat", "glng")} end, geohash4) as geohash4 from joined)
"""
)


@query(_PINNED_SQL + "select feed_id, slug, price, lat, lng, geohash4 from pinned")
def geocode_completion(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean.complete_pins(listings(spark, sf), _geocodes(spark, sf))
    return rows.select("feed_id", "slug", "price", "lat", "lng", "geohash4")


@query(
    _PINNED_SQL
    + """select feed_id, slug, price, case when lat is null and conference_url is not null then 'online' else attendance end as attendance,
  case when attendance <> 'online' and lat is null and conference_url is null then 'no coordinates' when day is null or time is null then 'no schedule'
    when attendance <> 'online' and not (lat is null and conference_url is not null) and formatted_address is null then 'no address' end as drop_reason from pinned"""
)
def keep_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean.complete_pins(listings(spark, sf), _geocodes(spark, sf))
    return predicates.keep_rules(rows).select("feed_id", "slug", "price", "attendance", "drop_reason")


@query(
    _PINNED_SQL.replace("geocodes as (", "stored as (select 1), geocodes as (", 1)
    + """, wanted as (select distinct unnest(""" + _QUERIES_SQL + """) as query from listings)
select query from geocodes union select query from wanted"""
)
def cache_append(spark: SparkSession, sf: str) -> DataFrame:
    cache = _geocodes(spark, sf).withColumn("cached_at", F.lit(NOW))
    fresh = clean.wanted_geocodes(listings(spark, sf)).withColumns({"lat": F.lit(0.0), "lng": F.lit(0.0)})
    return cache.unionByName(clean.cache_append(cache, fresh, "query", NOW)).select("query")


_RAW_PLACE = {
    "city": "case l_linenumber when 1 then 'North London' when 2 then concat('SW', l_suppkey % 9 + 1, ' 1AA') when 3 then 'nyc' when 4 then 'CA' else concat('City ', l_partkey % 40) end",
    "neighborhood": "case when l_partkey % 4 = 0 then concat(l_partkey % 90 + 1, ' Docks') else null end",
    "state": "case l_linenumber when 2 then 'Kent' when 4 then 'Fresno' when 5 then 'london' when 6 then '12 Shore Area' else 'ny' end",
    "postal_code": "case when l_suppkey % 2 = 0 then ' 90210 ' else null end",
    "country": "case l_partkey % 3 when 0 then 'U.S.A.' when 1 then 'united kingdom' else 'nz' end",
}


@query(
    """with raw as (select l_orderkey, l_linenumber, l_extendedprice as price, l_suppkey, concat('City ', l_partkey % 40) as plain,
  case when l_partkey % 4 = 0 then 'Docks' end as hood, case when l_suppkey % 2 = 0 then '90210' end as postal,
  case l_partkey % 3 when 0 then 'US' when 1 then 'GB' else 'NZ' end as country from lineitem)
select l_orderkey, l_linenumber, price, country,
  case l_linenumber when 1 then 'London' when 2 then 'Kent' when 3 then 'New York' when 4 then 'Fresno' when 5 then 'london' else plain end as city,
  case l_linenumber when 1 then coalesce(hood, 'North London') when 5 then coalesce(hood, plain) when 6 then coalesce(hood, 'Shore Area') else hood end as neighborhood,
  case l_linenumber when 1 then 'NY' when 2 then null when 3 then 'NY' when 4 then 'CA' when 5 then null when 6 then null else 'NY' end as state,
  case l_linenumber when 2 then coalesce(postal, 'SW' || (l_suppkey % 9 + 1) || ' 1AA') else postal end as postal_code from raw"""
)
def place_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_extendedprice as price", *[f"{v} as {k}" for k, v in _RAW_PLACE.items()]
    )
    return place.normalize_place(rows)


@query(
    CTES
    + """select feed_id, slug, price, 'City ' || regexp_extract(formatted_address, 'City ([0-9]+)', 1) as city, cast(null as varchar) as known_city, 'Camden' as neighborhood,
  'London' as second_city, postal_code as postal from listings where formatted_address is not null"""
)
def address_places(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, "feed_id", "slug", "price", "formatted_address", "postal_code").where(
        c("formatted_address").isNotNull()
    )
    gb = F.lit("GB")
    second = F.concat_ws(", ", F.lit("7 Mill Road"), F.lit("Camden "), F.lit("UK"), F.lit("Greater  London"), "postal_code")
    rows = bind(rows, _whole=place.formatted_place(second, gb))
    whole = c("_whole")
    return rows.select(
        "feed_id", "slug", "price", place.city_from_address(c("formatted_address"), gb).alias("city"),
        place.formatted_place(c("formatted_address"), gb)["city"].alias("known_city"),
        whole["neighborhood"].alias("neighborhood"), whole["city"].alias("second_city"), whole["postal_code"].alias("postal"),
    )


@query(
    """select l_orderkey, l_linenumber, l_extendedprice as price, 'Leeds' as city, 'BH' || (l_suppkey % 9 + 1) || ' ' || (l_partkey % 9 + 1) || 'AB' as postal_code from lineitem"""
)
def uk_places(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_extendedprice as price",
        "concat('Hall, ', l_partkey % 90, ' Sea Road, LEEDS. ,bh', l_suppkey % 9 + 1, l_partkey % 9 + 1, 'ab, UK') as address",
    )
    return rows.withColumn("_p", place.uk_city_and_postcode(c("address"))).select(
        "l_orderkey", "l_linenumber", "price", "_p.city", "_p.postal_code"
    )


# Known places: one per nation and city of the views, by rounded pin.
@query(
    CTES
    + """, places as (select distinct 'rev:' || printf('%.4f,%.4f', lat, lng) as fingerprint, 'Town ' || city as city, 'NZ' as country from listings where lat is not null and cast(lat as int) % 3 = 0)
select l.feed_id, l.slug, l.price, coalesce(case when lower(l.city) <> 'online' then l.city end, p.city) as city, coalesce(l.country, p.country) as country
from listings l left join (select fingerprint, min(city) as city, min(country) as country from places group by fingerprint) p
  on p.fingerprint = 'rev:' || printf('%.4f,%.4f', l.lat, l.lng) and (l.country is null or l.city = 'online')
where l.lat is not null"""
)
def place_completion(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf).where(c("lat").isNotNull()).withColumn("state", F.lit(None).cast("string"))
    known = listings(spark, sf, "lat", "lng", "city").where(F.round("lat").isNotNull() & (c("lat").cast("int") >= -1000))
    known = known.where(F.pmod(F.rint("lat").cast("int"), F.lit(3)) == 0)
    places = known.groupBy(place.reverse_key(c("lat"), c("lng")).alias("fingerprint")).agg(
        F.min(F.concat(F.lit("Town "), "city")).alias("city")
    )
    places = places.select(
        "fingerprint", "city", F.lit(None).cast("string").alias("neighborhood"), F.lit(None).cast("string").alias("state"),
        F.lit("NZ").alias("country"), F.lit(None).cast("string").alias("postal_code"),
    )
    rows = rows.withColumns({"neighborhood": F.lit(None).cast("string")})
    return clean.complete_places(rows, places).select("feed_id", "slug", "price", "city", "country")


@query(
    CTES
    + """, kept as (select feed_id, count(*) as n from listings where attendance <> 'online' and lat < 0 group by feed_id)
select l.feed_id, case when max(k.n) is null then 'error' else 'written' end as outcome, coalesce(max(k.n), 0) as n from listings l left join kept k on k.feed_id = l.feed_id group by l.feed_id"""
)
def feed_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, "feed_id", "attendance", "lat")
    return sinks.feed_results(rows, rows.where((c("attendance") != "online") & (c("lat") < 0))).select("feed_id", "outcome", "n")


# --- discovery -----------------------------------------------------------------------------


@query(
    CTES
    + """, probes as (select concat('feed-', l_suppkey) as id, cast(l_linenumber as int) as candidate_pos, min(concat('u', l_linenumber)) as url,
  count(*) filter (where l_returnflag = 'R') > 40 as ok, count(*) as count from lineitem group by 1, 2),
best as (select id, min(candidate_pos) as pos from probes where ok group by id)
select f.id, case when f.status = 'disabled' then 'missing' when b.id is not null then 'ok' else 'disable' end as outcome,
  case when f.status <> 'disabled' then p.url end as working_url, case when f.status <> 'disabled' then p.count end as count
from feeds f left join best b on b.id = f.id left join probes p on p.id = b.id and p.candidate_pos = b.pos"""
)
def probe_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag")
    probes = line.groupBy(F.concat(F.lit("feed-"), "l_suppkey").alias("id"), c("l_linenumber").alias("candidate_pos")).agg(
        F.min(F.concat(F.lit("u"), "l_linenumber")).alias("url"), (F.count_if(c("l_returnflag") == "R") > 40).alias("ok"),
        F.count("*").alias("count"),
    )
    source = feeds(spark, sf)
    return feed_ops.probe_outcomes(source.select("id"), source.where(c("status") != "disabled"), probes)


@query(
    r"""with live as (select page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\.', '') as host from pages)
select host, trim(regexp_replace(host, '[^a-z0-9]+', '-', 'g'), '-') || case when nth = 1 then '' else '-' || nth end as id
from (select host, row_number() over (partition by host order by page_id) as nth from (select distinct host, page_id from live))"""
)
def discovered_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as a live feed of its host: which of a host's numbers a page gets follows no order, so ids go with the host."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)), r"^www\.", "")
    live = table(spark, sf, "pages").select(
        slugify(host).alias("id"), F.concat(F.lit("https://"), host, F.lit("/feed/"), "page_id").alias("url"), host.alias("name"),
        F.lit("US").alias("region_hint"), F.lit("aa").alias("fellowship"), F.lit("tsml").alias("format"),
    ).withColumn("resolved_url", c("url"))
    found = feed_ops.accept_discovered(live, feeds(spark, sf))
    return found.select(F.regexp_extract("url", "^https://([^/]+)", 1).alias("host"), "id")


@query(
    r"""with homes as (select distinct 'g' || (page_id % 60) as slug from pages), covered as (select 'g' || (s_suppkey % 25) as slug from supplier)
select 'aa-' || slug as id, 'https://x.example.org/intergroups/' || slug as url from homes where slug not in (select slug from covered)"""
)
def new_intergroups(spark: SparkSession, sf: str) -> DataFrame:
    slug = F.concat(F.lit("g"), c("page_id") % 60)
    homes = table(spark, sf, "pages").select(
        F.concat(F.lit("aa-"), slug).alias("id"), slug.alias("name"),
        F.concat(F.lit("https://www.x.example.org/intergroups/"), slug, F.lit("/")).alias("url"),
    )
    stored = feeds(spark, sf).withColumn(
        "url", F.concat(F.lit("https://y.example.org/intergroups/g"), F.split("id", "-")[1].cast("int") % 25)
    )
    return feed_ops.new_intergroups(homes, stored).select("id", "url")


@query(
    "select event_id, case event_type when 'click' then 'na' else 'aa' end as fellowship, case event_type when 'view' then 'ukna' else 'tsml' end as format, "
    "cast(case when user_id % 2 = 0 then user_id else 0 end as int) as meeting_count from events where user_id % 3 <> 0"
)
def claimed_rows(spark: SparkSession, sf: str) -> DataFrame:
    loose = table(spark, sf, "events").selectExpr(
        "cast(event_id as string) as id", "case when user_id % 3 = 0 then null else 'n' end as name", "'u' as url", "'x' as region_hint",
        "case event_type when 'click' then 'na' when 'view' then 'zz' end as fellowship", "case event_type when 'view' then 'ukna' end as format",
        "cast(null as string) as status", "'soon' as last_attempt_at", "'2024-01-01 00:00:00' as last_ok_at", "cast(null as string) as last_error",
        "case when user_id % 2 = 0 then cast(user_id as string) else 'many' end as meeting_count", "'e' as etag", "'m' as last_modified",
        "cast(null as string) as leased_until",
    )
    rows = feed_ops.coerce_claimed(loose)
    return rows.select(
        c("id").cast("bigint").alias("event_id"), as_fellowship(c("fellowship")).alias("fellowship"),
        as_feed_format(c("format")).alias("format"), "meeting_count",
    )


# --- clocks --------------------------------------------------------------------------------


@query(
    CTES
    + f"""select feed_id, slug, price, case when time is null then 'Time TBA' else (case when cast(substr(time, 1, 2) as int) % 12 = 0 then 12 else cast(substr(time, 1, 2) as int) % 12 end)
  || ':' || substr(time, 4, 2) || case when cast(substr(time, 1, 2) as int) >= 12 then ' pm' else ' am' end end as caption,
  case when day is not null and time is not null then timestamp '2001-11-04 00:00:00' + to_days(cast(case when day = 0 then 7 else day end as int)) + to_minutes(cast({_MIN} as bigint)) end as starts_at
from listings"""
)
def next_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, "feed_id", "slug", "price", "day", "time", "end_time")
    slot = clock.next_occurrence(c("day"), c("time"), c("end_time"), clock.at(NOW), F.lit("UTC"))
    return rows.select("feed_id", "slug", "price", clock.format_time(c("time")).alias("caption"), slot["starts_at"].alias("starts_at"))


