from __future__ import annotations

import unicodedata
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weekgrid.functions import clock, geo, html, labels, notes, place, text, urls

c = F.col
NOW = datetime(2026, 9, 16, 19, 0)  # a Wednesday


def folded(value: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", value) if not 0x300 <= ord(x) <= 0x36F)


SAMPLES = ["plain", "Ñandú  Ünïcode", "ﬁne ½ ㎏ №", "각 나다", "が ﷺ", "①②Ⅳ", "ŁÓDŹ", "𝐀𝐁", "", "日本語"]


def test_fold_is_compatibility_decomposition_without_marks(spark):
    rows = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    got = [r.v for r in rows.select(text.fold_marks(c("s")).alias("v")).collect()]
    assert got == [folded(s) for s in SAMPLES]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cc"), max_codepoint=0x1FFFF), max_size=12), min_size=1, max_size=60))
def test_fold_property(spark, values):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(values)], "i int, s string")
    out = rows.select("i", text.fold_marks(c("s")).alias("v"), text.slugify(c("s")).alias("a"), text.slugify(text.slugify(c("s"))).alias("b"))
    for r in out.collect():
        assert sorted(r.v) == sorted(folded(values[r.i]))
        assert r.b == r.a.strip("-")


def test_slugs_differ_on_accents(one):
    assert one(text.slugify(c("s")), s="--Café & Łódź--") == "cafe-odz"
    assert one(text.alnum_slug(c("s")), s="--Café & Łódź--") == "café-łódź"
    assert len(one(text.slugify(c("s")), s="x" * 200)) == 80


def test_no_pin_has_no_cell(spark):
    rows = spark.createDataFrame([(None, 1.0), (1.0, None), (None, None)], "lat double, lng double")
    assert {r.g for r in rows.select(geo.geohash4(c("lat"), c("lng")).alias("g")).collect()} == {None}


def test_geohash_and_ring(one):
    assert one(geo.geohash4(c("lat"), c("lng")), lat=51.5072, lng=-0.1276) == "gcpv"
    ring = one(geo.neighbors(c("g")), g="gcpv")
    assert ring[0] == "gcpv" and len(set(ring)) == 9
    assert set(one(geo.neighbors(c("g")), g="zzzz")) == {"zzzz", "bpbp", "bpbn", "zzzy", "zzzw", "zzzx"}


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-89, 89), st.floats(-180, 180)), min_size=1, max_size=40))
def test_ring_is_symmetric_and_explodes_alike(spark, points):
    rows = spark.createDataFrame(points, "lat double, lng double").select(geo.geohash4(c("lat"), c("lng")).alias("g"))
    near = rows.select("g", F.explode(geo.neighbors(c("g"))).alias("n"))
    assert near.where(~F.array_contains(geo.neighbors(c("n")), c("g"))).count() == 0
    flat = geo.explode_ring(rows.distinct(), "g", "cell")
    arrays = rows.distinct().select("g", F.explode(geo.neighbors(c("g"))).alias("cell"))
    assert sorted(map(tuple, flat.select("g", "cell").collect())) == sorted(map(tuple, arrays.collect()))
    assert flat.where(~geo.is_adjacent(c("g"), c("cell"))).count() == 0


def test_haversine(one):
    there = one(geo.haversine_km(c("a"), c("b"), c("x"), c("y")), a=51.5, b=-0.1, x=48.85, y=2.35)
    back = one(geo.haversine_km(c("x"), c("y"), c("a"), c("b")), a=51.5, b=-0.1, x=48.85, y=2.35)
    assert there == pytest.approx(341.4, abs=2) and there == pytest.approx(back)
    assert [one(geo.format_distance(c("d")), d=d) for d in (0.5, 3.26, 12.5)] == ["500 m", "3.3 km", "13 km"]


PLACES = [
    (("90210", "X", None, None, "usa"), (None, None, None, "90210", "US")),
    (("North London", None, None, None, "UK"), ("London", "North London", None, None, "GB")),
    (("CA", None, "Los Angeles", None, "United States"), ("Los Angeles", None, "CA", None, "US")),
    (("Camden", None, "London", None, "gb"), ("London", "Camden", None, None, "GB")),
    (("SW1A 1AA", "12 Area", "Kent", None, None), ("Kent", "Area", None, "SW1A 1AA", None)),
    (("BOSTON, ", None, "MA 02139", None, "U.S.A."), ("BOSTON", None, "MA", "02139", "US")),
    (("12 Shore / Bay", None, "Ohio", None, "US"), (None, None, "Ohio", None, "US")),
    (("York", "york", "York", None, "GB"), ("York", None, None, None, "GB")),
    (("online", None, None, None, None), (None, None, None, None, None)),
]


def test_place_normalisation(spark):
    rows = spark.createDataFrame(
        [(i, *given) for i, (given, _) in enumerate(PLACES)],
        "i int, city string, neighborhood string, state string, postal_code string, country string",
    )
    out = place.normalize_place(rows).orderBy("i").select("city", "neighborhood", "state", "postal_code", "country")
    assert [tuple(r) for r in out.collect()] == [wanted for _, wanted in PLACES]


def test_formatted_address(one):
    got = one(place.formatted_place(c("a"), c("k")), a="3 Hall Road, Camden, UK, Greater London, NW1 8AA", k="GB")
    assert (got.city, got.neighborhood, got.postal_code) == ("London", "Camden", "NW1 8AA")
    near_street = one(place.formatted_place(c("a"), c("k")), a="Camden, 3 Hall Road, London", k="GB")
    assert (near_street.city, near_street.neighborhood) == ("London", None)
    assert one(place.city_from_address(c("a"), c("k")), a="Church, Boston MA 02139, USA", k="US") == "Boston"


def test_region_hint(one):
    assert tuple(one(place.region_hint(c("h")), h="us-ca")) == ("US", "CA")
    assert tuple(one(place.region_hint(c("h")), h="ONLINE")) == (None, None)


def test_zones(one):
    zone = lambda **v: one(clock.listing_zone(c("z"), c("lat"), c("lng"), c("k"), c("s"), (51.5, -0.1)), **v)
    assert zone(z="America/New_York", lat=51.5, lng=0.0, k="GB", s="x") == "America/New_York"
    assert zone(z="UTC", lat=40.7, lng=-74.0, k="US", s="NY") == "America/New_York"
    assert zone(z="Not/AZone", lat=-80.0, lng=0.0, k="US", s="CA") == "America/Los_Angeles"
    assert zone(z="UTC", lat=-80.0, lng=0.0, k="XX", s="x") == "Europe/London"
    assert zone(z="", lat=-80.0, lng=0.0, k="US", s="MI") == "America/Detroit"


def test_every_valid_zone_is_known_to_the_engine(spark):
    import zoneinfo

    names = spark.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones()) + ["No/Zone"]], "z string")
    rows = names.select("z", clock.local_day_and_time(F.timestamp_micros(F.lit(0)), c("z"))["time"].alias("t")).collect()
    assert len(rows) > 400 and all(r.t for r in rows)


def test_local_day_and_time(one):
    at = clock.at(datetime(2026, 9, 18, 13, 30))
    assert tuple(one(clock.local_day_and_time(at, F.lit("America/New_York")))) == (5, "09:30")
    assert tuple(one(clock.local_day_and_time(at, F.lit("bad")))) == (5, "13:30")


def test_next_occurrence(one):
    slot = one(clock.next_occurrence(c("d"), c("t"), c("e"), clock.at(NOW), F.lit("Europe/London")), d=3, t="19:30", e="01:00")
    assert slot.starts_at == datetime(2026, 9, 23, 18, 30) and slot.ends_at == datetime(2026, 9, 24, 0, 0)


def test_clock_texts(one):
    assert one(clock.add_minutes(c("t"), F.lit(90)), t="23:00") == "00:30"
    assert one(clock.labelled_clock(c("t")), t="Time: 7.30pm") == "19:30"
    assert one(clock.labelled_duration(c("t")), t="Duration: 1 hour 15 mins") == 75
    assert one(clock.end_clock(c("t"), F.lit("19:00")), t="7pm to 8.30") == "20:30"
    assert one(clock.format_time(c("t")), t="00:05") == "12:05 am"
    until = lambda m, d: one(clock.format_until(c("m"), F.lit(False), c("d")), m=m, d=d)
    assert [until(0, 0), until(45, 0), until(125, 0), until(1500, 1), until(5000, 3)] == [
        "Starting now", "in 45 min", "in 2h 5m", "tomorrow", "in 3 days",
    ]


def test_note_types(one):
    got = one(notes.with_note_types(F.array(F.lit("O")), c("n"), c("l")), n="Beginner welcome", l="Wheelchair accessible")
    assert got == ["O", "BE", "X"]
    assert one(notes.with_note_types(F.array(F.lit("B")), c("n"), c("l")), n="Beginners welcome", l="") == ["B"]


def test_urls(one):
    canon = lambda u: one(urls.canonical_url(c("u")), u=u)
    assert canon("HTTPS://www.Example.org/a/?x=1#f") == "https://example.org/a?x=1"
    assert canon("https://x.org/main_server/client_interface/json/?a=1&switcher=GetSearchResults&lat_val=5") == (
        "https://x.org/main_server/client_interface/json/?switcher=GetSearchResults&lat_val=5"
    )
    assert canon("not a url") == "not a url"
    problem = lambda u: one(urls.url_problem(c("u")), u=u)
    assert problem("https://example.org/x") is None
    assert problem("https://[fd00::1]/") == "private address"
    assert problem("https://x.localhost/") == "private host"
    assert problem("https://a:b@x.org/") == "not public https"
    assert one(urls.fallback_urls(c("u")), u="junk") == []


def test_html(one):
    assert one(html.text_lines(c("h")), h="<p>A &amp; B &#233;&#x1F600; &nope;<br/>y</p>") == ["A & B é😀 &nope;", "y"]
    assert one(html.page_lines(c("h")), h="<script>no</script><h2>T</h2><div>a  b</div>c") == ["## T", "a b", "c"]


def test_labels(one):
    assert one(labels.type_label(c("t")), t="BE") == "Newcomer"
    assert one(labels.type_label(c("t")), t="ZZ") == "ZZ"
    assert one(labels.as_feed_format(c("t")), t="zz") == "tsml"
