from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from weekgrid.operators import cities, clean, dedupe, feeds, notes, predicates, rank, slices
from weekgrid.schemas import FEEDS, LISTINGS

c = F.col
NOW = datetime(2026, 9, 16, 19, 0)
LONDON = (51.5072, -0.1276)


def listing(**over):
    base = dict(
        feed_id="f", slug="s", name="Serenity", day=3, time="20:00", end_time=None, timezone="Europe/London", types=["O"],
        attendance="in-person", fellowship="aa", location_name="Hall", address="1 High St", city="London", country="GB",
        formatted_address="1 High St, London", lat=51.51, lng=-0.12, geohash4="gcpv", source_verified_at=NOW,
    )
    return {**base, **over}


@pytest.fixture
def rows(spark):
    schema = StructType([*LISTINGS.fields, StructField("source_verified_at", TimestampType())])

    def make(*items):
        return spark.createDataFrame([tuple(listing(**i).get(n) for n in schema.names) for i in items], schema)

    return make


def groups(frame, filters, origin=LONDON):
    return {r.slug: r.group for r in rank.rank_listings(frame, filters, NOW, origin=origin).collect()}


def test_groups_by_time(rows):
    frame = rows(
        {"slug": "now", "time": "19:30", "end_time": "21:00", "name": "a"},  # 20:00 in London
        {"slug": "soon", "time": "21:00", "name": "b"},
        {"slug": "late", "time": "23:15", "name": "c"},
        {"slug": "over", "time": "09:00", "name": "d"},
        {"slug": "tomorrow", "day": 4, "time": "09:00", "name": "e"},
        {"slug": "none", "day": None, "name": "f"},
    )
    assert groups(frame, rank.Filters()) == {"now": "happening", "soon": "soon", "late": "later"}
    week = groups(frame, rank.Filters(day="any", week=True))
    assert week == {"now": "happening", "soon": "soon", "late": "later", "over": "week", "tomorrow": "week", "none": "week"}
    assert groups(frame, rank.Filters(day="any")) == {"now": "happening", "soon": "soon", "late": "later", "none": "other"}
    assert groups(frame, rank.Filters(day=4)) == {"tomorrow": "later"}


def test_order_and_counts(rows):
    frame = rows(
        {"slug": "b", "time": "21:00", "name": "b", "lat": 51.52}, {"slug": "a", "time": "21:00", "name": "a"},
        {"slug": "c", "time": "20:00", "name": "c"},
    )
    assert [r.slug for r in rank.rank_listings(frame, rank.Filters(), NOW, origin=LONDON).collect()] == ["c", "a", "b"]
    counts = rank.group_counts(rank.ranked(frame, rank.Filters(), NOW, origin=LONDON))
    assert {r.group: r.n for r in counts.collect()} == {"happening": 1, "soon": 2, None: 3}


def test_keyword_and_semantic_hits(spark, rows):
    frame = rows({"slug": "x", "name": "Café  Hope", "notes": "step"}, {"slug": "y", "name": "Other"})
    hit = lambda q, keys=None: {r.slug for r in rank.keyword_filter(frame, q, keys).collect()}
    assert hit(" CAFE   step ") == {"x"} and hit("open") == {"x", "y"} and hit("zz") == set()
    assert hit("zz", spark.createDataFrame([("f", "y")], "feed_id string, slug string")) == {"y"}


def test_radius_keeps_unlocated(rows):
    frame = rows({"slug": "far", "lat": 40.0, "name": "a"}, {"slug": "none", "lat": None, "lng": None, "name": "b"})
    assert set(groups(frame, rank.Filters(day="any", week=True))) == {"none"}


def test_collapse_prefers_the_richer_row_whatever_the_order(rows):
    items = [
        {"slug": "b", "notes": "n"}, {"slug": "a"}, {"slug": "z", "feed_id": "g", "source_verified_at": NOW - timedelta(1)},
        {"slug": "other", "location_name": "Elsewhere"},
    ]
    for seed in range(3):
        random.Random(seed).shuffle(items)
        assert {r.slug for r in dedupe.collapse_duplicates(rows(*items)).collect()} == {"b", "other"}


def test_first_by_limits_before_the_shuffle(spark):
    frame = spark.range(1000).select((c("id") % 3).alias("k"), "id")
    plan = dedupe.first_by(frame, ["k"], c("id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_top_by_and_numbering_are_exact_on_a_hot_key(spark):
    frame = spark.range(5000).select(F.when(c("id") % 3 == 0, c("id") % 7).otherwise(-1).alias("k"), "id")
    top = dedupe.top_by(frame, ["k"], 40, c("id")).toPandas()
    want = frame.toPandas().sort_values("id").groupby("k").head(40)
    assert sorted(map(tuple, top[["k", "id"]].values)) == sorted(map(tuple, want[["k", "id"]].values))
    numbered = dedupe.numbered(frame, "k", c("id"), "n").toPandas()
    for _, part in numbered.groupby("k"):
        assert sorted(part.n) == list(range(1, len(part) + 1))


def test_slice_cap_flags_truncation(spark):
    frame = spark.range(50).select(F.when(c("id") < 45, "aaaa").otherwise("bbbb").alias("cell"), F.lit("f").alias("feed_id"), F.format_string("%03d", "id").alias("slug"))
    got = slices.cap_slices(frame, 10).groupBy("cell", "truncated").agg(F.count("*").alias("n"), F.max("slug").alias("m")).collect()
    assert {(r.cell, r.truncated, r.n, r.m) for r in got} == {("aaaa", True, 10, "009"), ("bbbb", False, 5, "049")}


def test_suggestions_collapse_greedily(spark):
    schema = "slug string, label string, state string, country string, lat float, lng float, geohash4 string, meeting_count bigint, parent_label string, aliases array<string>"
    data = [
        ("a", "Leeds", "X", "GB", 53.8, -1.5, "gcwf", 50, None, ["Leeds"]),
        ("b", "leeds", None, "UK", 53.9, -1.5, "gcwf", 40, None, ["Leeds"]),
        ("c", "Leeds", "X", "GB", 51.0, -1.5, "gcpc", 30, None, ["Leeds"]),
        ("d", "X", "Leeds", "GB", 53.8, -1.5, "gcwf", 20, None, ["Leeds"]),
        ("e", "Leeds", "X", "GB", None, None, None, 10, None, ["Leeds"]),
    ]
    found = cities.search_cities(spark.createDataFrame(data, schema), "leeds")
    assert [r.slug for r in found.collect()] == ["a", "c", "e"]  # no coordinates, near nothing


def test_venue_pins_ignore_other_feeds(rows):
    frame = rows({"slug": "a", "postal_code": "BH1 1AA"}, {"slug": "b", "postal_code": "bh11aa", "lat": None, "lng": None, "geohash4": None},
                 {"slug": "c", "feed_id": "g", "postal_code": "BH1 1AA", "lat": None, "lng": None, "geohash4": None}).withColumn("pos", F.lit(0))
    got = {r.slug: (r.lat, r.geohash4) for r in clean.borrow_pins(frame, "pos").collect()}
    assert got == {"a": (51.51, "gcpv"), "b": (51.51, "gcpv"), "c": (None, None)}


def test_rows_that_turn_online_get_their_citys_cell(rows):
    frame = rows({"slug": "a", "lat": None, "lng": None, "geohash4": None, "conference_url": "https://m.example.org/1", "attendance": "in-person",
                  "city": "Poole", "state": None, "country": "GB", "postal_code": "BH9 9ZZ"})
    known = frame.sparkSession.createDataFrame([("Poole, GB", 50.7, -2.0)], "query string, lat double, lng double")
    once = predicates.keep_rules(clean.complete_pins(frame, known))
    done = clean.complete_pins(once, known).first()
    assert (once.first().geohash4, done.attendance, done.lat, len(done.geohash4)) == (None, "online", None, 4)


def test_cache_keeps_the_first_row_of_a_key(spark):
    batch = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)] * 3, "k string, v int").repartition(5)
    cache = spark.createDataFrame([("b", 1, None)], "k string, v int, cached_at timestamp")
    assert [(r.k, r.v) for r in clean.cache_append(cache, batch, "k", NOW).collect()] == [("a", 1)]


def test_limits_are_the_callers(spark):
    many = spark.range(500).select(F.format_string("f%03d", "id").alias("id"), F.lit(None).cast("timestamp").alias("last_attempt_at"), F.lit(None).cast("timestamp").alias("last_ok_at"))
    assert feeds.stale_first(many, 400).count() == 400 and feeds.stale_first(many, None).count() == 500


def test_vector_plan_and_apply(spark):
    listed = spark.createDataFrame([("f", "new", "a", None), ("f", "same", "b", None), ("f", "blank", " ", None)],
                                   "feed_id string, slug string, notes string, location_notes string")
    known = spark.createDataFrame([("f", "same", "b"), ("f", "blank", "x"), ("f", "gone", "x")], "feed_id string, slug string, t string")
    vectors = known.select("feed_id", "slug", F.sha2("t", 256).alias("content_hash"))
    plan = notes.vector_plan(listed, vectors)
    assert {(r.slug, r.action) for r in plan.collect()} == {("new", "embed"), ("blank", "delete"), ("gone", "delete")}


def test_freshness_bounds(spark):
    stamps = spark.createDataFrame([(0, NOW - timedelta(hours=48)), (1, NOW - timedelta(hours=48, seconds=1)), (2, None)], "i int, t timestamp")
    got = stamps.where(predicates.is_fresh(F.lit("ok"), c("t"), NOW)).collect()
    assert [r.i for r in got] == [0]


def test_new_ids_never_clash(spark):
    live = pd.DataFrame([("same", f"https://h.org/{i}", f"https://h.org/{i}", "h", "US", "aa", "tsml") for i in range(6)]
                        + [("own", "https://k.org/", "https://k.org/", "k", "US", "aa", "tsml")],
                        columns=["id", "url", "resolved_url", "name", "region_hint", "fellowship", "format"])
    stored = spark.createDataFrame([("h-org-3", "n", "https://z.org")], "id string, name string, url string")
    got = [r.id for r in feeds.accept_discovered(spark.createDataFrame(live), stored).collect()]
    assert len(set(got)) == 7 and "own" in got and "same" in got and "h-org-3" not in got


def test_catalog_upsert_revives_and_disables(spark):
    stored = spark.createDataFrame([tuple({"id": i, "name": i, "url": i, "status": s, "last_error": "e"}.get(n) for n in FEEDS.names)
                                    for i, s in (("a", "disabled"), ("b", "ok"), ("z", "ok"))], FEEDS)
    listed = spark.createDataFrame([("a", None), ("b", "disabled"), ("n", None)], "id string, s string").select(
        "id", c("id").alias("name"), c("id").alias("url"), F.lit("GB").alias("region_hint"), F.lit("aa").alias("fellowship"),
        F.lit("tsml").alias("format"), F.coalesce("s", F.lit("pending")).alias("status"), F.lit(False).alias("refresh"),
    )
    got = {r.id: (r.status, r.last_error) for r in feeds.upsert_catalog(stored, listed).collect()}
    assert got == {"a": ("pending", None), "b": ("disabled", "No public JSON feed"), "z": ("ok", "e"), "n": ("pending", None)}
