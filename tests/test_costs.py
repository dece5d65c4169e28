"""Expressions read their input as often as they need it, which a plan shows, and not once more for every use of a part."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekgrid.functions import base, clock, place
from weekgrid.operators.nearby import within_radius
from weekgrid.operators.versions import Change, Layout, Store
from weekgrid.sources import dialects, pages
from weekgrid.streaming.ingest import extract_items

c = F.col


def uses(spark, pattern: str, frame, plan: str = "optimizedPlan") -> int:
    """How often a text stands in a plan of a frame."""
    return len(re.findall(pattern, getattr(frame._jdf.queryExecution(), plan)().toString()))


def texts(spark, *values: str):
    return spark.createDataFrame([(v,) for v in values], "t string")


def test_squeeze_and_strip_know_all_white_space(spark):
    blank = "\t  　﻿\n"
    rows = texts(spark, f"{blank}a{blank}b  c d{blank}").select(base.squeeze(c("t")).alias("s"), base.strip(c("t")).alias("p"))
    assert rows.first() == ("a b c d", f"a{blank}b  c d")


def test_printed_clock_and_notes_read_their_text_once_a_part(spark):
    """hour, minutes and half day were matched again at each use, the remarks' text six times."""
    rows = texts(spark, "Time: 8.30pm to 9.45pm Duration: 1 hour (side door)")
    start = clock.labelled_clock(c("t"))
    assert uses(spark, "time.s", rows.select(start.alias("v"))) == 3
    assert uses(spark, "postcode:", rows.select(pages.slot_notes(c("t"), c("t"), F.array().cast("array<string>")).alias("v"))) == 1
    assert rows.select(start, clock.end_clock(c("t"), start)).first()[:] == ("20:30", "21:45")


def test_print_list_splits_at_marks(spark):
    text = "MONDAY Ash Hall, 5 Quay St, Poole. Time: 7pm Duration: 1 hour. Elm Group, 9 Sea Road, Poole. Time: 8pm TUESDAY Time: 9pm Tradition 7 Time: 10pm"
    rows = pages.print_list(texts(spark, text).select(F.lit(1).alias("k"), c("t").alias("text")), ["k"]).orderBy("pos")
    assert [(r.day, r.time, r.name) for r in rows.select("day", "time", "name").collect()] == [(1, "19:00", "Ash Hall"), (1, "20:00", "Elm Group")]


def test_address_parts_ask_each_question_once(spark):
    """a part's postcode was read again at each look, and a candidate city cleaned for every test of it."""
    rows = texts(spark, "7 Mill Road, Camden , UK, Greater  London, BH1 2AB")
    whole = place.formatted_place(c("t"), F.lit("GB"))
    assert uses(spark, re.escape(place.ZIP[1:]), rows.select(whole.alias("v"))) <= 10
    assert uses(spark, re.escape(r"\s+[A-Z]{2}(?:\s+\d.*)?$"), rows.select(place.city_from_address(c("t"), F.lit("GB")).alias("v"))) == 1
    assert rows.select(whole.alias("v")).first().v[1:] == ("London", "Camden", "BH1 2AB")


@pytest.mark.parametrize("label, city, hood", [
    ("Leeds", True, True), ("NY", False, False), ("ny", False, False), ("Nyx", True, True), ("NSW", False, False), ("A", False, False),
    ("90210", False, False), ("CA 90210", False, False), ("Ca 9", True, True), ("K1A 0B1", False, False), ("BH1 2AB", False, False), ("SW1", False, False),
    ("12 Docks", False, True), ("North / South", False, False), ("Online", False, False), ("Onliner", True, True), ("x" * 80, True, True), ("x" * 81, False, False),
])
def test_usable_labels(one, label, city, hood):
    assert one(place.is_usable_city(c("t")), t=label) is city
    assert one(place.is_usable_neighborhood(c("t")), t=label) is hood


def test_card_lines_match_once(spark):
    """the four groups of a line were matched anew at each use, before and after the filter."""
    html = "<h2>Elm</h2>Monday / 9:05 – 10:30 / Hall, LEEDS<br>tuesday / 25:00 / Nowhere<br>Friday / 8:00"
    found = pages.card_lines(texts(spark, html).select(F.lit(1).alias("k"), c("t").alias("html")), ["k"])
    assert uses(spark, re.escape("(?:\\s*[–—-]\\s*(\\d{1,2}:\\d{2}))?(?:\\s*/"), found) <= 3
    assert [r[:] for r in found.select("name", "day", "time", "end_time", "city").collect()] == [("Elm", 1, "09:05", "10:30", "Leeds")]


def test_weekday_sections_read_their_text_once_a_part(spark):
    """an address, a postcode and the open or closed remark were worked out again at each use."""
    html = "<h3>Monday</h3><p>Elm*<br>St Mary, 5 High St, Poole<br>Time: 7.30pm, Duration: 1 hour. Postcode: BH1 2AB. All meetings are open</p><h3>Notes</h3><p>Time: 8pm</p>"
    found = pages.weekday_sections(texts(spark, html).select(F.lit(1).alias("k"), c("t").alias("html")), ["k"])
    assert uses(spark, "all meetings", found) == 1
    row = found.select("name", "day", "time", "end_time", "postal_code", "city", "location", F.array_join("types", ",")).first()
    assert row[:] == ("Elm", 1, "19:30", "20:30", "BH1 2AB", "Poole", "St Mary", "O")


def test_table_cells_are_cut_by_one_sign_classes(spark):
    """cells were cut with a union of two classes, and a clock matched again at each use."""
    cells = ("Monday", "9:30 start", "<b>Elm</b>", "Hall", "1 High St, Leeds, BH1 2AB", "-", "-", "Open, x", "51.5", "-0.1")
    html = "<table><TR>" + "".join(f"<td\n>{v}</td>" for v in cells) + "</tr><tr><td>short</td></tr></table>"
    found = pages.table_rows(texts(spark, html).select(F.lit(1).alias("k"), c("t").alias("html")), ["k"])
    assert uses(spark, re.escape("[\\s\\S]"), found) == 0
    assert uses(spark, re.escape("(\\d{1,2}):(\\d{2})"), found) <= 2
    assert found.select("name", "day", "time", "city", "postal_code", "latitude").first()[:] == ("Elm", 1, "09:30", "Leeds", "BH1 2AB", 51.5)


def test_line_list_reads_each_line_s_postcode_once(spark):
    """the lines behind a weekday were searched for a postcode twice, and twice over for each use of it."""
    html = "<h2>Elm</h2><p>Monday</p><li>9:30 ~ 10:15</li><div>Hall</div><div>12 High Street, Poole, Dorset</div><td>at BH1 2AB</td><td>BH3 4CD</td>"
    found = pages.line_list(texts(spark, html).select(F.lit(1).alias("k"), c("t").alias("html")), ["k"])
    assert uses(spark, re.escape("([A-Z]{1,2}\\d[A-Z\\d]?\\s*\\d[A-Z]{2})"), found.select("k")) <= 4
    assert found.select("name", "time", "end_time", "city", "postal_code").first()[:] == ("Elm", "09:30", "10:15", "Poole", "BH3 4CD")


def test_listings_within_radius_are_never_shuffled(spark):
    """each listing was shuffled once per grid in use."""
    listings = spark.range(60).selectExpr("id", "51 + id % 10 / 20e0 as lat", "id / 30e0 as lng")
    origins = spark.range(9).selectExpr("id as origin_id", "51e0 + id / 20 as lat", "id / 5e0 as lng", "case when id = 3 then 900e0 else 4e0 * id end as radius_km")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = within_radius(listings, origins)
        assert uses(spark, "hashpartitioning", whole, "executedPlan") == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    found = sorted(tuple(r) for r in whole.select("id", "origin_id").collect())
    assert len(found) > 60 and found == sorted(tuple(r) for r in within_radius(listings, origins, cover_rows=5).select("id", "origin_id").collect())


def shuffle_files(spark) -> set[str]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p.name for d in folders for p in Path(d).rglob("shuffle_*.data")}


def test_commits_leave_no_shuffle_files(spark, tmp_path):
    """the shuffle files of every commit and staged table stayed until the driver happened to collect its garbage."""
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])
    store = Store(spark, str(tmp_path / "store"), {"t": Layout(schema, ("k",), 4)})
    before = shuffle_files(spark)
    base = store.commit(store.snapshot(), {"t": Change(spark.range(100).selectExpr("id as k", "id as v"))})
    part = spark.range(200).repartition(5).groupBy((c("id") % 50).alias("k")).agg(F.sum("id").alias("v"))
    after = store.commit(base, {"t": Change(part, part.select("k"))}).read("t")
    assert shuffle_files(spark) <= before
    assert after.count() == 100 and after.where("k < 50").agg(F.sum("v")).first()[0] == sum(range(200))


def test_a_whole_table_is_written_from_where_its_rows_are(spark, tmp_path):
    """the first load of a table was shuffled once more on its way to the buckets."""
    schema = T.StructType([T.StructField("k", T.LongType())])
    store = Store(spark, str(tmp_path / "store"), {"t": Layout(schema, ("k",), 2)})
    rows = spark.range(0, 300, 1, 3).withColumnRenamed("id", "k")
    after = store.commit(store.snapshot(), {"t": Change(rows)})
    assert sorted(len(list(Path(f).glob("*.parquet"))) for f in after.folders("t")) == [3, 3]
    assert after.read("t").distinct().count() == 300


def test_json_fields_are_looked_up_once(spark):
    """each field of an item was looked up in the variant again for its kind, its text and its number."""
    rows = texts(spark, '{"meeting_name": "Elm", "id_bigint": 7, "weekday_tinyint": "3", "start_time": " 9:30:00 ", "time_zone": 1.50, "latitude": "51.5", "longitude": -1}')
    items = rows.select(F.lit("f").alias("feed_id"), F.lit("aa").alias("fellowship"), F.lit(0).alias("pos"), F.parse_json("t").alias("raw"))
    found = dialects.parse_bmlt(items)
    shown = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        assert uses(spark, re.escape("$.time_zone"), found.select("timezone")) == 1
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", shown)
    assert found.select("name", "slug", "day", "time", "timezone", "lat", "lng").first()[:] == ("Elm", "7-elm", 2, "09:30", "1.5", 51.5, -1.0)


def test_layouts_and_dialects_without_rows_are_not_planned(spark, monkeypatch):
    """every batch planned four page layouts and three dialects, whatever its payloads were."""
    planned = []
    for module, name in ((pages, "table_rows"), (pages, "line_list"), (pages, "print_list"), (pages, "intergroup_pages"), (dialects, "parse_bmlt"), (dialects, "parse_oiaa")):
        made = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _made=made, _name=name, **k: planned.append(_name) or _made(*a, **k))
    columns = "feed_id string, name string, url string, fellowship string, format string, region_hint string, content_type string, body string"

    def read(*payloads):
        rows = spark.createDataFrame([(f, "Elm", "https://x.org/", "aa", f, None, None, body) for f, body in payloads], columns)
        items = extract_items(rows)
        return sorted(r[:] for r in dialects.parse_items(items).select("feed_id", "name").collect())

    listed = ("tsml", '[{"name": "Ash", "slug": "a"}]')
    assert read(listed) == [("tsml", "Ash")] and planned == []
    page = ("cauk", "<tr>" + "".join(f"<td>{v}</td>" for v in ("Monday", "9:30", "Elm", "Hall", "1 High St, Leeds", "-", "-", "Open", "51.5", "-0.1")) + "</tr>")
    assert read(listed, page) == [("cauk", "Elm"), ("tsml", "Ash")] and planned == ["table_rows"]
    assert read(("tsml", "[]")) == []
