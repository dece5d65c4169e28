"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = (
    "coverage_cells", "safe_listings", "collapse_duplicates", "rank_nearby", "place_unique_rank", "audit_counts", "city_search",
    "online_page", "vector_plan", "catalog_merge", "json_route", "geocode_completion", "simple_city_rollup", "slice_rows",
    "print_pages", "mapping_anomalies", "geocode_queries", "slice_cells", "keyword_documents", "slugs", "feed_candidates",
    "discovered_feeds", "vector_topk_many", "city_prefixes", "online_after", "rank_saved", "feed_replace", "vector_apply",
    "slice_read", "region_hints", "place_keys", "listing_days", "list_payload", "rebuild_plans",
)


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("tables are not here")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return db


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in frame.collect()]
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    order = lambda rows: sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert order(got) == order(want)
