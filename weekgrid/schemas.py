"""Table schemas and policy constants."""

from __future__ import annotations

from pyspark.sql import types as T

# Policy limits.
FRESHNESS_HOURS = 48
CACHE_STALE_HOURS = 12
OLD_LISTING_DAYS = 90
SLICE_CAP = 1500
SUGGESTION_RADIUS_KM = 40.0
NOTE_SIMILARITY_MIN = 0.3
NOTE_HITS = 5
FINDER_NOTE_HITS = 12
FEED_PAGE = 20
MAX_REFS = 200
MAX_TOOL_ROWS = 8
ONLINE_LIMIT = 80
TOP_CITIES, TOP_CELLS, TOP_ANOMALIES = 200, 400, 100
ERROR_TEXT_MAX = 500
ERRORS_SHOWN = 20
STALE_RUN_MINUTES = 10

# Enumerations.
FELLOWSHIPS = ("aa", "na", "ca")
FEED_FORMATS = ("tsml", "bmlt", "oiaa", "aagb", "aagb-region", "cauk", "ukna")
GENERIC_CITIES = ("online", "virtual", "regional")

PLACE_COLUMNS = ("city", "neighborhood", "state", "postal_code", "country")


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "array<float>": T.ArrayType(T.FloatType()),
}


def _struct(text: str) -> T.StructType:
    """Schema from "name type, …", usable before a session exists."""
    fields = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


FEEDS = _struct(
    "id string, name string, url string, region_hint string, fellowship string, format string, "
    "status string, last_attempt_at timestamp, last_ok_at timestamp, last_error string, "
    "meeting_count int, etag string, last_modified string, leased_until timestamp"
)
ENTITIES = _struct(
    "id string, feed_id string, name string, phone string, email string, url string, "
    "location_text string, feedback_emails array<string>"
)
LISTING_TEXT = (
    "feed_id string, slug string, name string, group_name string, day int, time string, "
    "end_time string, timezone string, types array<string>, attendance string, fellowship string, "
    "location_name string, address string, city string, neighborhood string, state string, "
    "postal_code string, country string, formatted_address string, lat double, lng double, "
    "geohash4 string, conference_url string, conference_phone string, notes string, "
    "location_notes string, updated_at timestamp"
)
PARSED = _struct(
    LISTING_TEXT
    + ", entity_name string, entity_phone string, entity_email string, entity_url string, "
    "entity_location string, feedback_emails array<string>"
)
LISTINGS = _struct(LISTING_TEXT + ", verified_at timestamp, entity_id string")
CITIES = _struct(
    "slug string, label string, state string, country string, lat float, lng float, "
    "geohash4 string, meeting_count bigint, parent_label string, aliases array<string>"
)
CATALOG_STATE = _struct("id string, content_hash string, seeded_at timestamp")
RUNS = _struct(
    "id bigint, started_at timestamp, finished_at timestamp, feeds_ok int, feeds_fail int, "
    "meetings_upserted int, error_summary string, status string"
)
BATCHES = _struct(
    "run_id bigint, stream string, batch_id bigint, feeds_processed bigint, feeds_ok bigint, feeds_fail bigint, "
    "feeds_not_modified bigint, feeds_written bigint, meetings_upserted bigint, errors array<string>"
)
PENDING = _struct("kind string, geohash4 string, city string, state string, country string")
GEOCODES = _struct("query string, lat double, lng double, cached_at timestamp")
PLACES = _struct(
    "fingerprint string, city string, neighborhood string, state string, country string, "
    "postal_code string, aliases array<string>, confidence float, source string, cached_at timestamp"
)
NOTE_VECTORS = _struct(
    "feed_id string, slug string, content_hash string, geohash4 string, "
    "embedding array<float>, updated_at timestamp"
)
CATALOG_ITEM = _struct(
    "id string, name string, url string, regionHint string, fellowship string, format string, "
    "status string, refresh boolean"
)
LANDED = _struct(
    "feed_id string, url string, content_type string, etag string, last_modified string, "
    "fetched_at timestamp, body string"
)
