"""Feed bookkeeping: catalog merge, claims, state after a run, run log, cascades."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.functions.base import blank_null
from weekgrid.functions.clock import at
from weekgrid.functions.labels import as_feed_format, as_fellowship
from weekgrid.functions.text import slugify
from weekgrid.functions.urls import (
    canonical_url,
    guess_fellowship,
    guess_region,
    host_candidates,
    host_slug,
    info_url,
    search_url,
)
from weekgrid.operators.dedupe import first_by, numbered
from weekgrid.schemas import ERROR_TEXT_MAX, FEED_PAGE, FEEDS, STALE_RUN_MINUTES
from weekgrid.sources.pages import intergroup_slug

c = F.col

# Catalog ids that only repeat another feed, and the note on disabled feeds.
DUPLICATE_FEEDS = (
    "www-aa-london-com",
    "aa-london-com",
    "www-aa-org-nz",
    "www-memphis-aa-org",
    "www-oc-aa-org",
    "www-aamonterey-org",
    "www-ct-aa-org",
    "www-area74-org",
    "www-aavirginia-org",
    "www-area78-org",
)
DISABLED_ERROR = "No public JSON feed"


# --- catalog -------------------------------------------------------------------------------


def catalog_hash(general: Column, federated: Column) -> Column:
    """Content hash of the two catalog files."""
    return F.sha2(F.concat(general, F.lit("\0"), federated), 256)


def catalog_changed(state: DataFrame, new_hash: str, force: bool = False) -> bool:
    """Whether the stored hash differs; a one-row lookup by id."""
    if force:
        return True
    same = state.where((c("id") == "feeds") & (c("content_hash") == new_hash))
    return same.limit(1).count() == 0


def merge_catalog(general: DataFrame, federated: DataFrame) -> DataFrame:
    """One catalog row per canonical URL: general feeds before federated roots, in file order.

    Both inputs carry `pos`. Federated rows get the search address of their root.
    """
    text = lambda n: F.lit(None).cast("string").alias(n)
    first = general.select(
        "id", "name", canonical_url(c("url")).alias("url"), c("regionHint").alias("region_hint"),
        as_fellowship(c("fellowship")).alias("fellowship"), as_feed_format(c("format")).alias("format"),
        "status", F.coalesce("refresh", F.lit(False)).alias("refresh"), F.lit(0).alias("_source"), "pos",
    )
    second = federated.select(
        "id", "name", canonical_url(search_url(c("url"))).alias("url"), c("regionHint").alias("region_hint"),
        F.lit("na").alias("fellowship"), F.lit("bmlt").alias("format"),
        "status" if "status" in federated.columns else text("status"),
        F.lit(False).alias("refresh"), F.lit(1).alias("_source"), "pos",
    )
    rows = first_by(first.unionByName(second), ["url"], c("_source").asc(), c("pos").asc(), c("id").asc())
    return rows.withColumn(
        "status", F.when(c("status") == "disabled", "disabled").otherwise("pending")
    ).drop("_source", "pos")


def replaced_feeds(catalog: DataFrame, feeds: DataFrame) -> DataFrame:
    """Ids to delete: stored under another id than the catalog's for the same URL, or known repeats."""
    wanted = catalog.select(canonical_url(c("url")).alias("_url"), c("id").alias("_catalog"))
    wanted = wanted.groupBy("_url").agg(F.min("_catalog").alias("_catalog"))
    stored = feeds.select("id", canonical_url(c("url")).alias("_url"))
    moved = stored.join(wanted, "_url").where(c("id") != c("_catalog")).select("id")
    repeats = feeds.where(c("id").isin(*DUPLICATE_FEEDS)).select("id").join(catalog.select("id"), "id", "left_anti")
    return moved.union(repeats).distinct()


def upsert_catalog(feeds: DataFrame, catalog: DataFrame) -> DataFrame:
    """Feeds after seeding: descriptive fields overwritten, run state kept.

    A feed that was disabled and no longer is starts over as pending.
    """
    old = feeds.select(*[c(n).alias(f"old_{n}") for n in feeds.columns]).withColumn("_stored", F.lit(True))
    both = catalog.withColumn("_listed", F.lit(True)).join(old, c("id") == c("old_id"), "full")
    listed, stored = c("_listed").isNotNull(), c("_stored").isNotNull()
    disabled = c("status") == "disabled"
    revived = c("old_status") == "disabled"
    values = {n: c(f"old_{n}") for n in feeds.columns}
    for n in ("id", "name", "url", "region_hint", "fellowship", "format"):
        values[n] = F.when(listed, c(n)).otherwise(values[n])
    values["status"] = (
        F.when(listed & disabled, "disabled")
        .when(listed & (revived | ~stored), "pending")
        .otherwise(c("old_status"))
    )
    values["last_error"] = (
        F.when(listed & disabled, DISABLED_ERROR).when(listed & revived, None).otherwise(c("old_last_error"))
    )
    for n in ("etag", "last_modified", "last_attempt_at"):
        values[n] = F.when(~F.coalesce(c("refresh"), F.lit(False)), values[n])
    values["meeting_count"] = F.coalesce(values["meeting_count"], F.lit(0))
    return both.select(*[values[n].alias(n) for n in feeds.columns])


def new_intergroups(homes: DataFrame, feeds: DataFrame) -> DataFrame:
    """Feeds for discovered intergroups whose slug no stored feed covers."""
    found = homes.withColumn("slug", intergroup_slug(c("url"))).where(c("slug").isNotNull())
    covered = feeds.select(intergroup_slug(c("url")).alias("slug")).where(c("slug").isNotNull()).distinct()
    rows = first_by(found.join(covered, "slug", "left_anti"), ["slug"], c("id").asc(), c("name").asc(), c("url").asc())
    rows = rows.join(feeds.select("id"), "id", "left_anti")
    return _as_feeds(
        rows.select(
            "id", "name", canonical_url(c("url")).alias("url"), F.lit("GB").alias("region_hint"),
            F.lit("aa").alias("fellowship"), F.lit("aagb").alias("format"),
        )
    )


def _as_feeds(rows: DataFrame) -> DataFrame:
    """New feed rows in full schema, pending."""
    rows = rows.withColumns({"status": F.lit("pending"), "meeting_count": F.lit(0)})
    have = set(rows.columns)
    return rows.select(
        *[(c(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in FEEDS.fields]
    )


# --- discovery -----------------------------------------------------------------------------


def candidates(seeds: DataFrame, roots: DataFrame, host_rows: DataFrame) -> DataFrame:
    """URLs to probe, one per canonical URL: seeds, then federated roots, then host paths."""
    bare = F.regexp_replace("host", r"^www\.", "")
    seed = seeds.select(
        "url", as_fellowship(c("fellowship")).alias("fellowship"), as_feed_format(c("format")).alias("format"), "id",
        "name", c("regionHint").alias("region_hint"), F.lit(None).cast("string").alias("info_url"),
        F.lit(0).alias("_source"), c("pos").cast("bigint").alias("_pos"), F.lit(0).alias("_path"),
    )
    root = roots.select(
        search_url(c("url")).alias("url"), F.lit("na").alias("fellowship"), F.lit("bmlt").alias("format"), "id",
        "name", c("regionHint").alias("region_hint"), info_url(c("url")).alias("info_url"),
        F.lit(1).alias("_source"), c("pos").cast("bigint").alias("_pos"), F.lit(0).alias("_path"),
    )
    host = host_rows.select("host", F.posexplode(host_candidates(c("host"))).alias("_path", "url")).select(
        "url", guess_fellowship(c("host")).alias("fellowship"), F.lit("tsml").alias("format"),
        slugify(bare).alias("id"), bare.alias("name"), guess_region(c("host")).alias("region_hint"),
        F.lit(None).cast("string").alias("info_url"), F.lit(2).alias("_source"),
        F.lit(0).cast("bigint").alias("_pos"), "_path",
    )
    every = seed.unionByName(root).unionByName(host).withColumn("canonical", canonical_url(c("url")))
    best = first_by(every, ["canonical"], c("_source").asc(), c("_pos").asc(), c("name").asc(), c("_path").asc())
    return best.drop("_source", "_pos", "_path")


def accept_discovered(live: DataFrame, feeds: DataFrame) -> DataFrame:
    """New feeds from probed candidates (id, url, resolved_url, name, region_hint, fellowship, format).

    Known URLs are dropped and each gets a free id: its own, else its host's, else a numbered one.
    Ids are numbered in bulk, so that ids that clash inside one batch are told apart too.
    """
    rows = live.withColumn("_url", canonical_url(c("resolved_url")))
    known = feeds.select(canonical_url(c("url")).alias("_url")).distinct()
    rows = first_by(rows.join(known, "_url", "left_anti"), ["_url"], c("id").asc(), c("url").asc())
    rows = allocate_ids(rows, feeds.select("id"))
    host = F.regexp_replace(F.regexp_extract("_url", "^[a-z]+://([^/:?#]+)", 1), r"^www\.", "")
    return _as_feeds(
        rows.select(
            c("feed_id").alias("id"), F.coalesce(blank_null(c("name")), host).alias("name"), c("_url").alias("url"),
            "region_hint", guess_fellowship(host, c("fellowship")).alias("fellowship"), "format",
        )
    )


def allocate_ids(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """A free `feed_id` per candidate (id, url, _url): own id if unmoved, host slug, host slug-2, -3 …"""
    host = host_slug(c("_url"))
    own = F.when(canonical_url(c("url")) == c("_url"), blank_null(c("id")))
    rows = rows.withColumns({"_host": host, "_want": F.coalesce(own, host)})
    used = taken.select(c("id").alias("_want"), F.lit(True).alias("_used")).distinct()
    rows = numbered(rows, "_want", c("_url"), "_nth").join(used, "_want", "left")
    first = (c("_nth") == 1) & c("_used").isNull()
    # Those that lost their wish share the numbers of their host: base, base-2, base-3 …
    number = F.regexp_extract("id", r"^(.*)-(\d+)$", 2).try_cast("int")
    settled = rows.where(first).select(c("_want").alias("id"))
    occupied = taken.select("id").union(settled)
    bases = occupied.select(
        F.explode(
            F.array(
                F.struct(c("id").alias("_host"), F.lit(1).alias("n")),
                F.struct(F.regexp_extract("id", r"^(.*)-\d+$", 1).alias("_host"), number.alias("n")),
            )
        ).alias("_b")
    ).select("_b.*")
    highest = bases.where(c("n").isNotNull()).groupBy("_host").agg(F.max("n").alias("_top"))
    losers = numbered(rows.where(~first), "_host", c("_url"), "_seq")
    losers = losers.join(highest, "_host", "left").withColumn(
        "_no", F.coalesce(c("_top"), F.lit(0)) + c("_seq")
    )
    own_number = F.when(c("_no") == 1, c("_host")).otherwise(F.concat_ws("-", "_host", c("_no").cast("string")))
    keep = [n for n in rows.columns if n not in ("_want", "_nth", "_used", "_host")]
    return (
        rows.where(first).select(*keep, c("_want").alias("feed_id"))
        .unionByName(losers.select(*keep, own_number.alias("feed_id")))
    )


def probe_outcomes(feed_ids: DataFrame, catalog: DataFrame, probes: DataFrame) -> DataFrame:
    """Outcome per feed: known repeat, missing, first working candidate in order, or disable."""
    working = probes.where(c("ok")).groupBy("id").agg(
        F.min(F.struct("candidate_pos", "url", "count")).alias("_hit")
    )
    listed = catalog.select("id", F.lit(True).alias("_listed")).distinct()
    repeat = c("id").isin(*DUPLICATE_FEEDS)
    rows = feed_ids.join(listed, "id", "left").join(working, "id", "left")
    outcome = (
        F.when(repeat, "duplicate")
        .when(c("_listed").isNull(), "missing")
        .when(c("_hit").isNotNull(), "ok")
        .otherwise("disable")
    )
    ok = outcome == "ok"
    return rows.select(
        "id", outcome.alias("outcome"), F.when(ok, c("_hit.url")).alias("working_url"),
        F.when(ok, c("_hit.count")).alias("count"),
    )


# --- claims and state ----------------------------------------------------------------------


def claimable(
    feeds: DataFrame, now: datetime, feed_id: str | None = None, started_before: datetime | None = None
) -> DataFrame:
    """Enabled feeds without a running lease, optionally one feed or those not tried in this run."""
    free = c("leased_until").isNull() | (c("leased_until") < at(now))
    rows = feeds.where((c("status") != "disabled") & free)
    if feed_id:
        rows = rows.where(c("id") == feed_id)
    if started_before:
        rows = rows.where(c("last_attempt_at").isNull() | (c("last_attempt_at") < at(started_before)))
    return rows


def stale_first(feeds: DataFrame, limit: int | None = FEED_PAGE) -> DataFrame:
    """Feeds in ingest order: never tried first, then the longest ago."""
    rows = feeds.orderBy(c("last_attempt_at").asc_nulls_first(), c("last_ok_at").asc_nulls_first(), c("id"))
    return rows if limit is None else rows.limit(limit)


def coerce_claimed(rows: DataFrame) -> DataFrame:
    """Typed feed rows from loose text columns; rows without id, name or URL are dropped."""
    time = lambda n: F.try_to_timestamp(c(n)).alias(n)
    return rows.where(c("id").isNotNull() & c("name").isNotNull() & c("url").isNotNull()).select(
        "id", "name", "url", "region_hint",
        F.coalesce("fellowship", F.lit("aa")).alias("fellowship"),
        F.coalesce("format", F.lit("tsml")).alias("format"),
        F.coalesce("status", F.lit("pending")).alias("status"),
        time("last_attempt_at"), time("last_ok_at"), "last_error",
        F.coalesce(c("meeting_count").try_cast("int"), F.lit(0)).alias("meeting_count"),
        "etag", "last_modified", time("leased_until"),
    )


def split_unchanged(landed: DataFrame, feeds: DataFrame) -> DataFrame:
    """Landed payloads with `changed`: a validator equal to the stored one means unchanged."""
    known = feeds.select(
        c("id").alias("feed_id"), c("etag").alias("_etag"), c("last_modified").alias("_modified")
    )
    same = (c("etag") == c("_etag")) | (
        (c("etag").isNull() | c("_etag").isNull()) & (c("last_modified") == c("_modified"))
    )
    return (
        landed.join(known, "feed_id", "left")
        .withColumn("changed", ~F.coalesce(same, F.lit(False)))
        .drop("_etag", "_modified")
    )


def apply_results(feeds: DataFrame, results: DataFrame, now: datetime) -> DataFrame:
    """Feed state after a run, from one result row per feed.

    results: feed_id, outcome (written | unchanged | error), n, error, etag, last_modified.
    """
    mine = results.select(
        c("feed_id").alias("id"), c("outcome").alias("_outcome"), c("n").alias("_n"), c("error").alias("_error"),
        c("etag").alias("_etag"), c("last_modified").alias("_modified"),
    )
    tried, ok = c("_outcome").isNotNull(), c("_outcome").isin("written", "unchanged")
    written, failed = c("_outcome") == "written", c("_outcome") == "error"
    stamp = at(now)
    return (
        feeds.join(mine, "id", "left")
        .withColumns(
            {
                "status": F.when(ok, "ok").when(failed, "error").otherwise(c("status")),
                "last_attempt_at": F.when(tried, stamp).otherwise(c("last_attempt_at")),
                "last_ok_at": F.when(ok, stamp).otherwise(c("last_ok_at")),
                "last_error": F.when(ok, None)
                .when(failed, F.substring("_error", 1, ERROR_TEXT_MAX))
                .otherwise(c("last_error")),
                "meeting_count": F.when(written, c("_n").cast("int")).otherwise(c("meeting_count")),
                "etag": F.when(written, c("_etag")).otherwise(c("etag")),
                "last_modified": F.when(written, c("_modified")).otherwise(c("last_modified")),
                "leased_until": F.when(tried, None).otherwise(c("leased_until")),
            }
        )
        .select(*feeds.columns)
    )


def run_errors(results: DataFrame) -> DataFrame:
    """Every failing feed of a run with its error."""
    return results.where(c("outcome") == "error").select("feed_id", "error")


def run_totals(results: DataFrame, shown: int = 20) -> DataFrame:
    """Counters of a run; the summary shows the first errors by feed, `run_errors` has them all."""
    notes = run_errors(results).select(F.concat_ws(": ", "feed_id", "error").alias("note")).orderBy("note").limit(shown)
    counters = results.agg(
        F.count("*").alias("feeds_processed"),
        F.count_if(c("outcome").isin("written", "unchanged")).alias("feeds_ok"),
        F.count_if(c("outcome") == "error").alias("feeds_fail"),
        F.count_if(c("outcome") == "unchanged").alias("feeds_not_modified"),
        F.count_if(c("outcome") == "written").alias("feeds_written"),
        F.coalesce(F.sum(F.when(c("outcome") == "written", c("n"))), F.lit(0)).alias("meetings_upserted"),
    )
    summary = notes.agg(blank_null(F.array_join(F.sort_array(F.collect_list("note")), "\n")).alias("error_summary"))
    names = [*counters.columns, "error_summary"]
    stacked = counters.unionByName(summary, allowMissingColumns=True)
    return stacked.agg(*[F.max(n).alias(n) for n in names])


def merge_totals(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Partial stats to one row of summed counters, and all their errors as rows."""
    numeric = [f.name for f in stats.schema.fields if f.name != "errors"]
    totals = stats.agg(*[F.sum(n).alias(n) for n in numeric])
    return totals, stats.select(F.explode("errors").alias("error"))


def close_stale_runs(runs: DataFrame, now: datetime) -> DataFrame:
    """Runs still marked running after ten minutes become incomplete."""
    cutoff = at(now) - F.make_dt_interval(mins=F.lit(STALE_RUN_MINUTES))
    dead = (c("status") == "running") & (c("started_at") < cutoff)
    return runs.withColumns(
        {
            "finished_at": F.when(dead, at(now)).otherwise(c("finished_at")),
            "status": F.when(dead, "incomplete").otherwise(c("status")),
        }
    )


def finish_run(runs: DataFrame, run_id: int, totals: DataFrame, now: datetime) -> DataFrame:
    """The run row with its counters and final status."""
    row = totals.select(F.lit(run_id).cast("bigint").alias("id"), *[c(n).alias(f"_{n}") for n in totals.columns])
    mine = c("_feeds_ok").isNotNull()
    done = F.when((c("_feeds_fail") > 0) | c("_error_summary").isNotNull(), "completed_with_errors").otherwise("completed")
    return (
        runs.join(row, "id", "left")
        .withColumns(
            {
                "finished_at": F.when(mine, at(now)).otherwise(c("finished_at")),
                "feeds_ok": F.when(mine, c("_feeds_ok").cast("int")).otherwise(c("feeds_ok")),
                "feeds_fail": F.when(mine, c("_feeds_fail").cast("int")).otherwise(c("feeds_fail")),
                "meetings_upserted": F.when(mine, c("_meetings_upserted").cast("int")).otherwise(c("meetings_upserted")),
                "error_summary": F.when(mine, c("_error_summary")).otherwise(c("error_summary")),
                "status": F.when(mine, done).otherwise(c("status")),
            }
        )
        .select(*runs.columns)
    )


def backfill_run_status(runs: DataFrame) -> DataFrame:
    status = (
        F.when(c("finished_at").isNull(), "incomplete")
        .when(c("feeds_fail") > 0, "completed_with_errors")
        .otherwise("completed")
    )
    return runs.withColumn("status", status)


# --- references ----------------------------------------------------------------------------


def without_feeds(table: DataFrame, gone: DataFrame, column: str = "feed_id") -> DataFrame:
    """Rows that survive the deletion of feeds: entities, listings and note vectors alike."""
    ids = gone.select(c("id").alias(column)).distinct()
    return table.join(ids, column, "left_anti")


def unlink_entities(listings: DataFrame, entities: DataFrame) -> DataFrame:
    """Listings whose entity is gone keep the row and lose the reference."""
    alive = entities.select(c("id").alias("entity_id"), F.lit(True).alias("_alive")).distinct()
    return (
        listings.join(alive, "entity_id", "left")
        .withColumn("entity_id", F.when(c("_alive"), c("entity_id")))
        .select(*listings.columns)
    )


def backfill_verified(listings: DataFrame, feeds: DataFrame) -> DataFrame:
    """verified_at from the feed's last success, for every listing of a known feed."""
    stamps = feeds.select(
        c("id").alias("feed_id"), c("last_ok_at").alias("_ok"), F.lit(True).alias("_known")
    )
    return (
        listings.join(stamps, "feed_id", "left")
        .withColumn("verified_at", F.when(c("_known"), c("_ok")).otherwise(c("verified_at")))
        .select(*listings.columns)
    )


