"""The served form of listings: fresh sources, their entities, single rows and the online page."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.functions.labels import as_fellowship
from weekgrid.operators.dedupe import collapse_duplicates
from weekgrid.operators.predicates import is_fresh, is_safe
from weekgrid.schemas import ONLINE_LIMIT

c = F.col


def fresh_feeds(feeds: DataFrame, now: datetime) -> DataFrame:
    return feeds.where(is_fresh(c("status"), c("last_ok_at"), now))


def with_fresh_feed(listings: DataFrame, feeds: DataFrame, now: datetime) -> DataFrame:
    """Listings of fresh feeds, with the feed's name and success stamp.

    No hint: feeds grow with the data, so the planner broadcasts them only below its size limit and
    otherwise shuffles, splitting a feed that holds too many rows.
    """
    stamps = fresh_feeds(feeds, now).select(
        c("id").alias("feed_id"), c("name").alias("feed_name"), c("last_ok_at").alias("source_verified_at")
    )
    return listings.join(stamps, "feed_id")


def with_entity(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity fields by id, the feed's name where there is no entity, empty lists for nulls."""
    details = entities.select(
        c("id").alias("entity_id"),
        c("name").alias("_entity"),
        c("phone").alias("entity_phone"),
        c("email").alias("entity_email"),
        c("url").alias("entity_url"),
        c("feedback_emails").alias("_emails"),
    )
    none = F.array().cast("array<string>")
    return (
        rows.join(details, "entity_id", "left")
        .withColumns(
            {
                "entity_name": F.coalesce("_entity", "feed_name"),
                "feedback_emails": F.coalesce("_emails", none),
                "types": F.coalesce("types", none),
                "fellowship": as_fellowship(c("fellowship")),
            }
        )
        .drop("_entity", "_emails")
    )


def public_listings(listings: DataFrame, feeds: DataFrame, now: datetime) -> DataFrame:
    return with_fresh_feed(listings.where(is_safe()), feeds, now)


def get_listing(
    listings: DataFrame, feeds: DataFrame, entities: DataFrame, feed_id: str, slug: str, now: datetime
) -> DataFrame:
    """One listing by key; both sides are filtered at the scan."""
    one = listings.where((c("feed_id") == feed_id) & (c("slug") == slug))
    source = feeds.where(c("id") == feed_id)
    return with_entity(public_listings(one, source, now).limit(1), entities)


def online_page(
    listings: DataFrame,
    feeds: DataFrame,
    entities: DataFrame,
    now: datetime,
    limit: int = ONLINE_LIMIT,
    offset: int = 0,
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """A page of online and hybrid listings by day and time; duplicates collapse after paging."""
    joinable = listings.where(c("attendance").isin("online", "hybrid"))
    order = [c("day").asc_nulls_last(), c("time").asc_nulls_last(), c("feed_id"), c("slug")]
    page = (
        public_listings(joinable, feeds, now)
        .orderBy(*order, *tiebreak)
        .offset(max(offset, 0))
        .limit(limit)
    )
    return collapse_duplicates(with_entity(page, entities))


#: The order of online pages; a listing's key at the end makes it total.
ONLINE_ORDER = ("day", "time", "feed_id", "slug")


def _known_last(name: str) -> Column:
    """Order value of a column: nulls after everything else."""
    return F.coalesce(c(name), F.lit(99) if name == "day" else F.lit("~"))


def online_sorted(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Online and hybrid listings dealt by their order, so that a stored file holds a stretch of it.

    File statistics of the two leading columns then let a page skip all files before it.
    """
    online = rows.where(c("attendance").isin("online", "hybrid")).withColumns({"day": _known_last("day"), "time": _known_last("time")})
    order = [c(n) for n in ONLINE_ORDER]
    dealt = online.repartitionByRange(partitions, *order) if partitions else online.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)


def online_after(rows: DataFrame, after: tuple[int, str, str, str] | None, limit: int = ONLINE_LIMIT) -> DataFrame:
    """The next `limit` rows of `online_sorted` behind the last key of a page; the first page after None.

    No row before the page is read, counted or carried, however deep the page lies. Days and times that are not known are
    99 and '~' in a key, as in the rows.
    """
    if after is not None:
        day, time, feed_id, slug = after
        # The leading bound alone is what file statistics can judge.
        later = (c("day") > day) | ((c("day") == day) & ((c("time") > time) | ((c("time") == time) & (
            (c("feed_id") > feed_id) | ((c("feed_id") == feed_id) & (c("slug") > slug))))))
        rows = rows.where((c("day") >= day) & later)
    return rows.orderBy(*ONLINE_ORDER).limit(limit)
