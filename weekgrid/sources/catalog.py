"""The two catalog lists from folders of JSON files, and seeding the feeds from them when they changed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekgrid.functions.clock import at
from weekgrid.operators import feeds as feed_ops
from weekgrid.operators.versions import Change, Snapshot, Store
from weekgrid.schemas import CATALOG_ITEM, FEEDS

c = F.col
_ITEMS = T.ArrayType(CATALOG_ITEM)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content): every file of a folder as one text."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), c("value").alias("content"))


def catalog_items(files: DataFrame) -> DataFrame:
    """The items of all files with `pos`: files by name, items by their place. A file holds one array or one object."""
    whole = F.when(F.ltrim("content").startswith("["), c("content")).otherwise(F.concat(F.lit("["), c("content"), F.lit("]")))
    items = files.select("file", F.posexplode(F.from_json(whole, _ITEMS)).alias("at", "item"))
    return items.where("item is not null").select("item.*", F.struct("file", "at").alias("pos"))


def digest(files: DataFrame) -> str:
    """One digest of a folder's content, the same in whatever order the files are read. A row a file, of two short texts."""
    parts = files.select("file", F.sha2("content", 256).alias("sha"))
    row = parts.agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("file", "sha")))), 256).alias("digest"))
    return row.first().digest


def seed_catalog(store: Store, general: str, federated: str, now: datetime, force: bool = False) -> Snapshot | None:
    """Bring the stored feeds in line with the two lists, in one commit; None where neither list changed since the last time.

    Feeds that another id took over go with their listings and entities; the city index is marked for a full rebuild.
    """
    spark, base = store.spark, store.snapshot()
    lists = [read_files(spark, folder) for folder in (general, federated)]
    found = F.sha2(F.lit("\0".join(digest(files) for files in lists)), 256)
    new_hash = spark.range(1).select(found.alias("h")).first().h
    if not feed_ops.catalog_changed(base.read("catalog_state"), new_hash, force):
        return None
    first, second = map(catalog_items, lists)
    catalog = feed_ops.merge_catalog(first, second)
    feeds = base.read("feeds")
    gone = feed_ops.replaced_feeds(catalog, feeds)
    kept = feed_ops.upsert_catalog(feeds.join(gone, "id", "left_anti"), catalog).select(*FEEDS.names)
    state = spark.range(1).select(F.lit("feeds").alias("id"), F.lit(new_hash).alias("content_hash"), at(now).alias("seeded_at"))
    ids = gone.select(c("id").alias("feed_id"))
    orphans = base.read("entities").join(ids, "feed_id", "left_semi")
    return store.commit(
        base,
        {
            "feeds": Change(kept),
            "listings": Change(base.read("listings").limit(0), ids),
            "entities": Change(base.read("entities").limit(0), orphans.select("id")),
            "catalog_state": Change(state, state.select("id")),
        },
        {"dirty": True},
    )
