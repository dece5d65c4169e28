"""City type-ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.functions.base import bind
from weekgrid.functions.geo import haversine_km
from weekgrid.functions.place import is_usable_city, normalize_country
from weekgrid.functions.text import slugify
from weekgrid.operators.dedupe import top_by
from weekgrid.operators.predicates import city_matches
from weekgrid.operators.versions import Change
from weekgrid.schemas import SUGGESTION_RADIUS_KM

c = F.col

# Rows looked at with and without a query.
QUERY_ROWS, EMPTY_QUERY_ROWS = 20, 40


def _order(query: str) -> list[Column]:
    """Exact label, label prefix, exact parent, rest; inside, larger places first."""
    by_size = [-c("meeting_count"), c("slug")]
    if not query:
        return by_size
    needle = F.lit(query.lower())
    label = F.lower("label")
    tier = (
        F.when(label == needle, 0)
        .when(F.startswith(label, needle), 1)
        .when(F.lower(F.coalesce("parent_label", F.lit(""))) == needle, 2)
        .otherwise(3)
    )
    return [tier, *by_size]


def match_cities(cities: DataFrame, query: str, rows: int | None = None) -> DataFrame:
    """The best `rows` matches, by default as many as a suggestion list looks at."""
    found = cities.where(city_matches(query)) if query else cities
    return found.orderBy(*_order(query)).limit(rows or (QUERY_ROWS if query else EMPTY_QUERY_ROWS))


def _prefixes(text: Column) -> Column:
    """All beginnings of a text, of one letter up to the whole."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda n: F.substring(text, F.lit(1), n))


def prefix_rows(cities: DataFrame) -> DataFrame:
    """A row per place and beginning of its label or its parent's label, lower-cased, with the tier it is shown in."""
    named = cities.withColumns({"_label": F.lower("label"), "_parent": F.lower(F.coalesce("parent_label", F.lit("")))})
    every = F.array_distinct(F.concat(_prefixes(c("_label")), F.when(c("_parent") != "", _prefixes(c("_parent"))).otherwise(F.array().cast("array<string>"))))
    rows = named.where(c("_label") != "").withColumn("prefix", F.explode(every))
    tier = (
        F.when(c("_label") == c("prefix"), 0)
        .when(F.startswith("_label", c("prefix")), 1)
        .when(c("_parent") == c("prefix"), 2)
        .otherwise(3)
    )
    return rows.withColumn("tier", tier).drop("_label", "_parent")


def prefix_table(cities: DataFrame, prefixes: DataFrame | None = None, rows: int = QUERY_ROWS) -> DataFrame:
    """The best `rows` places for each beginning, with `rank`; for all of them, or for the given `prefixes` only.

    A short beginning that a third of all places share is ranked in salted parts first, of which `rows` are left each.
    """
    found = prefix_rows(cities)
    if prefixes is not None:
        found = found.join(prefixes.select("prefix").distinct(), "prefix", "left_semi")
    best = top_by(found, ["prefix"], rows, c("tier"), -c("meeting_count"), c("slug"))
    return best.withColumnRenamed("_rank", "rank")


def prefix_change(before: DataFrame, after: DataFrame) -> Change:
    """What a change of the city index, from all places `before` to all places `after`, does to the stored table."""
    keys = ["slug", "label", "parent_label", "meeting_count"]
    changed = before.select(*keys).exceptAll(after.select(*keys)).unionByName(after.select(*keys).exceptAll(before.select(*keys)))
    touched = prefix_rows(changed).select("prefix").distinct()
    return Change(prefix_table(after, touched), touched)


def _repeats(kept: Column, row: Column) -> Column:
    """Whether a kept suggestion is the same place nearby, or the same with label and state swapped.

    A place without coordinates is near nothing.
    """
    same = (kept["_label"] == row["_label"]) & (kept["_parent"] == row["_parent"])
    swapped = (kept["_label"] == row["_state"]) & (kept["_state"] == row["_label"])
    km = haversine_km(kept["lat"], kept["lng"], row["lat"], row["lng"])
    near = F.coalesce((km < SUGGESTION_RADIUS_KM) & ~F.isnan(km), F.lit(False))
    return (same | swapped) & (kept["_nation"] == row["_nation"]) & near


def collapse_suggestions(suggestions: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Greedy proximity de-duplication of ordered suggestion lists.

    Meant for lists that a limit has cut: one list becomes one sorted array, walked once.
    """
    text = lambda v: F.coalesce(v, F.lit(""))
    rows = bind(
        suggestions.where(is_usable_city(c("label")) | (text(c("parent_label")) != "")),
        _order=F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))),
        _label=slugify(c("label")),
        _state=text(slugify(c("state"))),
        _parent=text(c("parent_label")),
        _nation=text(normalize_country(c("country"))),
    )
    columns = ["_order", *(n for n in rows.columns if n != "_order" and n not in keys)]
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_list"))
    kept = F.aggregate(
        "_list",
        F.slice("_list", 1, 0),
        lambda kept, row: F.when(F.exists(kept, lambda k: _repeats(k, row)), kept).otherwise(F.concat(kept, F.array(row))),
    )
    return bind(lists, _kept=kept).select(*keys, F.inline("_kept")).select("_order", *suggestions.columns)


def search_cities(cities: DataFrame, query: str) -> DataFrame:
    """Type-ahead result for one query, in display order."""
    listed = match_cities(cities, query).withColumn("_q", F.lit(0))
    kept = collapse_suggestions(listed, ["_q"], _order(query))
    return kept.orderBy("_order").select(*cities.columns)
