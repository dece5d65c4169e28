"""Incremental roll-ups: refresh what a change of some feeds touches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrid.operators.rollup import (
    aggregated_places,
    eligible,
    rebuild_plan,
    refresh_places,
    touched_cells,
)

c = F.col


def changed_cells(before: DataFrame, after: DataFrame, written: DataFrame) -> DataFrame:
    """Cells that hold a row of a written feed before or after the change."""
    return touched_cells(before, written).union(touched_cells(after, written)).distinct()


def next_places(
    previous: DataFrame, listings: DataFrame, feeds: DataFrame, cells: DataFrame, now: datetime, mode: str
) -> DataFrame:
    """Aggregated places for a rebuild mode: full, incremental or skip."""
    if mode == "skip":
        return previous
    rows = eligible(listings, feeds, now)
    return aggregated_places(rows) if mode == "full" else refresh_places(previous, rows, cells)


__all__ = ["changed_cells", "next_places", "rebuild_plan"]
