"""Derived views and the registered queries with their SQL."""

from weekgrid.plans import details, ingest, quality, search, serving, upkeep  # noqa: F401
from weekgrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
