"""Recurring weekly listings on Spark: ingest, cleaning, roll-ups and serving queries."""
