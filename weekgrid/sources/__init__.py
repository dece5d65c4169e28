"""Readers: payload envelopes, JSON dialects, HTML and text pages, catalogs."""
