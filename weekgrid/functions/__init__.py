"""Catalyst-transparent Column expressions."""
