"""Readers for input tables."""

from tarnwell.sources.tables import read_table

__all__ = ["read_table"]
