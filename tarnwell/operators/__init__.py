"""Reusable DataFrame-to-DataFrame steps."""

from tarnwell.operators.totals import totals_by

__all__ = ["totals_by"]
