"""Whole queries."""

from tarnwell.plans.revenue import revenue_by_nation

__all__ = ["revenue_by_nation"]
