"""Column expressions."""

from tarnwell.functions.money import discounted_price

__all__ = ["discounted_price"]
