"""Money as decimals, so that sums do not depend on the order rows arrive in."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def discounted_price(price: Column, discount: Column) -> Column:
    """``price * (1 - discount)`` as ``decimal(17,4)``."""
    return price.cast("decimal(12,2)") * (
        F.lit(Decimal("1.00")) - discount.cast("decimal(3,2)")
    )
