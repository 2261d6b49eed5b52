"""Analytics queries written as PySpark DataFrame plans."""
