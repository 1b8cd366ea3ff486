"""Column builders on counts, rates and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITE = float("inf")


def per_100k(count: Column, chars: Column) -> Column:
    """Occurrences in 100,000 characters; over no characters 0 or infinite."""
    return F.when(chars == 0, F.when(count == 0, F.lit(0.0)).otherwise(F.lit(INFINITE))).otherwise(count / F.when(chars != 0, chars) * 100000.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b; over nothing 1 if both are nothing, else infinite."""
    return F.when(b > 0, a / F.when(b > 0, b)).when((a == 0) & (b == 0), F.lit(1.0)).otherwise(F.lit(INFINITE))
