"""Exact money arithmetic: doubles at the edges of the system, decimals inside sums."""

from pyspark.sql import Column
from pyspark.sql import functions as F

CENTS = "decimal(18,2)"


def exact(amount: Column) -> Column:
    """Cents; null for NaN and for what does not fit, which the gate rejects before."""
    return amount.try_cast(CENTS)


def ratio(part: Column, whole: Column) -> Column:
    """Division giving 0 where the denominator is 0 or there is nothing to divide."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
