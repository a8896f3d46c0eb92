"""NULL stands for a missing value (NaN) throughout; infinities are data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null() -> Column:
    return F.lit(None).cast("double")


def known(x: Column) -> Column:
    """x with NaN as NULL."""
    return F.nanvl(x.cast("double"), null())


def divide(a: Column, b: Column) -> Column:
    """x / 0 is infinite, 0 / 0 missing; never raises."""
    inf = F.lit(float("inf"))
    zero = F.when(a == 0, null()).when(a > 0, inf).when(a < 0, -inf)
    return known(F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b)))


def whole(x: Column, fn) -> Column:
    """ceil or floor as doubles; values without a fraction pass through."""
    big = F.abs(x) >= float(2**53)
    return F.when(big, x).otherwise(fn(F.when(big, F.lit(0.0)).otherwise(x)).cast("double"))
