"""The twelve aggregation methods over non-missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("avg", "min", "max", "sum", "count", "latest", "first", "median", "exact_median", "stddev", "stdvar", "spread")


def aggregate(method: str, x: Column, order: list[Column]) -> Column:
    """x: nullable double. order: (ts, tie-breakers): latest takes the greatest,
    first the smallest among rows that have a value. With ts alone the buffers
    are fixed-size and the aggregation is by hash; a struct needs a sort."""
    at = F.when(x.isNotNull(), order[0] if len(order) == 1 else F.struct(*order))
    return {
        "avg": lambda: F.avg(x),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "sum": lambda: F.sum(x),
        "count": lambda: F.nullif(F.count(x), F.lit(0)).cast("double"),
        "latest": lambda: F.max_by(x, at),
        "first": lambda: F.min_by(x, at),
        "median": lambda: F.median(x),
        "exact_median": lambda: F.median(x),
        "stddev": lambda: F.stddev_pop(x),
        "stdvar": lambda: F.var_pop(x),
        "spread": lambda: F.max(x) - F.min(x),
    }[method]()


def bucket(ts: Column, interval: int, anchor: int | None = None) -> Column:
    """Start of the bucket of length interval: on the epoch's grid, or the anchor's."""
    if anchor is None:
        return ts - F.pmod(ts, F.lit(interval).cast("long"))
    return F.lit(anchor).cast("long") + (ts - anchor) - F.pmod(ts - anchor, F.lit(interval).cast("long"))
