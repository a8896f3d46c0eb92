"""Operations over grouped series (keys, ts, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ieee import known


def _rank(series: DataFrame, keys: list[str], n: int, largest: bool) -> DataFrame:
    """The n series with the largest or smallest mean; all-missing ones count as
    minus infinity. Equal means keep the order of their keys."""
    if n < 0:
        raise ValueError("N must not be negative")
    mean = series.groupBy(*keys).agg(F.coalesce(F.avg(known(F.col("value"))), F.lit(float("-inf"))).alias("_mean"))
    # A top-n plan: partial limits, no global sort of all series.
    best = mean.orderBy(F.col("_mean").desc() if largest else F.col("_mean").asc(), *keys).limit(n).select(*keys)
    return series.join(best, keys, "left_semi")


def topk(series: DataFrame, keys: list[str], n: int) -> DataFrame:
    return _rank(series, keys, n, True)


def bottomk(series: DataFrame, keys: list[str], n: int) -> DataFrame:
    return _rank(series, keys, n, False)


def of_series(series: DataFrame, method: str, p: float = 50.0) -> DataFrame:
    """(ts, value) over the union of timestamps: avg, sum, min, max, count, stddev or percentile."""
    x = known(F.col("value"))
    agg = {
        "avg": lambda: F.avg(x),
        "sum": lambda: F.sum(x),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "count": lambda: F.count(x).cast("double"),
        "stddev": lambda: F.stddev_pop(x),
        "percentile": lambda: F.percentile(x, F.lit(p / 100)),
    }[method]()
    return series.groupBy("ts").agg(agg.alias("value"))


def ranked(series: DataFrame, keys: list[str]) -> DataFrame:
    """Adds each series' mean and rank, for reports."""
    mean = series.groupBy(*keys).agg(F.avg(known(F.col("value"))).alias("mean"))
    return mean.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean").desc_nulls_last(), *keys)))
