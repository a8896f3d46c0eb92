"""Bringing named series (ts, value) to one time axis.

All series are united and meet in one aggregation by timestamp: a single shuffle
however many there are. Whether a series has a point is a column of its own,
since a missing value still is a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ieee import known, null

MAX_GRID = 10_000_000


def _met(series: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    names = sorted(series)
    every = None
    for n in names:
        one = series[n].select(*keys, "ts", F.lit(n).alias("_name"), "value")
        every = one if every is None else every.unionByName(one)
    aggs = []
    for n in names:
        mine = F.col("_name") == n
        aggs += [F.max(F.when(mine, known(F.col("value")))).alias(n), F.coalesce(F.max(mine), F.lit(False)).alias(f"_has_{n}")]
    return every.groupBy(*keys, "ts").agg(*aggs)


def between(ts: Column, before: Column, after: Column, mode: str) -> Column:
    """Value at ts from its neighbours, structs (ts, v); before may be at ts itself."""
    exact = before["ts"] == ts
    line = before["v"] + (after["v"] - before["v"]) * ((ts - before["ts"]).cast("double") / F.nullif((after["ts"] - before["ts"]), F.lit(0)).cast("double"))
    inside = {
        "linear": F.when(before.isNull(), after["v"]).when(after.isNull(), before["v"]).otherwise(line),
        "previous": before["v"],
        "next": after["v"],
        "zero": F.lit(0.0),
        "nan": null(),
    }[mode]
    return F.when(exact, before["v"]).otherwise(inside)


def align(series: dict[str, DataFrame], how: str = "inner", interval: int = 0, mode: str = "linear", keys: list[str] = ()) -> DataFrame:
    """(keys, ts, one column per name). how says which timestamps there are: inner
    (all series have them), outer or union (any has), left (the alphabetically
    first name has). With an interval these become a dense grid from the first to
    the last, unless it would be longer than MAX_GRID. A series without a point
    at a timestamp is interpolated between all of its own points."""
    keys, names = list(keys), sorted(series)
    if not interval and (len(names) == 1 or how == "inner"):
        if len(names) == 1:
            return series[names[0]].select(*keys, "ts", known(F.col("value")).alias(names[0]))
        return _met(series, keys).where(F.expr(_all(names))).select(*keys, "ts", *names)
    need = {"inner": names, "left": names[:1], "outer": [], "union": []}[how]
    met = _met(series, keys).withColumn("_want", F.expr(_all(need)) if need else F.lit(True))
    if interval:
        met = _gridded(met, names, interval, keys)
    back = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("ts").rowsBetween(0, Window.unboundedFollowing)
    point = {n: F.when(F.col(f"_has_{n}"), F.struct(F.col("ts").alias("ts"), F.col(n).alias("v"))) for n in names}
    met = met.withColumns({f"_b_{n}": F.last(p, True).over(back) for n, p in point.items()} | {f"_a_{n}": F.first(p, True).over(ahead) for n, p in point.items()})
    return met.where("_want").select(*keys, "ts", *[between(F.col("ts"), F.col(f"_b_{n}"), F.col(f"_a_{n}"), mode).alias(n) for n in names])


def _all(names: list[str]) -> str:
    return " AND ".join(f"`_has_{n}`" for n in names)


def _gridded(met: DataFrame, names: list[str], interval: int, keys: list[str]) -> DataFrame:
    """met with a row at each point of the grid, and only those wanted."""
    step = F.lit(interval).cast("long")
    ends = met.where("_want").groupBy(*keys).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    ends = ends.withColumn("lo", F.col("lo") - F.pmod("lo", step)).where((F.col("hi") - F.col("lo")) / step < MAX_GRID)
    grid = ends.select(*keys, F.explode(F.sequence("lo", "hi", step)).alias("ts")).withColumn("_grid", F.lit(True))
    # A grid point meets the sources' rows at its timestamp in one aggregation.
    cols = [F.max(n).alias(n) for n in names] + [F.coalesce(F.max(f"_has_{n}"), F.lit(False)).alias(f"_has_{n}") for n in names]
    both = met.withColumn("_grid", F.lit(False)).unionByName(grid, allowMissingColumns=True)
    both = both.groupBy(*keys, "ts").agg(*cols, F.max("_grid").alias("_grid"), F.coalesce(F.max("_want"), F.lit(False)).alias("_want"))
    any_grid = F.max("_grid").over(Window.partitionBy(*keys))
    return both.withColumn("_any", any_grid).withColumn("_want", F.col("_grid") | (~F.col("_any") & F.col("_want")))


def resample(series: dict[str, DataFrame], interval: int, mode: str = "linear", keys: list[str] = ()) -> DataFrame:
    """align() of common timestamps on a dense grid."""
    return align(series, "inner", interval, mode, keys)


def interpolate(series: DataFrame, targets: DataFrame, mode: str = "linear") -> DataFrame:
    """(ts, value) of one series at the timestamps of targets."""
    point = F.struct(F.col("ts").alias("ts"), F.col("value").alias("v"))
    src = series.select("ts", point.alias("_p"), F.lit(False).alias("_want"))
    want = targets.select("ts").distinct().select("ts", F.lit(None).cast(src.schema["_p"].dataType).alias("_p"), F.lit(True).alias("_want"))
    both = src.unionAll(want).groupBy("ts").agg(F.max("_p").alias("_p"), F.max("_want").alias("_want"))
    w = Window.orderBy("ts")
    both = both.withColumns({"_b": F.last("_p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_a": F.first("_p", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    return both.where("_want").select("ts", between(F.col("ts"), F.col("_b"), F.col("_a"), mode).alias("value"))
