"""The metadata catalog as queries over a Source or the canonical points table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.points import Source


def measurements(points: DataFrame, prefix: str = "", offset: int = 0, limit: int = 1000) -> DataFrame:
    """(measurement, total): a page of the sorted names, with how many there are."""
    names = points.select("measurement").distinct().where(F.col("measurement").startswith(prefix))
    total = names.agg(F.count("*").alias("total"))
    return names.orderBy("measurement").offset(offset).limit(limit).join(F.broadcast(total))


def tags(source: Source, key: str | None = None) -> DataFrame:
    """(key, value) pairs in use."""
    keys = [k for k in source.tags if key in (None, k)]
    if not keys:
        return source.df.where(F.lit(False)).select(F.lit("").alias("key"), F.lit("").alias("value"))
    # Each tag is made distinct before the next is looked at: one pass, small exchange.
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("p")
    return source.df.select(pairs).select("p.key", "p.value").where("value IS NOT NULL").distinct()


def fields(source: Source) -> list[tuple[str, str]]:
    """(name, type), from the schema alone."""
    return [(f, {"double": "float", "long": "integer"}.get(source.kind(f), source.kind(f))) for f in source.fields]


def fields_of_points(points: DataFrame, measurement: str) -> DataFrame:
    kind = F.when(F.col("v").isNotNull(), "float").when(F.col("l").isNotNull(), "integer").when(F.col("b").isNotNull(), "boolean").otherwise("string")
    return points.where(F.col("measurement") == measurement).groupBy("field").agg(F.min_by(kind, "seq").alias("type"))


def series(source: Source) -> DataFrame:
    """(tags, field, series_key, series_id): one row per series."""
    each = F.explode(F.filter(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in source.fields]), lambda x: x.isNotNull())).alias("field")
    found = source.df.select(*source.tags, each).distinct()
    return found.withColumn("series_key", source.series_key(F.col("field"))).withColumn("series_id", F.xxhash64("series_key"))


def series_by_id(source: Source, series_id: int) -> DataFrame:
    return series(source).where(F.col("series_id") == series_id)


def find_series(source: Source, scopes=()) -> DataFrame:
    return series(source.scoped(tuple(scopes)))


def series_by_tag(source: Source, key: str) -> DataFrame:
    """(value, n_series)."""
    return series(source).groupBy(F.col(key).cast("string").alias("value")).agg(F.count("*").alias("n_series"))


def field_stats(source: Source) -> DataFrame:
    """(tags, field, n, min_ts, max_ts) of every series."""
    ts = source.nanos()
    aggs = []
    for i, f in enumerate(source.fields):
        here = F.when(F.col(f).isNotNull(), F.col("_ts"))
        aggs += [F.count(f).alias(f"_n{i}"), F.min(here).alias(f"_lo{i}"), F.max(here).alias(f"_hi{i}")]
    out = source.df.withColumn("_ts", ts).groupBy(*source.tags).agg(*aggs)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_n{i}").alias("n"), F.col(f"_lo{i}").alias("min_ts"), F.col(f"_hi{i}").alias("max_ts")) for i, f in enumerate(source.fields)])
    return out.withColumn("_f", F.explode(each)).where("_f.n > 0").select(*source.tags, "_f.*")


def cardinality(source: Source, tag: str | None = None, exact: bool = False) -> DataFrame:
    """(estimate) of series, or (value, estimate) for each value of a tag. A tag set
    is a series of a field only where that field has a value."""
    key = F.xxhash64(*[F.col(t) for t in source.tags])
    each = [F.when(F.col(f).isNotNull(), key) for f in source.fields]
    count = sum((F.count_distinct(k) if exact else F.approx_count_distinct(k, 0.008) for k in each[1:]), F.count_distinct(each[0]) if exact else F.approx_count_distinct(each[0], 0.008))
    if tag is None:
        return source.df.agg(count.alias("estimate"))
    return source.df.groupBy(F.col(tag).cast("string").alias("value")).agg(count.alias("estimate"))
