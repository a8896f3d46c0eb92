"""A query as one lazy plan: scan, filter, group, aggregate, unpivot.

Fields are aggregated side by side in one shuffle and only the result is brought
to long form, so the scan reads just the columns asked for and the exchange
carries one partial row per group."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ieee import known
from ..operators.aggregate import aggregate, bucket
from ..parse.query import QuerySpec, parse_query
from ..parse.values import ParseError, parse_interval, parse_time
from ..sources.points import Source, last_write_wins


class QueryError(RuntimeError):
    """A query that is understood but cannot be answered."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def prepare(source: Source, spec: QuerySpec, start, end) -> tuple[Source, int | None, int | None]:
    start = None if start is None else parse_time(start)
    end = None if end is None else parse_time(end)
    if start is not None and end is not None and start >= end:
        raise ParseError("startTime must be before endTime")
    fields = tuple(f for f in (spec.fields or source.fields) if f in source.fields)
    return replace(source, fields=fields).between(start, end).scoped(spec.scopes), start, end


def _anchor(interval: int, alignment: str, start: int | None) -> int | None:
    if alignment not in ("epoch", "start"):
        raise ParseError(f"bucketAlignment must be 'epoch' or 'start', got {alignment!r}")
    return start if interval and alignment == "start" else None


def _grouped(source: Source, keys: tuple[str, ...], df: DataFrame) -> DataFrame:
    """Empty if some key is carried by none of the series found."""
    if any(k not in source.tags for k in keys):
        return df.where(F.lit(False))
    if keys and source.sparse:
        # One row, whatever the input: whether each key occurs at all.
        probe = source.df.agg(*[F.bool_or(F.col(k).isNotNull()).alias(f"_has{i}") for i, k in enumerate(keys)])
        held = probe.where(" AND ".join(f"_has{i}" for i in range(len(keys)))).select(F.lit(1).alias("_one"))
        df = df.withColumn("_one", F.lit(1)).join(F.broadcast(held), "_one", "left_semi").drop("_one")
    return df


def numeric(source: Source, spec: QuerySpec | str, start=None, end=None, interval=0, alignment: str = "epoch", booleans_as_numeric: bool = False) -> DataFrame:
    """(group keys, field, ts, value) of the numeric fields. Without an interval
    values fold across series at equal times, never over time."""
    spec = parse_query(spec) if isinstance(spec, str) else spec
    interval = parse_interval(interval)
    source, start, _ = prepare(source, spec, start, end)
    anchor = _anchor(interval, alignment, start)
    kinds = {f: source.kind(f) for f in source.fields}
    fields = tuple(f for f, k in kinds.items() if k in ("double", "long") or (k == "boolean" and booleans_as_numeric))
    keys = spec.group_by
    source = last_write_wins(replace(source, fields=fields))
    # Ties can only be between series of one group: those that differ in the other tags.
    ties = [k for k in source.tags if k not in keys and spec.method in ("latest", "first")]
    tags = [k for k in source.tags if k in keys] + ties
    df = source.df.select(
        *tags,
        *[F.lit(None).cast("string").alias(k) for k in keys if k not in source.tags],
        source.nanos().alias("_ts"),
        *[F.col(f).cast("double").alias(f"_v{i}") for i, f in enumerate(fields)],
    )
    ts = bucket(F.col("_ts"), interval, anchor) if interval else F.col("_ts")
    order = [F.col("_ts"), *[F.col(t) for t in ties]]
    aggs = [F.lit(0).alias("_none")]
    for i in range(len(fields)):
        raw = F.col(f"_v{i}")
        aggs += [aggregate(spec.method, known(raw), order).alias(f"_a{i}"), F.count(raw).alias(f"_n{i}")]
    out = df.groupBy(*keys, ts.alias("ts")).agg(*aggs)
    out = _grouped(source, keys, out)
    return _long(out, list(keys), fields)


def _long(df: DataFrame, keys: list[str], fields: tuple[str, ...]) -> DataFrame:
    if not fields:
        return df.where(F.lit(False)).select(*keys, F.lit("").alias("field"), "ts", F.lit(0.0).alias("value"))
    if len(fields) == 1:
        return df.where("_n0 > 0").select(*keys, F.lit(fields[0]).alias("field"), "ts", F.col("_a0").alias("value"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a{i}").alias("value"), F.col(f"_n{i}").alias("n")) for i, f in enumerate(fields)])
    return df.withColumn("_f", F.explode(each)).where("_f.n > 0").select(*keys, "_f.field", "ts", "_f.value")


def typed(source: Source, spec: QuerySpec | str, start=None, end=None, interval=0, alignment: str = "epoch", booleans_as_numeric: bool = False) -> DataFrame:
    """(tags, field, ts, b, s) of boolean and string fields: raw without an
    interval, else the latest of each bucket and series; the method is ignored
    and series are never folded."""
    spec = parse_query(spec) if isinstance(spec, str) else spec
    interval = parse_interval(interval)
    source, start, _ = prepare(source, spec, start, end)
    anchor = _anchor(interval, alignment, start)
    kinds = {f: source.kind(f) for f in source.fields}
    fields = tuple(f for f, k in kinds.items() if k == "string" or (k == "boolean" and not booleans_as_numeric))
    source = last_write_wins(replace(source, fields=fields))
    each = [
        F.struct(
            F.lit(f).alias("field"),
            (F.col(f) if kinds[f] == "boolean" else F.lit(None).cast("boolean")).alias("b"),
            (F.col(f) if kinds[f] == "string" else F.lit(None).cast("string")).alias("s"),
        )
        for f in fields
    ]
    tags = list(source.tags)
    if not each:
        return source.df.where(F.lit(False)).select(*tags, F.lit("").alias("field"), source.nanos().alias("ts"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("string").alias("s"))
    df = _grouped(source, spec.group_by, source.df)
    df = df.select(*tags, source.nanos().alias("ts"), F.explode(F.array(*each)).alias("_f")).where("_f.b IS NOT NULL OR _f.s IS NOT NULL")
    df = df.select(*tags, "_f.field", "ts", "_f.b", "_f.s")
    if not interval:
        return df
    last = F.max_by(F.struct("b", "s"), "ts").alias("_x")
    out = df.groupBy(*tags, "field", bucket(F.col("ts"), interval, anchor).alias("_t")).agg(last)
    return out.select(*tags, "field", F.col("_t").alias("ts"), "_x.b", "_x.s")


def collapsed(source: Source, spec: QuerySpec | str, start=None, end=None) -> DataFrame:
    """(group keys, field, value): one fold over the whole range."""
    spec = parse_query(spec) if isinstance(spec, str) else spec
    source, _, _ = prepare(source, spec, start, end)
    fields = tuple(f for f in source.fields if source.kind(f) in ("double", "long"))
    source = last_write_wins(replace(source, fields=fields))
    order = [source.nanos(), *[F.col(t) for t in source.tags if t not in spec.group_by]]
    aggs = []
    for i, f in enumerate(fields):
        aggs += [aggregate(spec.method, known(F.col(f)), order).alias(f"_a{i}"), F.count(f).alias(f"_n{i}")]
    out = _grouped(source, spec.group_by, source.df.groupBy(*spec.group_by).agg(*aggs))
    return _long(out.withColumn("ts", F.lit(0).cast("long")), list(spec.group_by), fields).drop("ts")


def check_limits(result: DataFrame, keys: list[str], series: int = 10_000, points: int = 10_000_000) -> DataFrame:
    """Raises where a result exceeds the limits; off unless called."""
    # One pass; the partial counts are by series.
    n, many = result.groupBy(*keys, "field").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    if n > points:
        raise QueryError("TOO_MANY_POINTS", f"{n} points exceed the limit of {points}")
    if many > series:
        raise QueryError("TOO_MANY_SERIES", f"{many} series exceed the limit of {series}")
    return result
