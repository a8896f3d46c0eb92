"""Deletes, retention, downsampling and compaction of points tables.

Each is a function from a table to what remains of it: a narrow filter wherever
possible, so a delete needs no shuffle. `rewrite` publishes a result."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..parse.values import MAX_TS, ParseError, parse_duration, parse_interval
from ..sources.points import Source, last_write_wins
from .aggregate import aggregate, bucket


@dataclass(frozen=True)
class Delete:
    """Points of a measurement: tags match exactly (those omitted match all);
    fields omitted are all; the range is inclusive. whole: the tag set must be
    exactly this one (a delete by series)."""

    measurement: str
    tags: tuple[tuple[str, str], ...] = ()
    fields: tuple[str, ...] = ()
    start: int = 0
    end: int = MAX_TS
    whole: bool = False

    @classmethod
    def parse(cls, body: dict) -> Delete:
        tags = tuple(sorted((body.get("tags") or {}).items()))
        one, many = body.get("field"), tuple(body.get("fields") or ())
        start, end = int(body.get("startTime", 0)), min(int(body.get("endTime", MAX_TS)), MAX_TS)
        if not body.get("measurement"):
            raise ParseError("a delete needs a measurement")
        if start > end:
            raise ParseError("startTime must not be after endTime")
        return cls(body["measurement"], tags, (one,) if one and not many else many, start, end, bool(one and not many))


def _doomed(points: DataFrame, d: Delete) -> Column:
    hit = (F.col("measurement") == d.measurement) & F.col("ts").between(d.start, d.end)
    for k, v in d.tags:
        hit &= F.coalesce(F.col("tags")[k] == v, F.lit(False))
    if d.fields:
        hit &= F.col("field").isin(list(d.fields))
    if d.whole:
        hit &= F.size("tags") == len(d.tags)
    return hit


def delete(points: DataFrame, deletes: list[Delete]) -> DataFrame:
    """points without what any of the deletes hits."""
    return points.where(~reduce(lambda a, b: a | b, [_doomed(points, d) for d in deletes], F.lit(False)))


def deleted_series(points: DataFrame, deletes: list[Delete], limit: int = 100) -> DataFrame:
    """Up to limit series that lose points, for the report."""
    hit = reduce(lambda a, b: a | b, [_doomed(points, d) for d in deletes], F.lit(False))
    return points.where(hit).select("measurement", F.to_json("tags").alias("tags"), "field").distinct().orderBy("measurement", "tags", "field").limit(limit)


def delete_rows(source: Source, d: Delete) -> DataFrame:
    """The same on a wide table: rows when all fields go, else the fields become NULL."""
    ts = source.nanos()
    hit = ts.between(d.start, d.end)
    for k, v in d.tags:
        hit &= F.coalesce(F.col(k).cast("string") == v, F.lit(False)) if k in source.tags else F.lit(False)
    if not d.fields:
        return source.df.where(~hit)
    return source.df.withColumns({f: F.when(~hit, F.col(f)) for f in d.fields if f in source.fields})


@dataclass(frozen=True)
class Downsample:
    after: str
    interval: str
    method: str


@dataclass(frozen=True)
class Policy:
    measurement: str
    ttl: str | None = None
    downsample: Downsample | None = None

    def __post_init__(self):
        if not self.ttl and not self.downsample:
            raise ParseError("a retention policy needs a ttl or a downsample rule")
        ttl = parse_duration(self.ttl) if self.ttl else None
        if d := self.downsample:
            if not d.after or not d.interval or not d.method:
                raise ParseError("a downsample rule needs after, interval and method")
            if d.method not in ("avg", "min", "max", "sum", "latest"):
                raise ParseError(f"invalid downsample method: {d.method!r}")
            parse_interval(d.interval)
            if ttl is not None and ttl <= parse_duration(d.after):
                raise ParseError("ttl must be longer than downsample.after")


class Policies:
    """Retention policies by measurement; kept as JSON if a path is given."""

    def __init__(self, path: str | None = None):
        self.path, self.by = path, {}
        if path:
            try:
                with open(path) as f:
                    self.by = {p["measurement"]: self._load(p) for p in json.load(f)}
            except FileNotFoundError:
                pass

    @staticmethod
    def _load(p: dict) -> Policy:
        d = p.get("downsample")
        return Policy(p["measurement"], p.get("ttl"), Downsample(d.get("after", ""), d.get("interval", ""), d.get("method", "")) if d else None)

    def put(self, body: dict) -> Policy:
        policy = self._load(body)
        self.by[policy.measurement] = policy
        self._save()
        return policy

    def get(self, measurement: str) -> Policy | None:
        return self.by.get(measurement)

    def remove(self, measurement: str) -> bool:
        gone = self.by.pop(measurement, None)
        self._save()
        return gone is not None

    def all(self) -> list[Policy]:
        return [self.by[k] for k in sorted(self.by)]

    def _save(self) -> None:
        if self.path:
            with open(self.path, "w") as f:
                json.dump([asdict(p) for p in self.all()], f)


def expire(source: Source, ttl: str, now: int) -> DataFrame:
    """Rows not older than ttl; the filter is on the native time column."""
    return source.between(max(0, now - parse_duration(ttl)), None).df


def downsample(source: Source, rule: Downsample, now: int) -> DataFrame:
    """(tags, field, ts, value): points older than `after` folded per series into
    epoch buckets, newer ones as they are. Numeric fields only; integers are
    written back as integers (rounded toward zero), as doubles here."""
    source = last_write_wins(source)
    cutoff, step = now - parse_duration(rule.after), parse_interval(rule.interval)
    numeric = [f for f in source.fields if source.kind(f) in ("double", "long")]
    df = source.df.withColumn("_ts", source.nanos())
    aggs = []
    for i, f in enumerate(numeric):
        x = F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
        aggs += [aggregate(rule.method, x, [F.col("_ts")]).alias(f"_a{i}"), F.count(f).alias(f"_n{i}")]
    folded = df.where(F.col("_ts") < cutoff).groupBy(*source.tags, bucket(F.col("_ts"), step).alias("ts")).agg(*aggs)
    each = []
    for i, f in enumerate(numeric):
        value = F.col(f"_a{i}")
        if source.kind(f) == "long":
            value = value.cast("long").cast("double")
        each.append(F.struct(F.lit(f).alias("field"), value.alias("value"), F.col(f"_n{i}").alias("n")))
    folded = folded.withColumn("_f", F.explode(F.array(*each))).where("_f.n > 0").select(*source.tags, "_f.field", "ts", "_f.value")
    as_they_are = F.array(*[F.struct(F.lit(f).alias("field"), F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias("value"), F.col(f).isNotNull().alias("has")) for f in numeric])
    new = df.where(F.col("_ts") >= cutoff).select(*source.tags, F.col("_ts").alias("ts"), F.explode(as_they_are).alias("_f"))
    return folded.unionByName(new.where("_f.has").select(*source.tags, "_f.field", "ts", "_f.value"))


def compact(points: DataFrame, deletes: list[Delete] = (), ttl: dict[str, str] | None = None, now: int = 0) -> DataFrame:
    """Last write wins, deletes and retention in one pass over a points table:
    filters first, so dead points never reach the exchange."""
    points = delete(points, list(deletes))
    for m, t in (ttl or {}).items():
        points = points.where((F.col("measurement") != m) | (F.col("ts") >= now - parse_duration(t)))
    tags = F.array_sort(F.map_entries("tags"))
    last = F.max_by(F.struct("tags", "v", "l", "b", "s", "seq"), "seq").alias("_x")
    out = points.withColumn("_tags", tags).groupBy("measurement", "_tags", "field", "ts").agg(last)
    return out.select("measurement", "_x.tags", "field", "ts", "_x.v", "_x.l", "_x.b", "_x.s", "_x.seq")


def rewrite(points: DataFrame, path: str) -> None:
    """Publishes a points table: by measurement and day, sorted for row-group pruning.

    The points may come from the same path: the new table is written beside it and
    takes its place by two renames, the old one goes last. Ranges deal a large
    measurement's day to several tasks."""
    spark = points.sparkSession
    day = F.floor(F.col("ts") / F.lit(86400 * 10**9)).cast("int")
    keys = ["measurement", "day", "field", "ts"]
    new = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    points.withColumn("day", day).repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy("measurement", "day").parquet(new)
    here, there, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, f"{new}.old"))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(here) and not fs.rename(here, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(there, here):
        raise OSError(f"cannot publish {new} as {path}")
    fs.delete(old, True)
