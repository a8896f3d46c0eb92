"""Subscriptions: raw points, tumbling aggregation, formulas, backfill.

Windows are event-time: a bucket closes when the watermark passes its end, so a
point later than `late` is dropped rather than re-opening its bucket (outputMode
update gives corrected values instead)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.ieee import known
from ..operators.aggregate import aggregate
from ..parse.formula import Anomalies, Forecast, Ref, TimeShift, parse_formula, references, walk
from ..parse.query import QuerySpec, parse_query
from ..parse.values import ParseError, parse_interval
from ..plans.align import align
from ..plans.formula import Compiler
from ..sources.points import Source

CARRY = 10
MAX_QUERIES = 100
#: Methods of live buckets.
METHODS = ("avg", "sum", "min", "max", "latest", "first", "count", "spread", "stddev", "stdvar")


def validate(queries: dict[str, str], formula: str | None = None, interval: int = 0) -> dict[str, QuerySpec]:
    if not queries or len(queries) > MAX_QUERIES:
        raise ParseError(f"a subscription has 1 to {MAX_QUERIES} queries")
    specs = {k: parse_query(v) for k, v in queries.items()}
    if formula:
        node = parse_formula(formula)
        if not interval:
            raise ParseError("a streaming formula needs an aggregation interval")
        if isinstance(node, (Anomalies, Forecast)) or any(isinstance(x, TimeShift) for x in walk(node)):
            raise ParseError("anomalies(), forecast() and time_shift() cannot be streamed")
        missing = [r for r in references(node) if r not in queries]
        if missing:
            raise ParseError(f"undefined query reference: {', '.join(missing)}")
        if len(queries) == 1 and any(isinstance(x, Ref) and x.name != "a" for x in walk(node)):
            raise ParseError("the formula of a single query refers to it as a")
    return specs


def raw(source: Source, query: str | QuerySpec) -> DataFrame:
    """(tags, field, ts, value) of matching points; stateless."""
    spec = parse_query(query) if isinstance(query, str) else query
    s = source.scoped(spec.scopes)
    fields = [f for f in (spec.fields or s.fields) if f in s.fields]
    each = [F.struct(F.lit(f).alias("field"), (F.col(f).cast("double") if s.kind(f) != "string" else F.lit(None).cast("double")).alias("value"), F.col(f).cast("string").alias("text")) for f in fields]
    df = s.df.select(*s.tags, s.nanos().alias("ts"), F.explode(F.array(*each)).alias("_f"))
    return df.where("_f.text IS NOT NULL").select(*s.tags, "_f.field", "ts", "_f.value", "_f.text")


def tumbling(source: Source, query: str | QuerySpec, interval: int | str, late: str = "0 seconds") -> DataFrame:
    """(tags, field, ts, value, n): per series and bucket; works on streams
    (append mode) and on batches alike. Strings carry their latest value in text."""
    spec = parse_query(query) if isinstance(query, str) else query
    step = parse_interval(interval)
    if step < 1000:
        raise ParseError("a streaming interval must be at least a microsecond")
    if spec.method not in METHODS:
        raise ParseError(f"method {spec.method!r} cannot be streamed")
    df = raw(source, spec)
    df = df.withColumn("_at", F.timestamp_micros((F.col("ts") / 1000).cast("long")))
    if df.isStreaming:
        df = df.withWatermark("_at", late)
    window = F.window("_at", f"{step // 1000} microseconds")
    x = known(F.col("value"))
    value = aggregate(spec.method, x, [F.col("ts")])
    out = df.groupBy(window.alias("_w"), *source.tags, "field").agg(value.alias("value"), F.max_by("text", "ts").alias("text"), F.count("*").alias("n"))
    return out.select(*source.tags, "field", (F.unix_micros("_w.start") * 1000).alias("ts"), "value", "text", "n")


def batches(points: DataFrame, formula: str, keys: list[str]) -> DataFrame:
    """A one-query formula over a micro-batch: points (keys, field, ts, value), the
    query named a; windows run per series within the batch."""
    node = parse_formula(formula)
    frame = points.select(*keys, "field", "ts", known(F.col("value")).alias("a"))
    return Compiler(frame, ["a"], [*keys, "field"]).result(node)


def subscribe(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, backfill: DataFrame | None = None, mode: str = "append", once: bool = False):
    """Starts a subscription; sink gets each micro-batch with its number. backfill:
    history, handed over as number -1 before the first one. After a failure the
    unfinished batch, and with batch 0 the backfill, comes again under its number:
    a sink that keeps the last number it stored skips repeats. The input of a batch
    is bounded where the stream is read (maxFilesPerTrigger, maxOffsetsPerTrigger)."""

    def each(df: DataFrame, batch: int) -> None:
        if batch == 0 and backfill is not None:
            sink(backfill, -1)
        sink(df, batch)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def joined(series: dict[str, DataFrame], interval: int | str) -> DataFrame:
    """(ts, one column per query): buckets of several queries over the union of
    their timestamps. A query without a bucket carries its last value forward for
    at most CARRY intervals; keyed state holds just the last value per query."""
    names, step = sorted(series), parse_interval(interval)
    every = None
    for n in names:
        one = series[n].select(F.lit(n).alias("name"), "ts", F.col("value").cast("double").alias("value"))
        every = one if every is None else every.unionByName(one)
    fields = ", ".join(f"`{n}` double" for n in names)
    state_schema = ", ".join(f"`v_{n}` double, `t_{n}` long" for n in names)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else tuple(x for _ in names for x in (None, None))
        last = {n: (held[2 * i], held[2 * i + 1]) for i, n in enumerate(names)}
        pdf = pd.concat(list(frames)).sort_values("ts", kind="stable").drop_duplicates(["name", "ts"], keep="last")
        wide = pdf.pivot(index="ts", columns="name", values="value")
        seen = pdf.assign(one=1).pivot(index="ts", columns="name", values="one")
        newest, rows = int(pdf["ts"].max()), []
        for n, (_, t) in last.items():
            if t is not None and t < newest - CARRY * step:
                last[n] = (None, t)
        for ts in wide.index:
            row = {"ts": int(ts)}
            for n in names:
                if n in wide.columns and seen[n][ts] == 1:
                    v = wide[n][ts]
                    last[n] = (None if v != v else float(v), int(ts))
                row[n] = math.nan if last[n][0] is None else last[n][0]
            rows.append(row)
        state.update(tuple(x for n in names for x in last[n]))
        yield pd.DataFrame(rows, columns=["ts", *names])

    return every.withColumn("_all", F.lit("all")).groupBy("_all").applyInPandasWithState(run, f"ts long, {fields}", state_schema, "append", GroupStateTimeout.NoTimeout)


def carried(series: dict[str, DataFrame], formula: str, interval: int | str) -> DataFrame:
    """The same over finished buckets of a batch, with the formula applied: (ts, value)."""
    step, names = parse_interval(interval), sorted(series)
    frame = align(series, "outer", mode="nan")
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    point = {n: F.last(F.when(F.col(n).isNotNull(), F.struct("ts", F.col(n).alias("v"))), True).over(w) for n in names}
    frame = frame.select("ts", *[F.when(p["ts"] >= F.col("ts") - CARRY * step, p["v"]).alias(n) for n, p in point.items()])
    return Compiler(frame, names).result(parse_formula(formula))


def active(spark: SparkSession) -> list[dict]:
    """Subscriptions that run, with what they have done."""
    return [{"id": str(q.id), "name": q.name, "status": q.status, "progress": q.lastProgress} for q in spark.streams.active]

