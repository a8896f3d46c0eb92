"""Derived queries: named sub-queries, one time axis, one formula."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..operators import anomaly, forecast
from ..parse.formula import Anomalies, Forecast, parse_formula, references
from ..parse.query import parse_query
from ..parse.values import ParseError, parse_interval, parse_time
from ..sources.points import Source
from .align import align
from .formula import Compiler
from .query import QueryError, numeric

MAX_QUERIES = 10


@dataclass(frozen=True)
class DerivedQuery:
    """A fluent builder: DerivedQuery().query("a", "avg:m(f){}").formula("a * 2")."""

    queries: dict[str, str] = field(default_factory=dict)
    text: str = ""
    start: int | None = None
    end: int | None = None
    interval: int = 0
    how: str = "inner"
    mode: str = "linear"
    own: dict[str, int] = field(default_factory=dict)

    def query(self, name: str, text: str, interval: int | str = 0) -> DerivedQuery:
        own = {**self.own, name: parse_interval(interval)} if interval else self.own
        return replace(self, queries={**self.queries, name: text}, own=own)

    def formula(self, text: str) -> DerivedQuery:
        return replace(self, text=text)

    def between(self, start, end) -> DerivedQuery:
        return replace(self, start=parse_time(start), end=parse_time(end))

    def every(self, interval) -> DerivedQuery:
        return replace(self, interval=parse_interval(interval))

    def aligned(self, how: str = "inner", mode: str = "linear") -> DerivedQuery:
        return replace(self, how=how, mode=mode)

    def checked(self) -> DerivedQuery:
        if not self.queries:
            raise ParseError("a derived query needs at least one sub-query")
        if len(self.queries) > MAX_QUERIES:
            raise ParseError(f"at most {MAX_QUERIES} sub-queries are allowed")
        if not self.text.strip():
            raise ParseError("a derived query needs a formula")
        if (self.start is None) != (self.end is None):
            raise ParseError("startTime and endTime must be given together")
        missing = [r for r in references(parse_formula(self.text)) if r not in self.queries]
        if missing:
            raise ParseError(f"undefined query reference: {', '.join(missing)}")
        return self


def one_series(df: DataFrame, keys: tuple[str, ...], field_name: str | None, strict: bool) -> DataFrame:
    """(ts, value) of a result that must be a single series; strict: an action
    checks that it is."""
    if field_name:
        df = df.where(df["field"] == field_name)
    if strict and keys and df.select(*keys).distinct().limit(2).count() > 1:
        raise QueryError("MULTIPLE_SERIES", "a sub-query of a formula must yield a single series")
    return df.select("ts", "value")


def derive(sources: dict[str, Source], q: DerivedQuery, strict: bool = True) -> DataFrame:
    """sources: by measurement. (ts, value) of a formula; the pieces of anomalies() or
    forecast() as columns. Only sub-queries the formula names are built."""
    q = q.checked()
    node = parse_formula(q.text)
    series = {}
    for name in references(node):
        spec = parse_query(q.queries[name])
        if spec.measurement not in sources:
            raise QueryError("UNKNOWN_MEASUREMENT", f"unknown measurement: {spec.measurement}")
        source = sources[spec.measurement]
        fields = [f for f in (spec.fields or source.fields) if f in source.fields and source.kind(f) in ("double", "long")]
        if not fields:
            raise QueryError("NOT_NUMERIC", f"sub-query {name!r} has no numeric field")
        spec = replace(spec, fields=(fields[0],))
        series[name] = one_series(numeric(source, spec, q.start, q.end, q.own.get(name, q.interval)), spec.group_by, fields[0], strict)
    return evaluate(node, series, q)


def evaluate(node, series: dict[str, DataFrame], q: DerivedQuery, keys: list[str] = ()) -> DataFrame:
    if isinstance(node, Anomalies):
        return anomaly.detect(series[node.name], node.algorithm, node.bounds, node.seasonality, keys)
    if isinstance(node, Forecast):
        span = (q.end or 0) - (q.start or 0)
        return forecast.forecast(series[node.name], node.algorithm, node.deviations, node.seasonality, node.model, node.history, span=span, keys=keys)
    frame = align(series, q.how, q.interval, q.mode, keys)
    return Compiler(frame, list(series), keys).result(node)


def derive_by(sources: dict[str, Source], q: DerivedQuery, keys: list[str]) -> DataFrame:
    """The same for every group: all sub-queries are grouped by keys, and windows
    are partitioned by them. (keys, ts, value)."""
    q = q.checked()
    node = parse_formula(q.text)
    series = {}
    for name in references(node):
        spec = replace(parse_query(q.queries[name]), group_by=tuple(keys))
        source = sources[spec.measurement]
        fields = [f for f in (spec.fields or source.fields) if f in source.fields and source.kind(f) in ("double", "long")]
        series[name] = numeric(source, replace(spec, fields=(fields[0],)), q.start, q.end, q.own.get(name, q.interval)).select(*keys, "ts", "value")
    return evaluate(node, series, q, keys)
