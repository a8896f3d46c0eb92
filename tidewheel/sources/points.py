"""A measurement as a wide table: tag columns, field columns, a time column.

Tags and fields stay plain columns, so column pruning, predicate pushdown and
Parquet statistics work on them; only results are brought to long form."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..parse.query import Scope
from ..parse.values import MAX_TS

KINDS = {"double": "double", "float": "double", "bigint": "long", "int": "long", "smallint": "long", "tinyint": "long", "boolean": "boolean", "string": "string"}
_EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Source:
    df: DataFrame
    measurement: str
    tags: tuple[str, ...]
    fields: tuple[str, ...]
    ts: str
    #: Orders writes: of equal (series, ts) the row with the largest wins. None: rows are unique.
    seq: str | None = None
    #: Tags that some series lack, so grouping by one that none of those found carries is empty.
    sparse: bool = False

    def kind(self, field: str) -> str:
        t = self.df.schema[field].dataType
        return KINDS.get(t.simpleString(), "double" if isinstance(t, T.DecimalType) else "string")

    @property
    def native(self) -> T.DataType:
        return self.df.schema[self.ts].dataType

    def nanos(self) -> Column:
        """The time column in nanoseconds."""
        if isinstance(self.native, (T.TimestampType, T.TimestampNTZType)):
            return F.unix_micros(F.col(self.ts).cast("timestamp")) * 1000
        return F.col(self.ts).cast("long")

    def between(self, start: int | None, end: int | None) -> Source:
        """Rows in [start, end], compared in the column's own type so that file statistics prune."""
        df = self.df
        if isinstance(self.native, (T.TimestampType, T.TimestampNTZType)):
            ntz = isinstance(self.native, T.TimestampNTZType)

            def literal(micros: int) -> Column:
                when = _EPOCH + timedelta(microseconds=min(micros, 253402300799_000000))
                return F.lit(when).cast("timestamp_ntz") if ntz else F.lit(when.replace(tzinfo=timezone.utc))

            if start is not None:
                df = df.where(F.col(self.ts) >= literal(-(-start // 1000)))
            if end is not None and end < MAX_TS:
                df = df.where(F.col(self.ts) <= literal(end // 1000))
        else:
            if start is not None:
                df = df.where(F.col(self.ts) >= start)
            if end is not None and end < MAX_TS:
                df = df.where(F.col(self.ts) <= end)
        return replace(self, df=df)

    def scoped(self, scopes: tuple[Scope, ...]) -> Source:
        df = self.df
        for s in scopes:
            if s.key not in self.tags:
                df = df.where(F.lit(False))
                continue
            col = F.col(s.key).cast("string")
            if s.kind == "exact":
                t = df.schema[s.key].dataType
                same = isinstance(t, T.StringType)
                df = df.where((F.col(s.key) == s.value) if same else (F.col(s.key) == F.lit(s.value).try_cast(t)) & (col == s.value))
            else:
                if s.prefix and isinstance(df.schema[s.key].dataType, T.StringType):
                    df = df.where(F.col(s.key).startswith(s.prefix))
                df = df.where(col.rlike(s.pattern))
        return replace(self, df=df)

    def series_key(self, field: Column) -> Column:
        """`measurement,tag=value,... field`, structural characters escaped."""

        def safe(x: Column) -> Column:
            return F.regexp_replace(x, r"([\\,= ])", r"\\$1")

        parts = [F.when(F.col(t).isNotNull(), F.concat(F.lit(","), safe(F.lit(t)), F.lit("="), safe(F.col(t).cast("string")))).otherwise("") for t in sorted(self.tags)]
        return F.concat(safe(F.lit(self.measurement)), *parts, F.lit(" "), safe(field))


POINTS = "measurement string, tags map<string,string>, field string, ts long, v double, l long, b boolean, s string, seq long"


def from_points(points: DataFrame, measurement: str, tags: list[str], fields: dict[str, str]) -> Source:
    """A Source over the canonical long table (POINTS). fields: name to kind."""
    column = {"double": "v", "long": "l", "boolean": "b", "string": "s"}
    df = points.where((F.col("measurement") == measurement) & F.col("field").isin(list(fields)))
    df = df.select(
        *[F.col("tags")[t].alias(t) for t in tags],
        F.col("ts").alias("_ts"),
        F.col("seq").alias("_seq"),
        *[F.when(F.col("field") == f, F.col(column[k])).alias(f) for f, k in fields.items()],
    )
    return Source(df, measurement, tuple(tags), tuple(fields), "_ts", "_seq", sparse=True)


def last_write_wins(source: Source) -> Source:
    """One row per (tags, ts): for each field, the value of the last row that has
    one. A NULL is no write; a NaN is."""
    if source.seq is None:
        return source
    aggs = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(source.seq))).alias(f) for f in source.fields]
    return replace(source, df=source.df.groupBy(*source.tags, source.ts).agg(*aggs), seq=None)
