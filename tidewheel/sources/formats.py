"""Series keys and response bodies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_series_key(key: str) -> tuple[str, dict[str, str], str]:
    """measurement, tags and field of `measurement,tag=value field`; a backslash
    keeps the next character from being structure."""
    parts = re.findall(r"(?:\\.|[^\\, ])+|[, ]", key, re.S)

    def plain(x: str) -> str:
        return re.sub(r"\\(.)", r"\1", x, flags=re.S)

    if not parts or parts[0] in ", ":
        raise ValueError(f"invalid series key: {key!r}")
    measurement, tags, field, at = plain(parts[0]), {}, "", 1
    while at < len(parts):
        if parts[at] == "," and not field and at + 1 < len(parts):
            m = re.fullmatch(r"((?:\\.|[^\\=])+)=((?:\\.|[^\\=])+)", parts[at + 1], re.S)
            if not m:
                raise ValueError(f"invalid tag in series key: {parts[at + 1]!r}")
            tags[plain(m[1])] = plain(m[2])
        elif parts[at] == " " and not field and at + 2 == len(parts):
            field = plain(parts[at + 1])
        else:
            raise ValueError(f"invalid series key: {key!r}")
        at += 2
    return measurement, tags, field


def response(result: DataFrame, measurement: str, keys: list[str]) -> DataFrame:
    """One row per group: its JSON series object, with all fields, points in time
    order and missing values as null."""
    # Infinities have no JSON form; they too are null.
    value = F.when(F.abs("value") < float("inf"), F.col("value"))
    each = result.groupBy(*keys, "field").agg(F.array_sort(F.collect_list(F.struct("ts", value.alias("value")))).alias("_p"))
    field = F.struct(F.col("field").alias("field"), F.col("_p.ts").alias("timestamps"), F.col("_p.value").alias("values"))
    fields = F.array_sort(F.collect_list(field))
    tags = F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k).cast("string"))]) if keys else F.create_map().cast("map<string,string>")
    body = F.to_json(F.struct(F.lit(measurement).alias("measurement"), F.col("_tags").alias("groupTags"), F.map_from_entries(F.transform("_fields", lambda f: F.struct(f["field"], F.struct(f["timestamps"].alias("timestamps"), f["values"].alias("values"))))).alias("fields")), {"ignoreNullFields": "false"})
    return each.groupBy(*keys).agg(fields.alias("_fields")).withColumn("_tags", tags).select(*keys, body.alias("series"))


def statistics(result: DataFrame, keys: list[str]) -> DataFrame:
    """(series_count, point_count) of a result."""
    return result.agg(F.count_distinct(F.struct(*keys, "field")).alias("series_count"), F.count("*").alias("point_count"))
