"""Writes: JSON bodies to the canonical points table, with type binding.

Bodies are parsed in the JVM (from_json on a text column), arrays are exploded,
and every field entry ends as one row with its value in the column of its type.
Bad entries come back with the reason, good ones are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = {"float": "double", "double": "double", "int": "long", "integer": "long", "int64": "long", "bool": "boolean", "boolean": "boolean", "string": "string"}
STEP = 10**6
_ENTRY = "measurement string, tags map<string,string>, fields map<string,string>, timestamp string, timestamps array<string>, field_types map<string,string>"


def entries(bodies: DataFrame, column: str = "body") -> DataFrame:
    """(raw, e): one row per write; a body is one entry or {"writes": [...]}."""
    many = F.from_json(F.col(column), "writes array<string>")["writes"]
    raw = F.explode(F.coalesce(many, F.array(F.col(column)))).alias("raw")
    return bodies.select(raw).withColumn("e", F.from_json("raw", _ENTRY))


def _literal(text: Column) -> Column:
    """The type a JSON literal has by itself; text: the raw JSON of a value."""
    return (
        F.when(text.isin("true", "false"), "boolean")
        .when(text.rlike(r"^-?\d+$"), "long")
        .when(text.rlike(r"^-?(\d+\.\d*|\d*\.\d+|\d+(\.\d*)?[eE][+-]?\d+)$"), "double")
        .otherwise("string")
    )


def coerce(text: Column, have: Column, want: Column) -> dict[str, Column]:
    """Lossless conversion of a literal to its series' type: the four value
    columns and `bad`. Booleans are 1 and 0 as numbers; integers become doubles
    only if they come back unchanged; strings must be numbers whole."""
    as_double = F.when(have == "boolean", F.when(text == "true", 1.0).otherwise(0.0)).otherwise(text.try_cast("double"))
    exact = as_double.isNotNull() & ((have != "long") | (as_double.try_cast("long") == text.try_cast("long")))
    whole = F.when(have == "boolean", F.when(text == "true", 1).otherwise(0).cast("long")).otherwise(F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long")), F.when(as_double == F.floor(as_double), as_double.try_cast("long"))))
    flag = F.when(have == "boolean", text == "true").when(as_double == 1.0, True).when(as_double == 0.0, False).when((have == "string") & text.isin("true", "false"), text == "true")
    v = F.when((want == "double") & exact, as_double)
    n = F.when(want == "long", whole)
    b = F.when(want == "boolean", flag)
    s = F.when(want == "string", text)
    return {"v": v, "l": n, "b": b, "s": s, "bad": F.coalesce(v.cast("string"), n.cast("string"), b.cast("string"), s).isNull()}


def parse(bodies: DataFrame, now: int, column: str = "body", bound: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, failed). bound: (measurement, field, type) of fields written
    before; others take the declared type or that of the literal. A declared type
    is strict: only an integer literal may widen, to a float."""
    e = entries(bodies, column).withColumn("_id", F.monotonically_increasing_id())
    f = F.col("e.fields")
    unknown = F.filter(F.map_values("e.field_types"), lambda t: ~F.lower(t).isin(list(TYPES)))
    stray = F.array_except(F.map_keys("e.field_types"), F.map_keys(f))
    reason = (
        F.when(F.col("e").isNull() | F.coalesce(F.col("e.measurement"), F.lit("")).isin("") | F.col("e.measurement").contains("\u0000"), "measurement is missing")
        .when(f.isNull() | (F.size(f) == 0), "fields are missing")
        .when(F.exists(F.map_values(F.coalesce(F.col("e.tags"), F.create_map().cast("map<string,string>"))), lambda t: F.coalesce(t, F.lit("")).isin("")), "a tag value is empty")
        .when(F.size(unknown) > 0, "unknown field type")
        .when(F.size(stray) > 0, "a declared field is absent")
    )
    e = e.withColumn("reason", reason)
    each = e.where("reason IS NULL").select("_id", "raw", "e", F.explode("e.fields").alias("field", "text"))
    # An array field has one value per timestamp.
    is_array = F.col("text").startswith("[")
    values = F.when(is_array, F.from_json("text", "array<string>")).otherwise(F.array("text"))
    each = each.select("*", F.posexplode(values).alias("_i", "_value"), is_array.alias("_array"))
    stamp = F.coalesce(F.get("e.timestamps", F.col("_i")), F.col("e.timestamp")).cast("long")
    each = each.withColumn("ts", F.coalesce(stamp, F.lit(now) + F.when(F.col("_array"), F.col("_i") * STEP).otherwise(0)))
    declared = F.lower(F.col("e.field_types")[F.col("field")])
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    # from_json drops the quotes of strings: the raw text tells a quoted number from a number.
    each = each.withColumn("_raw", F.get_json_object("raw", "$.fields"))
    quoted = F.expr("_raw RLIKE concat('\"', field, '\"\\\\s*:\\\\s*\\\\[?\\\\s*\"')")
    have = F.when(quoted, "string").otherwise(_literal(F.col("_value")))
    each = each.withColumns({"_have": have, "_declared": kinds[declared]})
    key = F.col("e.measurement").alias("measurement")
    each = each.withColumn("measurement", key)
    if bound is not None:
        each = each.join(bound.select("measurement", "field", F.col("type").alias("_bound")), ["measurement", "field"], "left")
    else:
        each = each.withColumn("_bound", F.lit(None).cast("string"))
    each = each.withColumn("_want", F.coalesce("_bound", "_declared", "_have"))
    fits = F.col("_declared").isNull() | (F.col("_declared") == F.col("_have")) | ((F.col("_declared") == "double") & (F.col("_have") == "long"))
    got = coerce(F.col("_value"), F.col("_have"), F.col("_want"))
    each = each.withColumns(got).withColumn("bad", F.col("bad") | ~fits)
    # An entry with one bad value is bad as a whole.
    worst = each.groupBy("_id").agg(F.bool_or("bad").alias("_bad"))
    each = each.join(worst, "_id")
    tags = F.coalesce(F.col("e.tags"), F.create_map().cast("map<string,string>")).alias("tags")
    seq = (F.col("_id") * 1_000_000 + F.col("_i")).alias("seq")
    points = each.where("NOT _bad").select("measurement", tags, "field", "ts", "v", "l", "b", "s", seq)
    failed = e.where("reason IS NOT NULL").select("raw", "reason").unionAll(each.where("_bad").select("raw", F.lit("a value does not fit its field's type").alias("reason")).distinct())
    return points, failed


def bind(points: DataFrame) -> DataFrame:
    """(measurement, field, type): what the first write of each field was."""
    kind = F.when(F.col("v").isNotNull(), "double").when(F.col("l").isNotNull(), "long").when(F.col("b").isNotNull(), "boolean").otherwise("string")
    return points.groupBy("measurement", "field").agg(F.min_by(kind, "seq").alias("type"))


def append(points: DataFrame, path: str) -> None:
    """Adds to a points table partitioned by measurement and day."""
    day = F.floor(F.col("ts") / F.lit(86400 * 10**9)).cast("int")
    points.withColumn("day", day).write.mode("append").partitionBy("measurement", "day").parquet(path)
