"""Binary requests and responses: protocol buffers read and written by hand.

The wire format needs no generated code: a message is a row of tagged values, and
numeric arrays are packed, so they are read whole by numpy. Bodies are parsed on
the executors in Arrow batches; a bad write comes back with its reason and leaves
the others of its request alone. Values in an engine's own compressed codecs are
such a reason."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .writes import STEP

# Field numbers of the request and response messages.
REQUEST = {"writes": 1}
WRITE = {"measurement": 1, "tags": 2, "fields": 3, "timestamps": 4, "compressed": 5}
TYPED = {1: "v", 2: "b", 3: "s", 4: "l"}
SERIES = {"measurement": 1, "tags": 2, "fields": 3}
FIELD_DATA = {"timestamps": 1, "doubles": 2}
VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5

POINT = "measurement string, tags map<string,string>, field string, ts long, v double, l long, b boolean, s string, seq long, reason string"
_TYPES = [pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string()]


class WireError(ValueError):
    """A message that is cut off or malformed."""


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise WireError("a number is cut off")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & (1 << 64) - 1, at


def message(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of each tagged value."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        wire = tag & 7
        if wire == VARINT:
            value, at = varint(data, at)
        elif wire in (FIXED64, FIXED32):
            size = 8 if wire == FIXED64 else 4
            value, at = data[at : at + size], at + size
        elif wire == BYTES:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise WireError(f"unknown wire type {wire}")
        if at > len(data):
            raise WireError("a value is cut off")
        yield tag >> 3, wire, value


def varints(data: bytes) -> np.ndarray:
    """A packed array of numbers, as 64 bits each."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    if raw[-1] > 127:
        raise WireError("a number is cut off")
    ends = np.flatnonzero(raw < 128)
    start = np.concatenate([[0], ends[:-1] + 1])
    shift = 7 * (np.arange(len(raw)) - np.repeat(start, ends - start + 1))
    if shift.max() > 63:
        raise WireError("a number is too long")
    return np.add.reduceat((raw & 127).astype(np.uint64) << shift.astype(np.uint64), start).view(np.int64)


def text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        raise WireError("text is not UTF-8") from e


def numbers(data: bytes, number: int, doubles: bool = False) -> np.ndarray:
    """The values of a repeated number, packed or one by one."""
    parts = []
    for n, wire, value in message(data):
        if n != number:
            if value:
                raise WireError("compressed values are not supported")
        elif wire == BYTES:
            if doubles and len(value) % 8:
                raise WireError("a value is cut off")
            parts.append(np.frombuffer(value, "<f8") if doubles else varints(value))
        else:
            parts.append(np.frombuffer(value, "<f8") if doubles else np.array([value], np.uint64).view(np.int64))
    return np.concatenate(parts) if parts else np.zeros(0, np.float64 if doubles else np.int64)


def entry(data: bytes) -> tuple[str, bytes]:
    """Key and value of a map."""
    found = {n: v for n, _, v in message(data)}
    return text(found.get(1, b"")), found.get(2, b"")


def values(data: bytes) -> tuple[str, list]:
    """(column, values) of a typed array; the last of several counts."""
    column, out = "", []
    for n, _, value in message(data):
        if n not in TYPED:
            continue
        column = TYPED[n]
        if column == "s":
            out = [text(v) for k, _, v in message(value) if k == 1]
            if any(k == 2 and v for k, _, v in message(value)):
                raise WireError("compressed values are not supported")
        else:
            out = numbers(value, 1, column == "v")
            out = (out != 0 if column == "b" else out).tolist()
    return column, out


def write(data: bytes, now: int) -> list[tuple]:
    """(measurement, tags, field, ts, column, value) of each point of a write."""
    name, tags, fields, ts = "", {}, {}, []
    for n, wire, value in message(data):
        if n == WRITE["measurement"]:
            name = text(value)
        elif n == WRITE["tags"]:
            k, v = entry(value)
            tags[k] = text(v)
        elif n == WRITE["fields"]:
            k, v = entry(value)
            fields[k] = values(v)
        elif n == WRITE["timestamps"]:
            ts += varints(value).tolist() if wire == BYTES else [value]
        elif n == WRITE["compressed"] and value:
            raise WireError("compressed values are not supported")
    if not name or "\0" in name:
        raise WireError("measurement is missing")
    if not fields or any(not c for c, _ in fields.values()):
        raise WireError("fields are missing")
    if any(not v for v in tags.values()):
        raise WireError("a tag value is empty")
    size = len(ts) or max(len(v) for _, v in fields.values())
    if any(len(v) != size for _, v in fields.values()):
        raise WireError("values and timestamps differ in number")
    ts = ts or [now + i * STEP for i in range(size)]
    return [(name, list(tags.items()), f, t, c, x) for f, (c, xs) in fields.items() for t, x in zip(ts, xs, strict=True)]


def parse(bodies: DataFrame, now: int, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(points, failed): points as writes.parse() gives them, failed (reason) once
    for each write, or request, that cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for body, number in zip(batch.column("body").to_pylist(), batch.column("id").to_pylist(), strict=True):
                seq = number * 1_000_000
                try:
                    writes = [v for n, wire, v in message(body or b"") if n == REQUEST["writes"] and wire == BYTES]
                except WireError as e:
                    rows.append((None,) * 9 + (str(e),))
                    continue
                for one in writes:
                    try:
                        for name, tags, field, ts, kind, x in write(one, now):
                            rows.append((name, tags, field, ts, *(x if kind == c else None for c in "vlbs"), seq, None))
                            seq += 1
                    except WireError as e:
                        rows.append((None,) * 9 + (str(e),))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], [c.split()[0] for c in POINT.split(", ")])

    both = bodies.select(F.col(column).alias("body"), F.monotonically_increasing_id().alias("id")).mapInArrow(run, POINT)
    return both.where("reason IS NULL").drop("reason"), both.where("reason IS NOT NULL").select("reason")


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes(number: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(number << 3 | BYTES) + _varint(len(data)) + data


def _map(number: int, items: dict) -> bytes:
    return b"".join(_bytes(number, _bytes(1, str(k)) + _bytes(2, v)) for k, v in items.items())


def typed(column: str, xs: list) -> bytes:
    """A typed array of values."""
    number = next(n for n, c in TYPED.items() if c == column)
    if column == "s":
        return _bytes(number, b"".join(_bytes(1, x) for x in xs))
    return _bytes(number, _bytes(1, np.array(xs, "<f8").tobytes() if column == "v" else b"".join(_varint(int(x)) for x in xs)))


def request(writes: list[tuple[str, dict, dict, list]]) -> bytes:
    """A request of (measurement, tags, fields, timestamps) writes; fields: name to (column, values)."""
    out = []
    for name, tags, fields, ts in writes:
        stamps = _bytes(WRITE["timestamps"], b"".join(map(_varint, ts))) if ts else b""
        out.append(_bytes(REQUEST["writes"], _bytes(WRITE["measurement"], name) + _map(WRITE["tags"], tags) + _map(WRITE["fields"], {f: typed(*v) for f, v in fields.items()}) + stamps))
    return b"".join(out)


def response(result: DataFrame, measurement: str, keys: list[str]) -> DataFrame:
    """(keys, series): a result's groups as messages, all fields of a group in one;
    a missing value is NaN."""
    each = result.groupBy(*keys, "field").agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("p"))
    groups = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("field", F.col("p.ts").alias("ts"), F.col("p.value").alias("value")))).alias("fields"))
    tags = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keys]).cast("array<struct<k:string,v:string>>").alias("tags")
    groups = groups.select(F.struct(*keys).alias("keys") if keys else F.struct(F.lit(0)).alias("keys"), tags, "fields")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for named, fields in zip(batch.column("tags").to_pylist(), batch.column("fields").to_pylist(), strict=True):
                data = {}
                for f in fields:
                    doubles = np.array([np.nan if x is None else x for x in f["value"]], "<f8").tobytes()
                    data[f["field"]] = _bytes(FIELD_DATA["timestamps"], b"".join(map(_varint, f["ts"]))) + _bytes(FIELD_DATA["doubles"], _bytes(1, doubles))
                out.append(_bytes(SERIES["measurement"], measurement) + _map(SERIES["tags"], {t["k"]: t["v"] or "" for t in named}) + _map(SERIES["fields"], data))
            yield pa.RecordBatch.from_arrays([batch.column("keys"), pa.array(out, pa.binary())], ["keys", "series"])

    done = groups.mapInArrow(run, f"keys {groups.schema['keys'].dataType.simpleString()}, series binary")
    return done.select(*[F.col(f"keys.`{k}`").alias(k) for k in keys], "series")
