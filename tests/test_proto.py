"""Binary requests and responses."""

import struct

import numpy as np
import pytest

from tidewheel.plans.query import numeric
from tidewheel.sources import proto
from tidewheel.sources.points import Source

# {writes: [{measurement: "m", tags: {"h": "x"}, fields: {"f": {double_values: [1.5, -2.0]}}, timestamps: [1, 300]}]}, by hand.
GOLDEN = b"\x0a\x2b\x0a\x01m\x12\x06\x0a\x01h\x12\x01x\x1a\x19\x0a\x01f\x12\x14\x0a\x12\x0a\x10" + struct.pack("<dd", 1.5, -2.0) + b"\x22\x03\x01\xac\x02"


def parse(spark, *bodies):
    good, bad = proto.parse(spark.createDataFrame([(bytearray(b),) for b in bodies], "body binary"), 7)
    return good.collect(), [r.reason for r in bad.collect()]


def test_bytes_by_hand(spark):
    assert proto.request([("m", {"h": "x"}, {"f": ("v", [1.5, -2.0])}, [1, 300])]) == GOLDEN
    good, bad = parse(spark, GOLDEN)
    assert [(r.measurement, r.tags, r.field, r.ts, r.v) for r in good] == [("m", {"h": "x"}, "f", 1, 1.5), ("m", {"h": "x"}, "f", 300, -2.0)] and not bad


def test_every_type_and_bad_writes(spark):
    fields = {"v": ("v", [0.5, float("inf")]), "l": ("l", [-1, 2**63 - 1]), "b": ("b", [True, False]), "s": ("s", ["é", ""])}
    ok = ("m", {}, fields, [5, 6])
    wrong = [("", {}, fields, [5, 6]), ("m", {}, {}, [5]), ("m", {"h": ""}, fields, [5, 6]), ("m", {}, fields, [5])]
    good, bad = parse(spark, proto.request([ok, *wrong]), b"\x0a\xff", b"")
    assert {(r.field, r.ts, r.v, r.l, r.b, r.s) for r in good} == {
        *(("v", t, x, None, None, None) for t, x in ((5, 0.5), (6, float("inf")))),
        *(("l", t, None, x, None, None) for t, x in ((5, -1), (6, 2**63 - 1))),
        *(("b", t, None, None, x, None) for t, x in ((5, True), (6, False))),
        *(("s", t, None, None, None, x) for t, x in ((5, "é"), (6, ""))),
    }
    assert len(bad) == 5
    # Without timestamps points follow one another from now on.
    assert [r.ts for r in parse(spark, proto.request([("m", {}, {"v": ("v", [1.0, 2.0])}, [])]))[0]] == [7, 7 + 10**6]
    packed = proto._bytes(1, proto._bytes(1, "m") + proto._map(3, {"f": proto._bytes(1, proto._bytes(2, b"zz"))}))
    assert parse(spark, packed)[1] == ["compressed values are not supported"]


def test_numbers_of_any_length():
    xs = [0, 1, 127, 128, 300, 2**32, 2**63 - 1, -1, -(2**63)]
    data = b"".join(map(proto._varint, xs))
    assert proto.varints(data).tolist() == xs
    at, out = 0, []
    while at < len(data):
        x, at = proto.varint(data, at)
        out.append(x)
    assert out == [x % 2**64 for x in xs]
    for cut in (b"\x80", b"\x80" * 11 + b"\x01"):
        with pytest.raises(proto.WireError):
            proto.varints(cut)


def test_response(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 3.0), ("a", 2, 2.0, None), ("b", 1, 5.0, 6.0)], "h string, ts long, x double, y double")
    result = numeric(Source(df, "m", ("h",), ("x", "y"), "ts"), "avg:m(x,y){} by {h}")
    got = {r.h: bytes(r.series) for r in proto.response(result, "m", ["h"]).collect()}
    series = {}
    for n, _, v in proto.message(got["a"]):
        if n == 3:
            name, data = proto.entry(v)
            parts = {k: x for k, _, x in proto.message(data)}
            series[name] = (proto.varints(parts[1]).tolist(), proto.numbers(parts[2], 1, True).tolist())
        else:
            assert v == b"m" if n == 1 else proto.entry(v) == ("h", b"a")
    assert series["x"] == ([1, 2], [1.0, 2.0]) and series["y"][1][0] == 3.0 and np.isnan(series["y"][1][1:]).all()
