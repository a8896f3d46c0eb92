import json

import pytest

from tidewheel.operators import catalog, maintenance
from tidewheel.parse.values import ParseError
from tidewheel.plans.query import numeric
from tidewheel.sources import formats, writes
from tidewheel.sources.points import Source, from_points

NOW = 1_700_000_000_000_000_000
DAY = 86400 * 10**9


def parse(spark, *bodies, **kw):
    df = spark.createDataFrame([(json.dumps(b),) for b in bodies], "body string")
    good, bad = writes.parse(df, NOW, **kw)
    return good.collect(), bad.collect()


def point(**fields):
    return {"measurement": "m", "tags": {"h": "x"}, "fields": fields, "timestamp": 5}


def test_single_array_and_batch_writes(spark):
    good, bad = parse(spark, point(a=1.5, b=2, c=True, d="text"))
    assert {(r.field, r.v, r.l, r.b, r.s) for r in good} == {("a", 1.5, None, None, None), ("b", None, 2, None, None), ("c", None, None, True, None), ("d", None, None, None, "text")} and not bad
    good, _ = parse(spark, {"measurement": "m", "fields": {"a": [1.0, 2.0], "b": [1, 2]}, "timestamps": [7, 8]})
    assert {(r.field, r.ts) for r in good} == {("a", 7), ("a", 8), ("b", 7), ("b", 8)}
    good, _ = parse(spark, {"measurement": "m", "fields": {"a": [1.0, 2.0]}})
    assert sorted(r.ts for r in good) == [NOW, NOW + 10**6]
    good, _ = parse(spark, {"measurement": "m", "fields": {"a": [1.0, 2.0]}, "timestamp": 9})
    assert [r.ts for r in good] == [9, 9]
    good, bad = parse(spark, {"writes": [point(a=1.0), {"measurement": "", "fields": {"a": 1}}, {"measurement": "m", "fields": {}}, point(b=2.0)]})
    assert {r.field for r in good} == {"a", "b"} and len(bad) == 2


@pytest.mark.parametrize("value,kind,ok", [(10, "float", True), (10.5, "int", False), (1, "bool", False), (42, "string", False), (1.5, "decimal", False), ("x", "string", True), (True, "bool", True)])
def test_declared_types_are_strict(spark, value, kind, ok):
    good, bad = parse(spark, {**point(a=value), "field_types": {"a": kind}})
    assert (len(good), len(bad)) == ((1, 0) if ok else (0, 1))


def test_declaring_an_absent_field_fails(spark):
    assert len(parse(spark, {**point(a=1), "field_types": {"zz": "int"}})[1]) == 1


@pytest.mark.parametrize(
    "value,bound,want",
    [(10, "double", 10.0), (2**53 + 1, "double", None), (True, "double", 1.0), ("12.5", "double", 12.5), ("12abc", "double", None), (10.5, "long", None), (10.0, "long", 10), ("7", "long", 7), (False, "long", 0), (1, "boolean", True), (2, "boolean", None), ("true", "boolean", True), ("yes", "boolean", None), (5, "string", "5")],
)
def test_series_keep_their_first_type(spark, value, bound, want):
    types = spark.createDataFrame([("m", "a", bound)], "measurement string, field string, type string")
    good, bad = parse(spark, point(a=value), bound=types)
    if want is None:
        assert not good and len(bad) == 1
    else:
        r = good[0]
        assert {"double": r.v, "long": r.l, "boolean": r.b, "string": r.s}[bound] == want


def points(spark):
    rows = [("m", {"h": "a"}, "v", 1, 1.0, 0), ("m", {"h": "a"}, "v", 1, 2.0, 1), ("m", {"h": "b", "d": "x"}, "v", 2, 3.0, 2), ("m", {"h": "b", "d": "x"}, "w", 2, 4.0, 3), ("n", {}, "v", 3, 5.0, 4)]
    df = spark.createDataFrame(rows, "measurement string, tags map<string,string>, field string, ts long, v double, seq long")
    return df.selectExpr("measurement", "tags", "field", "ts", "v", "cast(null as long) l", "cast(null as boolean) b", "cast(null as string) s", "seq")


def test_written_points_can_be_queried_after_a_round_trip(spark, tmp_path):
    good, _ = writes.parse(spark.createDataFrame([(json.dumps(point(a=1.0)),), (json.dumps(point(a=3.0)),)], "body string"), NOW)
    path = str(tmp_path / "points")
    writes.append(good, path)
    writes.append(good.selectExpr("measurement", "tags", "field", "ts + 1 ts", "v", "l", "b", "s", "seq + 100 seq"), path)
    s = from_points(spark.read.parquet(path), "m", ["h"], {"a": "double"})
    out = numeric(s, "count:m(a){h:x}").collect()
    assert {(r.ts, r.value) for r in out} == {(5, 1.0), (6, 1.0)}
    assert writes.bind(good).first().type == "double"


def test_deletes(spark):
    p = points(spark)
    d = maintenance.Delete.parse
    left = lambda *b: sorted(r.seq for r in maintenance.delete(p, [d(x) for x in b]).collect())
    assert left({"measurement": "m"}) == [4]
    assert left({"measurement": "m", "tags": {"h": "b"}, "fields": ["w"]}) == [0, 1, 2, 4]
    # One field without a list aims at one exact series.
    assert left({"measurement": "m", "tags": {"h": "b"}, "field": "v"}) == [0, 1, 2, 3, 4]
    assert left({"measurement": "m", "tags": {"h": "b", "d": "x"}, "field": "v"}) == [0, 1, 3, 4]
    assert left({"measurement": "m", "startTime": 2, "endTime": 2}, {"measurement": "n"}) == [0, 1]
    assert left({"measurement": "m", "tags": {"h": "*"}}) == [0, 1, 2, 3, 4]
    with pytest.raises(ParseError):
        d({"measurement": "m", "startTime": 3, "endTime": 2})
    assert maintenance.deleted_series(p, [d({"measurement": "m"})]).count() == 3
    plan = maintenance.delete(p, [d({"measurement": "m"})])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_compaction(spark, tmp_path):
    out = maintenance.compact(points(spark), ttl={"n": "1d"}, now=2 * DAY)
    assert sorted((r.measurement, r.field, r.ts, r.v) for r in out.collect()) == [("m", "v", 1, 2.0), ("m", "v", 2, 3.0), ("m", "w", 2, 4.0)]
    # Compacting twice changes nothing.
    assert maintenance.compact(out).count() == 3
    path = str(tmp_path / "t")
    maintenance.rewrite(out, path)
    assert spark.read.parquet(path).where("measurement = 'm' AND day = 0").count() == 3
    # A table may be rewritten from itself.
    maintenance.rewrite(spark.read.parquet(path).drop("day").where("v < 4"), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2.0, 3.0]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


@pytest.mark.parametrize(
    "body,ok",
    [({"ttl": "90d"}, True), ({"downsample": {"after": "7d", "interval": "1h", "method": "max"}}, True), ({"ttl": "90d", "downsample": {"after": "30d", "interval": "5m", "method": "avg"}}, True), ({}, False), ({"downsample": {"after": "7d", "interval": "1h", "method": "median"}}, False), ({"downsample": {"after": "7d", "method": "avg"}}, False), ({"ttl": "7d", "downsample": {"after": "7d", "interval": "1h", "method": "avg"}}, False), ({"ttl": "7"}, False)],
)
def test_retention_policies(tmp_path, body, ok):
    book = maintenance.Policies(str(tmp_path / "p.json"))
    if not ok:
        with pytest.raises(ParseError):
            book.put({"measurement": "m", **body})
        return
    book.put({"measurement": "m", **body})
    assert maintenance.Policies(str(tmp_path / "p.json")).get("m") == book.get("m")
    assert book.remove("m") and not book.remove("m") and book.all() == []


def test_downsample_and_ttl(spark):
    rows = [("a", i * DAY // 4, float(i), i) for i in range(40)]
    s = Source(spark.createDataFrame(rows, "h string, ts long, v double, n long"), "m", ("h",), ("v", "n"), "ts")
    out = maintenance.downsample(s, maintenance.Downsample("5d", "1d", "avg"), 10 * DAY).collect()
    got = {(r.field, r.ts): r.value for r in out}
    assert got[("v", 0)] == 1.5 and got[("n", 0)] == 1.0 and got[("v", 5 * DAY)] == 20.0
    assert len(got) == 2 * (5 + 20)
    assert maintenance.expire(s, "1d", 10 * DAY).count() == 4


def test_catalog(spark):
    p = points(spark)
    assert [(r.measurement, r.total) for r in catalog.measurements(p).collect()] == [("m", 2), ("n", 2)]
    assert catalog.measurements(p, "n", 0, 5).first().measurement == "n" and catalog.measurements(p, offset=1, limit=1).count() == 1
    s = from_points(p, "m", ["h", "d"], {"v": "double", "w": "double"})
    assert {(r.key, r.value) for r in catalog.tags(s).collect()} == {("h", "a"), ("h", "b"), ("d", "x")}
    assert catalog.tags(s, "zz").count() == 0
    found = catalog.series(s)
    assert {r.series_key for r in found.collect()} == {"m,h=a v", "m,d=x,h=b v", "m,d=x,h=b w"}
    one = found.first()
    assert catalog.series_by_id(s, one.series_id).first().series_key == one.series_key
    assert catalog.fields(s) == [("v", "float"), ("w", "float")]
    assert {(r.field, r.n) for r in catalog.field_stats(s).collect()} == {("v", 2), ("v", 1), ("w", 1)}
    assert formats.split_series_key("m,d=x,h=b w") == ("m", {"d": "x", "h": "b"}, "w")


def test_responses(spark):
    s = Source(spark.createDataFrame([("a", 2, None, 1.0), ("a", 1, 3.0, float("inf"))], "h string, ts long, v double, w double"), "m", ("h",), ("v", "w"), "ts")
    body = json.loads(formats.response(numeric(s, "avg:m(){} by {h}"), "m", ["h"]).first().series)
    assert body == {"measurement": "m", "groupTags": {"h": "a"}, "fields": {"v": {"timestamps": [1], "values": [3.0]}, "w": {"timestamps": [1, 2], "values": [None, 1.0]}}}
