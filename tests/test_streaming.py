import pytest

from tidewheel.parse.values import ParseError
from tidewheel.sources.points import Source
from tidewheel.streaming import subscribe

S = 10**9
SCHEMA = "h string, ts timestamp, v double"


def write(spark, path, rows):
    df = spark.createDataFrame(rows, "h string, s double, v double").selectExpr("h", "timestamp_micros(cast(s * 1000000 as bigint)) ts", "v")
    df.coalesce(1).write.mode("append").parquet(path)
    return df


def source(df):
    return Source(df, "temp", ("h",), ("v",), "ts")


ROWS = [("a", 1.0, 10.0), ("a", 2.0, 20.0), ("a", 3.0, 30.0), ("b", 4.0, 1.0), ("a", 15.0, 7.0), ("a", 100.0, 1.0)]


def test_tumbling_stream_equals_the_batch(spark, tmp_path):
    batch = write(spark, str(tmp_path / "in"), ROWS)
    want = {(r.h, r.ts, r.value, r.n) for r in subscribe.tumbling(source(batch), "avg:temp(v)", "10s").collect()}
    assert ("a", 0, 20.0, 3) in want
    got = []
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = subscribe.subscribe(subscribe.tumbling(source(stream), "avg:temp(v)", "10s"), lambda df, i: got.extend(df.collect()), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    # The bucket that holds the watermark is still open.
    assert {(r.h, r.ts, r.value, r.n) for r in got} == {w for w in want if w[1] < 100 * S}


def test_raw_subscription_with_backfill_and_formula(spark, tmp_path):
    batch = write(spark, str(tmp_path / "in"), ROWS)
    seen = []
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    points = subscribe.raw(source(stream), "latest:temp(v){h:a}")
    history = subscribe.raw(source(batch), "latest:temp(v){h:b}")
    q = subscribe.subscribe(points, lambda df, i: seen.append((i, df.count(), {r.value for r in subscribe.batches(df, "a * 2", ["h"]).collect()})), str(tmp_path / "ck"), backfill=history, once=True)
    q.awaitTermination(120)
    assert seen[0] == (-1, 1, {2.0}) and seen[1][:2] == (0, 5) and 60.0 in seen[1][2]
    assert subscribe.active(spark) == []


def test_formula_over_two_queries_carries_values_forward(spark):
    a = spark.createDataFrame([(0, 1.0), (10, 2.0), (300, 3.0)], "ts long, value double")
    b = spark.createDataFrame([(0, 5.0), (150, 6.0)], "ts long, value double")
    got = [(r.ts, r.value) for r in subscribe.carried({"a": a, "b": b}, "a + b", 10).orderBy("ts").collect()]
    assert got == [(0, 6.0), (10, 7.0), (150, None), (300, None)]


def test_joined_stream_keeps_state(spark, tmp_path):
    path = str(tmp_path / "in")

    def stream(h):
        s = source(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path))
        return subscribe.raw(s, f"latest:temp(v){{h:{h}}}").select("ts", "value")

    write(spark, path, [("a", 0.0, 1.0), ("b", 0.0, 5.0), ("a", 10.0, 2.0)])
    got = []
    for _ in range(2):
        q = subscribe.joined({"a": stream("a"), "b": stream("b")}, "10s").writeStream.foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        write(spark, path, [("a", 20.0, 3.0)])
    assert [(r.ts // S, r.a, r.b) for r in sorted(got, key=lambda r: r.ts)] == [(0, 1.0, 5.0), (10, 2.0, 5.0), (20, 3.0, 5.0)]


def test_validation():
    ok = {"a": "avg:m(f)"}
    assert subscribe.validate(ok)["a"].method == "avg"
    subscribe.validate({**ok, "b": "sum:m(f)"}, "a / b", 10)
    for queries, formula, interval in (({}, None, 0), (ok, "a", 0), (ok, "anomalies(a, 'basic', 2)", 5), (ok, "time_shift(a, '1d')", 5), (ok, "b", 5), ({"q": "avg:m(f)"}, "q", 5), ({str(i): "avg:m(f)" for i in range(101)}, None, 0)):
        with pytest.raises(ParseError):
            subscribe.validate(queries, formula, interval)
