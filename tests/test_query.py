"""Semantics of plain queries; expectations are worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidewheel.parse.values import ParseError
from tidewheel.plans.query import QueryError, check_limits, collapsed, numeric, typed
from tidewheel.sources.points import Source, from_points, last_write_wins

S = 10**9


def source(spark, rows, tags="p string", fields="v double", seq=False):
    cols = f"{tags}, ts long, {fields}" + (", seq long" if seq else "")
    names = lambda x: tuple(c.split()[0] for c in x.split(", "))
    return Source(spark.createDataFrame(rows, cols), "m", names(tags), names(fields), "ts", "seq" if seq else None)


def got(df, *cols):
    cols = cols or ("ts", "value")
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_equal_times_fold_across_series_never_over_time(spark):
    s = source(spark, [("front", i * S, 10.0 * i) for i in (1, 2, 3)] + [("back", i * S, 100.0 * i) for i in (1, 2, 3)])
    assert got(numeric(s, "avg:m(v){}")) == [(S, 55.0), (2 * S, 110.0), (3 * S, 165.0)]
    assert len(numeric(s, "latest:m(v){} by {p}").collect()) == 6
    assert got(numeric(s, "count:m(v){}"))[0] == (S, 2.0)
    assert got(numeric(s, "stddev:m(v){p:front}")) == [(S, 0.0), (2 * S, 0.0), (3 * S, 0.0)]


@pytest.mark.parametrize("method,want", [("avg", (14, 24)), ("min", (10, 20)), ("max", (18, 28)), ("sum", (70, 120)), ("latest", (18, 28)), ("first", (10, 20)), ("count", (5, 5)), ("median", (14, 24)), ("exact_median", (14, 24)), ("spread", (8, 8)), ("stdvar", (8, 8)), ("stddev", (math.sqrt(8), math.sqrt(8)))])
def test_five_minute_buckets(spark, method, want):
    s = source(spark, [("x", i * 60 * S, 10.0 + 2 * i) for i in range(10)])
    assert [v for _, v in got(numeric(s, f"{method}:m(v)", interval="5m"))] == pytest.approx(want)


def test_missing_values(spark):
    nan = math.nan
    s = source(spark, [("a", 1, nan), ("b", 1, 4.0), ("a", 2, nan), ("b", 2, nan), ("a", 3, None)])
    assert got(numeric(s, "avg:m(v)")) == [(1, 4.0), (2, None)]
    assert got(numeric(s, "count:m(v)")) == [(1, 1.0), (2, None)]
    assert got(numeric(source(spark, [("a", 1, math.inf), ("b", 1, 1.0)]), "max:m(v)")) == [(1, math.inf)]
    assert got(numeric(source(spark, []), "avg:m(v)", interval="1s")) == []


def test_time_range_and_alignment(spark):
    s = source(spark, [("x", t * S, 1.0) for t in range(10)])
    assert [t for t, _ in got(numeric(s, "sum:m(v)", 2 * S, 5 * S))] == [2 * S, 3 * S, 4 * S, 5 * S]
    assert got(numeric(s, "sum:m(v)", 1 * S, 9 * S, "4s")) == [(0, 3.0), (4 * S, 4.0), (8 * S, 2.0)]
    assert got(numeric(s, "sum:m(v)", 1 * S, 9 * S, "4s", "start")) == [(S, 4.0), (5 * S, 4.0), (9 * S, 1.0)]
    with pytest.raises(ParseError):
        numeric(s, "sum:m(v)", 5, 5)
    with pytest.raises(ParseError):
        numeric(s, "sum:m(v)", 1, 5, "1s", "middle")


def test_scopes(spark):
    s = source(spark, [("web-1", 1, 1.0), ("web_2", 1, 2.0), ("db%1", 1, 4.0), (None, 1, 8.0)])
    for scope, want in (("web-1", 1.0), ("web?2", 2.0), ("web*", 3.0), ("~web.[12]", 3.0), ("/db.*/", 4.0), ("~eb-1", None), ("*", 7.0), ("db%*", 4.0)):
        assert [v for _, v in got(numeric(s, f"sum:m(v){{p:{scope}}}"))] == ([want] if want else []), scope


def test_group_by_a_tag_that_some_or_no_series_carry(spark):
    pts = spark.createDataFrame([("m", {"a": "1"}, "v", 1, 2.0, 0), ("m", {"a": "1", "b": "x"}, "v", 1, 3.0, 1)], "measurement string, tags map<string,string>, field string, ts long, v double, seq long")
    pts = pts.selectExpr("*", "cast(null as long) l", "cast(null as boolean) b", "cast(null as string) s")
    s = from_points(pts, "m", ["a", "b", "c"], {"v": "double"})
    assert got(numeric(s, "sum:m(v){} by {b}"), "b", "value") == [("x", 3.0), (None, 2.0)]
    assert got(numeric(s, "sum:m(v){} by {c}")) == []
    assert got(numeric(s, "sum:m(v){} by {zzz}")) == []


def test_last_write_wins(spark):
    s = source(spark, [("h", 1, 1.0, 0), ("h", 1, 2.0, 2), ("h", 1, 3.0, 1), ("g", 1, 9.0, 0)], seq=True)
    assert got(numeric(s, "count:m(v){p:h}")) == [(1, 1.0)]
    assert got(numeric(s, "sum:m(v){p:h}")) == [(1, 2.0)]
    assert last_write_wins(s).df.count() == 2
    # The order of rows does not matter, only seq does.
    assert got(numeric(Source(s.df.orderBy(F.desc("seq")), "m", ("p",), ("v",), "ts", "seq"), "sum:m(v){p:h}")) == [(1, 2.0)]


def test_strings_and_booleans_keep_their_series(spark):
    rows = [("a", 1 * S, "x", True, 1), ("a", 2 * S, "y", False, 2), ("b", 1 * S, "z", None, 3)]
    s = source(spark, rows, fields="s string, b boolean, n long")
    assert got(typed(s, "avg:m(s)", interval="10s"), "p", "ts", "s") == [("a", 0, "y"), ("b", 0, "z")]
    assert got(typed(s, "count:m(b){} by {p}"), "p", "ts", "b") == [("a", S, True), ("a", 2 * S, False)]
    assert numeric(s, "avg:m(b)").count() == 0
    assert got(numeric(s, "sum:m(b)", interval="10s", booleans_as_numeric=True)) == [(0, 1.0)]
    assert got(numeric(s, "sum:m(n)", interval="10s")) == [(0, 6.0)]


def test_latest_ties_go_to_the_greatest_series_key(spark):
    s = source(spark, [("a", 1, 1.0), ("b", 1, 2.0)])
    assert got(numeric(s, "latest:m(v)")) == [(1, 2.0)] and got(numeric(s, "first:m(v)")) == [(1, 1.0)]


def test_collapsed_and_limits(spark):
    s = source(spark, [("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 7.0)])
    assert got(collapsed(s, "avg:m(v){} by {p}"), "p", "value") == [("a", 2.0), ("b", 7.0)]
    with pytest.raises(QueryError) as e:
        check_limits(numeric(s, "avg:m(v){} by {p}"), ["p"], series=1)
    assert e.value.code == "TOO_MANY_SERIES"


def test_partitioning_never_changes_a_result(spark):
    s = source(spark, [(f"h{i % 7}", (i * 37 % 100) * S, float(i)) for i in range(400)])
    base = got(numeric(s, "median:m(v){} by {p}", interval="10s"), "p", "ts", "value")
    moved = Source(s.df.repartition(5, "ts"), "m", ("p",), ("v",), "ts")
    assert got(numeric(moved, "median:m(v){} by {p}", interval="10s"), "p", "ts", "value") == base
    # Grouping never changes the set of timestamps.
    assert {t for t, _ in got(numeric(s, "sum:m(v)"))} == {t for t, _ in got(numeric(s, "sum:m(v){} by {p}"))}


def test_plan_prunes_columns_and_pushes_filters(spark, tmp_path):
    spark.range(100).selectExpr("cast(id % 3 as string) p", "timestamp_micros(id * 1000000) ts", "double(id) a", "double(id) b", "double(id) c").write.parquet(str(tmp_path / "t"))
    s = Source(spark.read.parquet(str(tmp_path / "t")), "m", ("p",), ("a", "b", "c"), "ts")
    plan = numeric(s, "avg:m(a){p:1}", 5 * S, 50 * S, "10s")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<p:string,ts:timestamp,a:double>" in plan
    assert "GreaterThanOrEqual(ts" in plan and "PushedFilters: [" in plan
    assert plan[plan.rindex("== Physical Plan ==") :].count("Exchange") == 1


def test_latest_of_single_series_is_a_hash_aggregation(spark):
    s = source(spark, [("a", 1, 1.0), ("a", 2, 2.0), ("b", 3, 3.0)])
    df = numeric(s, "latest:m(v){} by {p}", interval="10s")
    assert got(df, "p", "value") == [("a", 2.0), ("b", 3.0)]
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
