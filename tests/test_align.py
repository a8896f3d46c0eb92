from tidewheel.parse.values import ParseError
from tidewheel.plans.align import align, interpolate, resample
from tidewheel.plans.derived import DerivedQuery, derive, derive_by
from tidewheel.plans.query import QueryError
from tidewheel.sources.points import Source

import pytest

S = 10**9


def frame(spark, rows):
    return spark.createDataFrame(rows, "ts long, value double")


def rows(df, *cols):
    return [tuple(r[c] for c in cols or df.columns) for r in df.orderBy("ts").collect()]


def test_join_strategies(spark):
    a, b = frame(spark, [(1, 1.0), (2, 2.0), (3, None)]), frame(spark, [(2, 20.0), (3, 30.0), (4, 40.0)])
    assert rows(align({"a": a, "b": b})) == [(2, 2.0, 20.0), (3, None, 30.0)]
    assert rows(align({"a": a, "b": b}, "outer", mode="nan")) == [(1, 1.0, None), (2, 2.0, 20.0), (3, None, 30.0), (4, None, 40.0)]
    assert rows(align({"b": b, "a": a}, "left", mode="previous")) == [(1, 1.0, None), (2, 2.0, 20.0), (3, None, 30.0)]
    c = frame(spark, [(0, 0.0), (4, 8.0)])
    assert rows(align({"a": frame(spark, [(1, 1.0), (6, 5.0)]), "c": c}, "outer")) == [(0, 1.0, 0.0), (1, 1.0, 2.0), (4, 3.4, 8.0), (6, 5.0, 8.0)]
    plan = align({"a": a, "b": b, "c": a, "d": b})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("mode,want", [("linear", [1.0, 1.0, 1.5, 3.0, 3.0]), ("previous", [None, 1.0, 1.0, 3.0, 3.0]), ("next", [1.0, 1.0, 3.0, 3.0, None]), ("zero", [0.0, 1.0, 0.0, 3.0, 0.0]), ("nan", [None, 1.0, None, 3.0, None])])
def test_interpolation(spark, mode, want):
    src, at = frame(spark, [(10, 1.0), (18, 3.0)]), frame(spark, [(t, 0.0) for t in (5, 10, 12, 18, 30)])
    assert [v for _, v in rows(interpolate(src, at, mode))] == want


def test_a_missing_value_is_still_a_point(spark):
    src, at = frame(spark, [(10, 1.0), (20, None), (30, 3.0)]), frame(spark, [(15, 0.0), (20, 0.0), (25, 0.0)])
    assert [v for _, v in rows(interpolate(src, at))] == [None, None, None]


def test_resample_uses_points_outside_the_common_ones(spark):
    a = frame(spark, [(0, 0.0), (10, 10.0), (40, 40.0)])
    b = frame(spark, [(0, 0.0), (20, 2.0), (40, 4.0)])
    assert rows(resample({"a": a, "b": b}, 10)) == [(t, float(t), t / 10) for t in (0, 10, 20, 30, 40)]


def test_a_single_series_is_resampled_too(spark):
    assert rows(align({"a": frame(spark, [(10, 1.0), (40, 4.0)])}, interval=10)) == [(t, t / 10) for t in (10, 20, 30, 40)]


def test_resample_leaves_axes_that_would_be_too_long(spark):
    a = frame(spark, [(0, 0.0), (10**12, 1.0)])
    assert rows(resample({"a": a, "b": a}, 10)) == [(0, 0.0, 0.0), (10**12, 1.0, 1.0)]


def metrics(spark):
    data = [("cpu", i * S, 10.0 * i) for i in range(1, 11)] + [("memory", i * S, 5.0 * i) for i in range(1, 11)]
    return {"system": Source(spark.createDataFrame(data, "metric string, ts long, value double"), "system", ("metric",), ("value",), "ts")}


def build(text):
    return DerivedQuery().query("a", "avg:system(value){metric:cpu}").query("b", "avg:system(value){metric:memory}").formula(text).between(1, 100 * S)


@pytest.mark.parametrize("text,want", [("a + b", 15.0), ("a - b", 5.0), ("a * b", 50.0), ("a / b", 2.0), ("(a / (a + b)) * 100", 200 / 3)])
def test_derived_formulas(spark, text, want):
    out = rows(derive(metrics(spark), build(text)))
    assert len(out) == 10 and out[0][1] == pytest.approx(want)


def test_derived_rules(spark):
    m = metrics(spark)
    # A query the formula does not name is not even looked up.
    assert derive(m, build("a").query("z", "avg:unknown(x)")).count() == 10
    with pytest.raises(QueryError):
        derive(m, build("z").query("z", "avg:unknown(x)"))
    with pytest.raises(QueryError):
        derive(m, DerivedQuery().query("a", "avg:system(value){} by {metric}").formula("a"))
    for bad in (DerivedQuery().formula("a"), build(""), build("a + q"), DerivedQuery({str(i): "avg:m(f)" for i in range(11)}, "a")):
        with pytest.raises(ParseError):
            derive(m, bad)
    by = derive_by(m, DerivedQuery().query("a", "avg:system(value)").formula("delta(a)"), ["metric"])
    assert {(r.metric, r.value) for r in by.collect()} == {("cpu", 90.0), ("memory", 45.0)}
    shift = derive(m, build("time_shift(a, '1s') * 2"))
    assert rows(shift)[0] == (2 * S, 20.0)
    assert [r.ts for r in derive(m, build("a").every("3s")).orderBy("ts").collect()] == [0, 3 * S, 6 * S, 9 * S]


def test_interval_reaches_anomalies(spark):
    out = derive(metrics(spark), build("anomalies(a, 'basic', 2)").every("2s"))
    assert [r.ts for r in out.orderBy("ts").collect()] == [i * 2 * S for i in range(6)]
