"""Formula functions against plain Python over small frames with gaps."""

import math

import numpy as np
import pytest

from tidewheel.functions import smooth
from tidewheel.parse.formula import parse_formula
from tidewheel.plans.formula import Compiler, EvaluationError

S = 10**9
INF = math.inf


def run(spark, text, a, b=None, ts=None):
    b = b if b is not None else [1.0] * len(a)
    ts = ts or [(i + 1) * S for i in range(len(a))]
    df = spark.createDataFrame([(t, x, y) for t, x, y in zip(ts, a, b, strict=True)], "ts long, a double, b double")
    return [r.value for r in Compiler(df, ["a", "b"]).result(parse_formula(text)).orderBy("ts").collect()]


@pytest.mark.parametrize(
    "text,a,b,want",
    [
        ("a / b", [1.0, -1.0, 0.0, None, 6.0, INF], [0.0, 0.0, 0.0, 0.0, 3.0, 0.0], [INF, -INF, None, None, 2.0, INF]),
        ("a / 0", [1.0, 0.0], None, [INF, None]),
        ("1 / 0 + a", [1.0], None, [INF]),
        ("a - b", [INF, 1.0], [INF, None], [None, None]),
        ("log(a)", [0.0, -1.0, 1.0, INF], None, [None, None, 0.0, INF]),
        ("sqrt(a)", [-1.0, 4.0], None, [None, 2.0]),
        ("ceil(a)", [1.2, -1.2, INF, 1e300, None], None, [2.0, -1.0, INF, 1e300, None]),
        ("floor(a)", [1.2, -1.2, -INF], None, [1.0, -2.0, -INF]),
        ("round(a)", [2.5, -2.5, 0.4, INF], None, [3.0, -3.0, 0.0, INF]),
        ("sign(a)", [-3.0, 0.0, 5.0, None], None, [-1.0, 0.0, 1.0, None]),
        ("min(a, b)", [1.0, None, None], [2.0, 3.0, None], [1.0, 3.0, None]),
        ("max(a, b)", [1.0, None], [2.0, 3.0], [2.0, 3.0]),
        ("pow(a, b)", [-8.0, 2.0], [1 / 3, 10.0], [None, 1024.0]),
        ("clamp(a, 2, 4)", [1.0, 3.0, 9.0, None], None, [2.0, 3.0, 4.0, None]),
        ("clamp(a, 4, 2)", [1.0], None, [None]),
        ("clamp_min(a, b)", [1.0, 9.0], [5.0, 100.0], [5.0, 9.0]),
        ("cutoff_min(a, 2)", [1.0, 2.0, None], None, [None, 2.0, None]),
        ("cutoff_max(a, 2)", [1.0, 3.0], None, [1.0, None]),
        ("default_zero(a)", [None, 2.0], None, [0.0, 2.0]),
        ("fill_value(a, 7)", [None, 2.0], None, [7.0, 2.0]),
        ("as_percent(a, b)", [1.0, 1.0], [4.0, 0.0], [25.0, None]),
        ("avg_of_series(a, b)", [1.0, None, None], [3.0, 5.0, None], [2.0, 5.0, None]),
        ("sum_of_series(a, b)", [1.0, None], [3.0, None], [4.0, None]),
        ("count_of_series(a, b)", [1.0, None], [3.0, None], [2.0, 0.0]),
        ("stddev_of_series(a, b)", [1.0, None], [3.0, 5.0], [1.0, 0.0]),
        ("percentile_of_series(50, a, b)", [1.0, None], [3.0, 5.0], [2.0, 5.0]),
        ("histogram_quantile(50, 1, a, 2, b, 10)", [4.0, 0.0, None, 12.0], [8.0, 0.0, 1.0, 3.0], [1.25, 2.0, None, 0.5]),
        ("topk(0, a)", [1.0], None, []),
        ("bottomk(3, a)", [1.0], None, [1.0]),
        ("diff(a)", [1.0, 3.0, None, 2.0], None, [None, 2.0, None, None]),
        ("monotonic_diff(a)", [5.0, 7.0, 2.0], None, [None, 2.0, 2.0]),
        ("rate(a)", [5.0, 7.0, 2.0, None, 3.0], None, [None, 2.0, 0.0, None, None]),
        ("irate(a)", [5.0, 7.0, 8.5], None, [1.5, 1.5, 1.5]),
        ("irate(a)", [5.0], None, [None]),
        ("increase(a)", [1.0, 3.0, None, 2.0, 5.0], None, [5.0] * 5),
        ("deriv(a)", [5.0, 2.0], None, [None, -3.0]),
        ("delta(a)", [None, 2.0, 7.0, None], None, [5.0] * 4),
        ("idelta(a)", [1.0, 2.0, None, 7.0, None], None, [5.0] * 5),
        ("changes(a)", [1.0, 1.0, None, 2.0, 1.0], None, [2.0] * 5),
        ("resets(a)", [3.0, None, 1.0, 2.0, 0.0], None, [2.0] * 5),
        ("per_minute(a, 1)", [0.0, 2.0, 1.0], None, [None, 120.0, -60.0]),
        ("count_nonzero(a)", [0.0, 2.0, None], None, [1.0] * 3),
        ("count_not_null(a)", [0.0, 2.0, None], None, [2.0] * 3),
        ("fill_forward(a)", [None, 1.0, None, 2.0], None, [None, 1.0, 1.0, 2.0]),
        ("fill_backward(a)", [None, 1.0, None], None, [1.0, 1.0, None]),
        ("fill_linear(a)", [None, 1.0, None, None, 4.0, None], None, [None, 1.0, 2.0, 3.0, 4.0, None]),
        ("cumsum(a)", [None, 1.0, None, 2.0], None, [0.0, 1.0, 1.0, 3.0]),
        ("integral(a)", [1.0, 3.0, None, 2.0, 4.0], None, [0.0, 2.0, 2.0, 2.0, 5.0]),
        ("normalize(a)", [1.0, 3.0, None, 2.0], None, [0.0, 1.0, None, 0.5]),
        ("normalize(a)", [2.0, 2.0], None, [0.0, 0.0]),
        ("standardize(a)", [1.0, 3.0, None], None, [-1.0, 1.0, None]),
        ("rolling_avg(a, 2)", [1.0, None, 3.0, 5.0], None, [None, 1.0, 3.0, 4.0]),
        ("rolling_sum(a, 2)", [None, None, 3.0], None, [None, None, 3.0]),
        ("rolling_median(a, 3)", [1.0, 9.0, 3.0, None], None, [None, None, 3.0, 6.0]),
        ("rolling_percentile(a, 2, 25)", [1.0, 5.0], None, [None, 2.0]),
        ("rolling_stddev(a, 2)", [2.0, None, 4.0], None, [None, 1.0, 2.0]),
        ("rolling_stddev(a, 1)", [2.0], None, [0.0]),
        ("zscore(a, 2)", [1.0, 3.0, 3.0, None, 5.0], None, [None, 1.0, 0.0, None, None]),
        ("ema(a, 0.5)", [None, 2.0, 4.0, None, 8.0], None, [None, 2.0, 3.0, 3.0, 5.5]),
        ("ema(a, 3)", [2.0, 4.0], None, [2.0, 3.0]),
        ("holt_winters(a, 0.5, 0.5)", [None, 2.0, 4.0, None], None, [None, 2.0, 3.0, 3.5]),
        ("rolling_avg(diff(a), 2) * 2", [1.0, 2.0, 4.0, 8.0], None, [None, 2.0, 3.0, 6.0]),
        ("2 * 3", [1.0], None, [6.0]),
    ],
)
def test_function(spark, text, a, b, want):
    have = run(spark, text, a, b)
    assert len(have) == len(want)
    for x, y in zip(have, want, strict=True):
        assert (x is None and y is None) or x == pytest.approx(y), (text, have)


def test_spline_reproduces_a_line_and_passes_knots():
    ts = np.arange(6) * S
    y = np.array([0.0, 1, np.nan, 3, np.nan, 5])
    assert np.allclose(smooth.fill_spline(ts, y), np.arange(6))
    assert np.isnan(smooth.fill_spline(ts, np.array([np.nan, 1, np.nan, 3, 4, np.nan]))[[0, 5]]).all()
    # A natural spline through (0, 0), (1, 1), (2, 0) is 11/16 at 0.5.
    fine = smooth.fill_spline(np.array([0, 5, 10, 20]) * S // 10, np.array([0.0, np.nan, 1, 0]))
    assert fine[1] == pytest.approx(11 / 16)


def test_gaussian_keeps_constants_and_skips_gaps():
    x = np.array([2.0, 2, np.nan, 2, 2])
    assert np.allclose(smooth.gaussian(np.arange(5), x, 1.0), 2.0)
    brute = []
    y = np.array([1.0, 5, 2, np.nan, 7, 3])
    for i in range(6):
        w = [(math.exp(-0.5 * ((j - i) / 1.5) ** 2), y[j]) for j in range(6) if abs(j - i) <= 5 and not math.isnan(y[j])]
        brute.append(sum(k * v for k, v in w) / sum(k for k, _ in w))
    assert np.allclose(smooth.gaussian(np.arange(6), y, 1.5), brute)


def test_time_shift_moves_the_axis(spark):
    df = spark.createDataFrame([(5 * S, 1.0), (6 * S, 2.0)], "ts long, a double")
    rows = Compiler(df, ["a"]).result(parse_formula("time_shift(a, '-5500ms') + 1")).orderBy("value").collect()
    assert [(r.ts, r.value) for r in rows] == [(0, 2.0), (500_000_000, 3.0)]
    with pytest.raises(EvaluationError):
        Compiler(df, ["a"]).result(parse_formula("a - time_shift(a, '1d')"))


@pytest.mark.parametrize("text", ["rolling_avg(a, 0)", "ema(a, 0)", "ema(a, b)", "holt_winters(a, 0, 1)", "gaussian_smooth(a, -1)", "topk(-1, a)", "percentile_of_series(101, a)", "histogram_quantile(50, 2, a, 1, b, b)", "zzz + 1"])
def test_bad_parameters(spark, text):
    with pytest.raises(EvaluationError):
        run(spark, text, [1.0])


def test_windows_stay_inside_groups(spark):
    df = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 3.0), ("y", 1, 10.0), ("y", 2, 15.0)], "k string, ts long, a double")
    rows = Compiler(df, ["a"], ["k"]).result(parse_formula("diff(a) + 0 * ema(a, 1)")).collect()
    assert sorted((r.k, r.ts, r.value) for r in rows if r.value is not None) == [("x", 2, 2.0), ("y", 2, 5.0)]
