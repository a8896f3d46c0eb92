import math

import numpy as np
import pytest

from tidewheel.operators import anomaly, forecast, groups, stl

M = 60 * 10**9


def frame(spark, values, keys=None):
    return spark.createDataFrame([(i * M, v if v is None else float(v)) for i, v in enumerate(values)], "ts long, value double")


def basic_reference(x, bounds):
    out, past = [], []
    for i, v in enumerate(x):
        if v is None:
            mean = sum(past[-60:]) / len(past[-60:]) if past else 0.0
            out.append((None, None, 0.0, mean) if i < 10 else (mean + bounds, mean - bounds, 0.0, mean))
            continue
        w = past[-60:]
        if i < 10:
            out.append((math.inf, -math.inf, 0.0, v))
        else:
            mean = sum(w) / len(w) if w else 0.0
            sd = math.sqrt(sum((a - mean) ** 2 for a in w) / (len(w) - 1)) if len(w) > 1 else 0.0
            sd = max(sd, abs(mean) * 0.01)
            sd = sd if sd >= 1e-10 else 1.0
            up, lo = mean + bounds * sd, mean - bounds * sd
            out.append((up, lo, max(0, v - up) + max(0, lo - v), mean))
        past.append(v)
    return out


def test_basic_anomalies(spark):
    rng = np.random.default_rng(0)
    x = [float(v) for v in 50 + rng.normal(0, 2, 150)]
    x[100] = 90.0
    for i in (3, 40, 41, 120):
        x[i] = None
    have = anomaly.detect(frame(spark, x), "basic", 2.0).orderBy("ts").collect()
    for r, want in zip(have, basic_reference(x, 2.0), strict=True):
        for a, b in zip((r.upper, r.lower, r.scores, r.predictions), want, strict=True):
            assert (a is None and b is None) or a == pytest.approx(b), r
    assert have[100].scores > 20 and anomaly.alert(anomaly.detect(frame(spark, x), "basic", 2.0)).first().alert == pytest.approx(have[100].scores)
    assert anomaly.pieces(anomaly.detect(frame(spark, x), "basic", 2.0)).count() == 5 * 150


def test_agile_and_robust_find_spikes(spark):
    i = np.arange(600)
    x = (100 + 10 * np.sin(2 * np.pi * i / 60) + np.random.default_rng(1).normal(0, 0.5, 600)).tolist()
    x[400], x[200] = 200.0, None
    for algorithm in ("agile", "robust"):
        rows = anomaly.detect(frame(spark, x), algorithm, 3.0, "hourly").orderBy("ts").collect()
        top = max(rows, key=lambda r: r.scores or 0)
        assert top.ts == 400 * M and rows[200].scores == 0.0
        assert sum((r.scores or 0) > 0 for r in rows) < 60
    early = anomaly.detect(frame(spark, x), "agile", 3.0, "hourly").orderBy("ts").limit(15).collect()
    assert all(r.upper == math.inf for r in early)


def test_period_and_interval():
    assert anomaly.interval_of(np.arange(100) * M) == M
    assert anomaly.interval_of(np.array([5])) == M
    assert anomaly.period_of("hourly", M) == 60 and anomaly.period_of(None, M) == 0
    with pytest.raises(ValueError):
        anomaly.period_of("weekly", 1000)


def test_decompositions_recover_parts():
    i = np.arange(480)
    season, trend = 5 * np.sin(2 * np.pi * i / 24), 0.05 * i
    t, s, r = stl.stl(trend + season, 24)
    assert np.abs(s - season)[24:-24].max() < 0.5 and np.abs(t - trend)[48:-48].max() < 0.5
    assert np.allclose(t + s + r, trend + season)
    assert stl.stl(np.arange(10.0), 24) is None
    t, s, r = stl.anomaly_stl(trend + season, 24)
    assert np.allclose(t + s + r, trend + season) and np.abs(r)[48:-48].max() < 2
    t, s, r = stl.anomaly_stl(np.array([1.0, np.nan, 3.0]), 0)
    assert not s.any() and np.isnan(r[1])
    parts = stl.mstl(season + 3 * np.cos(2 * np.pi * i / 7), [24, 7])
    assert parts[2] == [7, 24] and len(parts[1]) == 2
    # Local lines reproduce a line, with and without weights.
    assert np.allclose(stl.loess_even(2.0 * i + 1, 0.1), 2 * i + 1)
    assert np.allclose(stl.loess_centred(2.0 * i + 1, 21, np.ones(480)), 2 * i + 1)
    x = np.array([1.0, np.nan, 3.0, 8.0])
    assert stl.window_mean(x, 1, 1).tolist() == [1.0, 2.0, 5.5, 5.5]


def test_linear_forecast_extends_a_line(spark):
    for model in ("default", "simple", "reactive"):
        out = forecast.forecast(frame(spark, [3 + 2 * i for i in range(40)]), "linear", 2.0, model=model, horizon=5).orderBy("ts").collect()
        assert [r.forecast for r in out[-5:]] == pytest.approx([3 + 2 * i for i in range(40, 45)])
        assert out[39].forecast == 81.0 and out[39].upper is None and out[38].forecast is None and out[-1].past is None
        assert out[-1].upper == pytest.approx(out[-1].lower, abs=1e-6)


def test_forecast_needs_ten_points_and_widens(spark):
    short = forecast.forecast(frame(spark, range(9)), "linear", 2.0).collect()
    assert all(r.forecast is None for r in short) and len(short) == 9
    x = (np.random.default_rng(2).normal(0, 1, 100) + 10).tolist()
    out = forecast.forecast(frame(spark, x), "seasonal", 2.0, horizon=30).orderBy("ts").collect()[-30:]
    width = [r.upper - r.lower for r in out]
    assert width == sorted(width) and width[0] > 0


def test_seasonal_forecasts_repeat_the_cycle(spark):
    i = np.arange(480)
    x = 50 + 10 * np.sin(2 * np.pi * i / 60)
    want = 50 + 10 * np.sin(2 * np.pi * np.arange(480, 540) / 60)
    for seasonality in ("hourly", None):
        out = forecast.forecast(frame(spark, x), "seasonal", 2.0, seasonality, horizon=60).orderBy("ts").collect()[-60:]
        assert np.abs(np.array([r.forecast for r in out]) - want).max() < 1.5, seasonality
    # A power of two is a period that the spectrum resolves exactly.
    z = 50 + 10 * np.sin(2 * np.pi * np.arange(512) / 32)
    auto = forecast.forecast(frame(spark, z), "seasonal", 2.0, "auto", horizon=32).orderBy("ts").collect()[-32:]
    assert np.abs(np.array([r.forecast for r in auto]) - z[:32]).max() < 1.5
    multi = forecast.forecast(frame(spark, z), "seasonal", 2.0, "multi", horizon=32).orderBy("ts").collect()[-32:]
    assert np.abs(np.array([r.forecast for r in multi]) - z[:32]).max() < 4


def test_periods_are_detected():
    i = np.arange(512)
    noise = np.random.default_rng(3).normal(0, 0.3, 512)
    assert abs(forecast.detect_periods(np.sin(2 * np.pi * i / 32) * 5 + noise)[0] - 32) <= 1
    assert forecast.detect_periods(np.ones(100)) == [] and forecast.detect_periods(np.arange(5.0)) == []
    assert forecast.guess_period(np.sin(2 * np.pi * i / 60), M) == 60
    assert forecast.guess_period(np.arange(10.0), M) == 0


def test_ar_coefficients():
    # AR(1) autocovariances give back phi, and no second coefficient.
    assert forecast.levinson_durbin([1.0, 0.5, 0.25]) == pytest.approx([0.5, 0.0])
    assert forecast.levinson_durbin([0.0, 0.0]).tolist() == [0.0]
    assert forecast.levinson_durbin([1.0, 1.0, 1.0]).tolist() == [0.0, 0.0]


def test_window_of_history():
    ts, y = np.arange(5000) * M, np.sin(np.arange(5000) / 9.55)
    assert forecast._window(ts, y, 50, None) == 500 and forecast._window(ts, y, 50, "hourly") == 240
    assert forecast._window(ts[:600], y[:600], 50, None) == 600
    out = forecast.predict(ts, y, "linear", 2.0, history="10m", horizon=3)
    assert len(out) == 11 + 3


def test_group_rank_and_fold(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 5.0), ("c", 2, None), ("d", 1, 2.0)], "k string, ts long, value double")
    assert {r.k for r in groups.topk(df, ["k"], 2).collect()} == {"a", "b"}
    assert {r.k for r in groups.bottomk(df, ["k"], 2).collect()} == {"a", "c"}
    assert groups.topk(df, ["k"], 0).count() == 0
    with pytest.raises(ValueError):
        groups.topk(df, ["k"], -1)
    assert {(r.ts, r.value) for r in groups.of_series(df, "sum").collect()} == {(1, 8.0), (2, 3.0)}
    assert {(r.ts, r.value) for r in groups.of_series(df, "percentile", 50).collect()} == {(1, 2.0), (2, 3.0)}
