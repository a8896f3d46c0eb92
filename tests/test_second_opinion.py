"""Recursions and decompositions that SQL cannot say, against plain loops written
from their definitions, one point at a time."""

import math
import random
import statistics

import numpy as np
import pytest

from tidewheel.functions import smooth
from tidewheel.operators import anomaly, forecast, stl

HOUR = 3600 * 10**9


def series(n, seed, period=24, trend=0.05, missing=0.0):
    rng = random.Random(seed)
    return [math.nan if rng.random() < missing else 20 + trend * i + 5 * math.sin(2 * math.pi * i / period) + rng.gauss(0, 1) for i in range(n)]


def tricube(d):
    return (1 - d**3) ** 3 if d < 1 else 0.0


def local_line(points):
    """Value at 0 of the weighted line through (x, y, w)."""
    w = math.fsum(p[2] for p in points)
    if w <= 0:
        return None
    mx = math.fsum(p[0] * p[2] for p in points) / w
    my = math.fsum(p[1] * p[2] for p in points) / w
    sxx = math.fsum(p[2] * (p[0] - mx) ** 2 for p in points)
    if sxx * w < 1e-10:
        return my
    return my - mx * math.fsum(p[2] * (p[0] - mx) * (p[1] - my) for p in points) / sxx


def centred(y, window, weights):
    half, out = window // 2, []
    for i in range(len(y)):
        near = [j for j in range(max(0, i - half), min(len(y), i + half + 1)) if not math.isnan(y[j])]
        at = local_line([(j - i, y[j], tricube(abs(j - i) / (half + 1)) * (weights[j] if weights else 1)) for j in near]) if near else math.nan
        out.append(0.0 if at is None else at)
    return out


def even(y, span, weights=None):
    n = len(y)
    if n < 2:
        return list(y)
    window = min(n, max(2, math.ceil(span * n)))
    half, out = window // 2, []
    for i in range(n):
        lo = 0 if i < half else n - window if i + half >= n else i - half
        hi = min(lo + window, n)
        far = max(i - lo, hi - 1 - i) or 1
        at = local_line([(j - i, y[j], tricube(abs(j - i) / far) * (weights[j] if weights else 1)) for j in range(lo, hi)])
        out.append(y[i] if at is None else at)
    return out


def mean_around(y, half):
    out = []
    for i in range(len(y)):
        have = [v for v in y[max(0, i - half) : i + half + 1] if not math.isnan(v)]
        out.append(math.fsum(have) / len(have) if have else 0.0)
    return out


def plain_anomaly_stl(y, period):
    n, weights, plain = len(y), None, list(y)
    window = int(1.5 * period / (1 - 1.5 / 7)) | 1
    for r in range(3):
        trend = mean_around(plain, window // 2) if weights is None else centred(plain, window, weights)
        by = [[y[i] - trend[i] for i in range(k, n, period) if not math.isnan(y[i] - trend[i])] for k in range(period)]
        means = [math.fsum(b) / len(b) if b else 0.0 for b in by]
        middle = statistics.fmean(m for m, b in zip(means, by, strict=True) if b)
        seasonal = centred([means[i % period] - middle if by[i % period] else 0.0 for i in range(n)], 7, weights)
        plain = [a - s for a, s in zip(y, seasonal, strict=True)]
        residual = [a - t - s for a, t, s in zip(y, trend, seasonal, strict=True)]
        if r < 2:
            v = sorted(x for x in residual if not math.isnan(x))
            h = 6 * (v[3 * len(v) // 4] - v[len(v) // 4])
            weights = [0.0 if math.isnan(x) else tricube(abs(x) / h) for x in residual]
    return trend, seasonal, residual


@pytest.mark.parametrize("missing", [0.0, 0.05])
def test_robust_anomalies(missing):
    y = series(200, 1, missing=missing)
    y[77] = 90.0
    ts = np.arange(200) * HOUR
    upper, lower, scores, at = anomaly.robust(ts, np.array(y), 3, "daily")
    trend, seasonal, residual = plain_anomaly_stl(y, 24)
    r = [x for x in residual if not math.isnan(x)]
    middle = statistics.median(r)
    sigma = max(1.4826 * statistics.median(abs(x - middle) for x in r), 0.01 * max(abs(x) for x in y if not math.isnan(x)))
    for i, v in enumerate(y):
        p = trend[i] + seasonal[i]
        assert at[i] == pytest.approx(p, abs=1e-6) and upper[i] == pytest.approx(p + 3 * sigma, abs=1e-6) and lower[i] == pytest.approx(p - 3 * sigma, abs=1e-6)
        assert scores[i] == pytest.approx(0 if math.isnan(v) else max(v - p - 3 * sigma, 0) + max(p - 3 * sigma - v, 0), abs=1e-6)
    assert scores[77] == max(scores) > 0


def plain_stl(y, period, inner=2):
    n, weights = len(y), None
    window = max(3, math.ceil(1.5 * period / (1 - 1.5 / 7))) | 1
    trend = [0.0] * n
    for o in range(2):
        for _ in range(inner):
            raw = [0.0] * n
            for k in range(period):
                sub = [y[i] - trend[i] for i in range(k, n, period)]
                raw[k::period] = even(sub, min(1.0, max(0.1, 7 / len(sub))))
            low = raw
            for w in (period, period, 3):
                low = mean_around(low, w // 2)
            seasonal = [a - b for a, b in zip(raw, low, strict=True)]
            trend = even([a - b for a, b in zip(y, seasonal, strict=True)], min(1.0, window / n), weights)
        residual = [a - t - s for a, t, s in zip(y, trend, seasonal, strict=True)]
        if o == 0:
            scale = 6 * statistics.median(map(abs, residual))
            weights = [(1 - min(abs(x) / scale, 1) ** 2) ** 2 for x in residual]
    return trend, seasonal, residual


def test_decompositions_of_one_and_several_seasons():
    y = [a + 2 * math.cos(2 * math.pi * i / 7) for i, a in enumerate(series(150, 2))]
    for have, want in zip(stl.stl(np.array(y), 24), plain_stl(y, 24), strict=True):
        assert np.allclose(have, want, atol=1e-6)
    trend, seasonals, periods, residual = stl.mstl(np.array(y), [24, 7])
    rest, parts = list(y), []
    for p in (7, 24):
        parts.append(plain_stl(rest, p)[1])
        rest = [a - b for a, b in zip(rest, parts[-1], strict=True)]
    last = plain_stl(rest, 24, inner=1)
    assert periods == [7, 24] and all(np.allclose(a, b, atol=1e-6) for a, b in zip(seasonals, parts, strict=True))
    assert np.allclose(trend, last[0], atol=1e-6) and np.allclose(residual, last[2], atol=1e-6)


def plain_acf(y, lag):
    m = statistics.fmean(y)
    return math.fsum((a - m) * (b - m) for a, b in zip(y, y[lag:], strict=False)) / math.fsum((a - m) ** 2 for a in y)


def test_seasonal_forecast():
    n, h, period = 240, 60, 24
    y = series(n, 3)
    ts = np.arange(n, dtype=np.int64) * HOUR
    have, width = forecast.seasonal(ts, np.array(y), ts[-1] + HOUR * np.arange(1, h + 1), 2, "daily")
    d = [y[i] - y[i - period] for i in range(period, n)]
    e = [b - a for a, b in zip(d, d[1:], strict=False)]
    variance = statistics.variance(e)
    r = [variance, *(plain_acf(e, k) * variance for k in (1, 2))]
    # Yule-Walker of order two, solved by hand.
    det = r[0] ** 2 - r[1] ** 2
    ar = [(r[1] * r[0] - r[1] * r[2]) / det, (r[0] * r[2] - r[1] ** 2) / det]
    season = plain_acf(e, period)
    path = list(e)
    for _ in range(h):
        path.append(ar[0] * path[-1] + ar[1] * path[-2] + season * path[-period])
    level = d[-1]
    mse = statistics.fmean((e[i] - ar[0] * e[i - 1] - ar[1] * e[i - 2]) ** 2 for i in range(2, len(e)))
    for k in range(h):
        level += path[len(e) + k]
        assert have[k] == pytest.approx(level + y[n - period + k % period], abs=1e-6)
        assert width[k] == pytest.approx(2 * math.sqrt(2 * mse * (1 + math.sqrt(k + 1))), abs=1e-6)


def test_natural_spline():
    """Cubic pieces with equal slopes and curvatures at the knots and none at the ends, as one dense system."""
    rng = random.Random(4)
    k = sorted(rng.sample(range(60), 9))
    y = [rng.uniform(-5, 5) for _ in k]
    x = np.full(60, np.nan)
    x[k] = y
    n = len(k) - 1
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    row = 0
    for i in range(n):
        h = k[i + 1] - k[i]
        a[row, 4 * i], b[row] = 1, y[i]
        a[row + 1, 4 * i : 4 * i + 4], b[row + 1] = [1, h, h**2, h**3], y[i + 1]
        row += 2
        if i + 1 < n:
            a[row, 4 * i + 1 : 4 * i + 4], a[row, 4 * i + 5] = [1, 2 * h, 3 * h**2], -1
            a[row + 1, 4 * i + 2 : 4 * i + 4], a[row + 1, 4 * i + 6] = [2, 6 * h], -2
            row += 2
    a[row, 2] = 2
    a[row + 1, 4 * n - 2 : 4 * n] = [2, 6 * (k[n] - k[n - 1])]
    c = np.linalg.solve(a, b)
    got = smooth.fill_spline(np.arange(60) * 10**9, x)
    for t in range(60):
        if t < k[0] or t > k[-1]:
            assert math.isnan(got[t])
        else:
            i = min(n - 1, max(j for j in range(n + 1) if k[j] <= t))
            u = t - k[i]
            assert got[t] == pytest.approx(c[4 * i] + c[4 * i + 1] * u + c[4 * i + 2] * u**2 + c[4 * i + 3] * u**3, abs=1e-6)
