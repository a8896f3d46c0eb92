"""Trend and seasonal decompositions in numpy.

Two families that differ by design: `anomaly_stl` starts from a moving average
and uses subseries means; `stl` and `mstl` follow Cleveland's loop (cycle-subseries
LOESS, low-pass filter, LOESS trend, bisquare weights)."""

from __future__ import annotations

import math

import numpy as np


def window_mean(x: np.ndarray, before: int, after: int, missing: float = 0.0) -> np.ndarray:
    """Mean of the values there are in [i - before, i + after]; missing without any."""
    have = ~np.isnan(x)
    total = np.concatenate([[0.0], np.cumsum(np.where(have, x, 0.0))])
    count = np.concatenate([[0], np.cumsum(have)])
    i = np.arange(len(x))
    lo, hi = np.maximum(i - before, 0), np.minimum(i + after + 1, len(x))
    n = count[hi] - count[lo]
    return np.where(n > 0, (total[hi] - total[lo]) / np.maximum(n, 1), missing)


def _tricube(d: np.ndarray) -> np.ndarray:
    return np.where(d < 1, (1 - np.minimum(d, 1) ** 3) ** 3, 0.0)


def _line(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row-wise weighted sums for a local line; value at x = 0, total weight and determinant."""
    sw, swx, swy = w.sum(1), (w * x).sum(1), (w * y).sum(1)
    swxx, swxy = (w * x * x).sum(1), (w * x * y).sum(1)
    det = sw * swxx - swx * swx
    flat = swy / np.where(sw > 0, sw, 1)
    at = (swxx * swy - swx * swxy) / np.where(np.abs(det) < 1e-10, 1, det)
    return np.where(np.abs(det) < 1e-10, flat, at), sw, det


def _windows(n: int, starts: np.ndarray, ends: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = starts[rows], ends[rows]
    at = lo[:, None] + np.arange(int((hi - lo).max()))
    return np.minimum(at, n - 1), at < hi[:, None]


def loess_centred(y: np.ndarray, window: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Local lines over [i - window/2, i + window/2], tricube in distance / (half + 1)."""
    n, half = len(y), window // 2
    i = np.arange(n)
    out = np.full(n, np.nan)
    starts, ends = np.maximum(i - half, 0), np.minimum(i + half + 1, n)
    step = max(1, 2_000_000 // (window + 2))
    for a in range(0, n, step):
        rows = slice(a, min(a + step, n))
        at, live = _windows(n, starts, ends, rows)
        live &= ~np.isnan(y[at])
        x = (at - i[rows, None]).astype(float)
        w = _tricube(np.abs(x) / (half + 1)) * live
        if weights is not None:
            w = w * weights[at]
        value, _, _ = _line(w, x, np.where(live, y[at], 0.0))
        out[rows] = np.where(live.any(1), value, np.nan)
    return out


def loess_even(y: np.ndarray, span: float, weights: np.ndarray | None = None) -> np.ndarray:
    """Local lines over a window of ceil(span n) neighbours that stays inside the series."""
    n = len(y)
    if n < 2:
        return y.copy()
    window = min(n, max(2, math.ceil(min(max(span, 0.01) if span <= 0 else span, 1.0) * n)))
    half, i = window // 2, np.arange(n)
    starts = np.where(i < half, 0, np.where(i + half >= n, n - window, i - half))
    ends = np.minimum(starts + window, n)
    out = np.empty(n)
    step = max(1, 2_000_000 // window)
    for a in range(0, n, step):
        rows = slice(a, min(a + step, n))
        at, live = _windows(n, starts, ends, rows)
        x = (at - i[rows, None]).astype(float)
        far = np.maximum(i[rows] - starts[rows], ends[rows] - 1 - i[rows]).astype(float)
        w = _tricube(np.abs(x) / np.where(far > 0, far, 1)[:, None]) * live
        if weights is not None:
            w = w * weights[at]
        value, total, _ = _line(w, x, y[at])
        out[rows] = np.where(total > 0, value, y[rows])
    return out


def anomaly_stl(y: np.ndarray, period: int, seasonal_window: int = 7, rounds: int = 3, threshold: float = 6.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, residual)."""
    n = len(y)
    if period == 0 or period > n // 2:
        half = (n // 10 + 1) // 2
        trend = window_mean(y, half, half)
        return trend, np.zeros(n), y - trend
    seasonal_window = max(seasonal_window, 3) | 1
    trend_window = int(1.5 * period / (1 - 1.5 / seasonal_window)) | 1
    plain, weights = y.copy(), None
    phase = np.arange(n) % period
    for r in range(rounds):
        trend = window_mean(plain, trend_window // 2, trend_window // 2) if weights is None else loess_centred(plain, trend_window, weights)
        rest = y - trend
        have = ~np.isnan(rest)
        count = np.bincount(phase[have], minlength=period)
        mean = np.bincount(phase[have], rest[have], period) / np.maximum(count, 1)
        if (count > 0).any():
            mean = np.where(count > 0, mean - mean[count > 0].mean(), 0.0)
        seasonal = loess_centred(mean[phase], seasonal_window, weights)
        plain = y - seasonal
        residual = y - trend - seasonal
        if r + 1 < rounds:
            v = np.sort(residual[~np.isnan(residual)])
            spread = v[3 * len(v) // 4] - v[len(v) // 4] if len(v) >= 4 else 1.0
            h = threshold * spread
            weights = np.where(np.isnan(residual), 0.0, _tricube(np.abs(np.nan_to_num(residual)) / (h if h >= 1e-10 else 1.0)))
    return trend, seasonal, residual


def stl(y: np.ndarray, period: int, seasonal_window: int = 7, outer: int = 2, inner: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(trend, seasonal, residual), robust; None with fewer than two cycles."""
    n = len(y)
    if n < 2 * period or n == 0:
        return None
    trend_window = max(3, math.ceil(1.5 * period / (1 - 1.5 / seasonal_window))) | 1
    trend, seasonal, weights = np.zeros(n), np.zeros(n), None
    for o in range(outer):
        for _ in range(inner):
            rest = y - trend
            raw = np.empty(n)
            for k in range(period):
                sub = rest[k::period]
                raw[k::period] = loess_even(sub, min(1.0, max(0.1, seasonal_window / len(sub))))
            low = raw
            for w in (period, period, 3):
                low = window_mean(low, w // 2, w // 2)
            seasonal = raw - low
            trend = loess_even(y - seasonal, min(1.0, trend_window / n), weights)
        residual = y - trend - seasonal
        if o + 1 < outer:
            scale = 6 * np.median(np.abs(residual))
            u = np.abs(residual) / scale if scale >= 1e-10 else np.zeros(n)
            weights = np.where(u < 1, (1 - np.minimum(u, 1) ** 2) ** 2, 0.0)
    return trend, seasonal, residual


def mstl(y: np.ndarray, periods: list[int]) -> tuple[np.ndarray, list[np.ndarray], list[int], np.ndarray] | None:
    """(trend, seasonals, periods, residual), smallest period first."""
    periods = sorted(set(periods))
    if not len(y) or not periods or len(y) < 2 * periods[-1]:
        return None
    rest, seasonals = y.copy(), []
    for p in periods:
        s = stl(rest, p)[1]
        rest = rest - s
        seasonals.append(s)
    trend, _, residual = stl(rest, periods[-1], inner=1)
    return trend, seasonals, periods, residual
