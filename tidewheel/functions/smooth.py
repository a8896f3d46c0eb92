"""Recursive and kernel smoothers over one series' arrays (ts in ns, NaN = missing)."""

from __future__ import annotations

import numpy as np


def ema(ts: np.ndarray, x: np.ndarray, alpha: float) -> np.ndarray:
    """Starts at the first value; a missing one repeats the average so far."""
    out = np.full(len(x), np.nan)
    s = np.nan
    for i, v in enumerate(x.tolist()):
        if v == v:
            s = v if s != s else alpha * v + (1 - alpha) * s
        out[i] = s
    return out


def holt_winters(ts: np.ndarray, x: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    """Level plus trend; a missing value is replaced by what was expected."""
    out = np.full(len(x), np.nan)
    level, trend = np.nan, 0.0
    for i, v in enumerate(x.tolist()):
        if level != level:
            if v == v:
                level = v
            out[i] = level
            continue
        expected = level + trend
        if v != v:
            level = expected
        else:
            before = level
            level = alpha * v + (1 - alpha) * expected
            trend = beta * (level - before) + (1 - beta) * trend
        out[i] = level
    return out


def gaussian(ts: np.ndarray, x: np.ndarray, sigma: float) -> np.ndarray:
    """Normal weights by index within three sigma, over the values there are."""
    radius = int(np.ceil(3 * sigma))
    radius = min(radius, max(1, len(x)))
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    have = ~np.isnan(x)
    top = np.convolve(np.where(have, x, 0.0), k)[radius : radius + len(x)]
    weight = np.convolve(have.astype(float), k)[radius : radius + len(x)]
    return np.where(weight > 0, top / np.where(weight > 0, weight, 1), np.nan)


def fill_linear(ts: np.ndarray, x: np.ndarray) -> np.ndarray:
    have = np.flatnonzero(~np.isnan(x))
    out = x.copy()
    for a, b in zip(have, have[1:], strict=False):
        if b > a + 1:
            gap = float(ts[b] - ts[a])
            share = (ts[a + 1 : b] - ts[a]) / gap if gap else 0.5
            out[a + 1 : b] = x[a] + (x[b] - x[a]) * share
    return out


def fill_spline(ts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Natural cubic spline through the values there are, between the first and
    the last; linear with fewer than three or with equal timestamps."""
    have = np.flatnonzero(~np.isnan(x))
    if len(have) < 3 or (np.diff(ts[have]) <= 0).any():
        return fill_linear(ts, x)
    t = (ts - ts[have[0]]) / 1e6
    k, y = t[have], x[have]
    h = np.diff(k)
    slope = np.diff(y) / h
    n = len(k)
    # Second derivatives: a tridiagonal system with zero ends.
    m = np.zeros(n)
    upper, right = np.zeros(n), np.zeros(n)
    for i in range(1, n - 1):
        pivot = 2 * (h[i - 1] + h[i]) - h[i - 1] * upper[i - 1]
        upper[i] = h[i] / pivot
        right[i] = (6 * (slope[i] - slope[i - 1]) - h[i - 1] * right[i - 1]) / pivot
    for i in range(n - 2, 0, -1):
        m[i] = right[i] - upper[i] * m[i + 1]
    out = x.copy()
    gaps = np.flatnonzero(np.isnan(x) & (np.arange(len(x)) > have[0]) & (np.arange(len(x)) < have[-1]))
    j = np.searchsorted(k, t[gaps], "right") - 1
    a, b = (k[j + 1] - t[gaps]) / h[j], (t[gaps] - k[j]) / h[j]
    out[gaps] = a * y[j] + b * y[j + 1] + ((a**3 - a) * m[j] + (b**3 - b) * m[j + 1]) * h[j] ** 2 / 6
    return out
