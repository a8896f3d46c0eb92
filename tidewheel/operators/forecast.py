"""Forecasting of one series: linear, seasonal (AR on differences), multi-season."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ieee import null
from ..parse.values import parse_duration
from .anomaly import period_of
from .stl import mstl

LEAST, CYCLES = 10, 4
AR_ORDER, SEASONAL_ORDER = 2, 1
MAX_DFT, LEAST_FOR_PERIODS, LEAST_ACF = 4096, 8, 0.2
HOUR = 3600 * 10**9


def _variance(x: np.ndarray) -> float:
    return float(x.var(ddof=1)) if len(x) > 1 else 0.0


def _acf(y: np.ndarray, lag: int) -> float:
    d = y - y.mean()
    total = float(d @ d)
    return float(d[: len(d) - lag] @ d[lag:]) / total if lag < len(y) and total >= 1e-10 else 0.0


def linear(ts: np.ndarray, y: np.ndarray, future: np.ndarray, deviations: float, model: str = "default") -> tuple[np.ndarray, np.ndarray]:
    """(forecast, half width) by weighted least squares on the index."""
    n = len(y)
    x, w = np.arange(n, dtype=float), np.ones(n)
    step = (int(ts[-1]) - int(ts[0])) // (n - 1) if n > 1 else 0
    if model == "simple":
        x, w, y = x[n // 2 :], w[n // 2 :], y[n // 2 :]
    elif model == "reactive":
        w = np.exp(-0.05 * (n - 1 - x))
    ok = np.isfinite(y)
    w, yy = np.where(ok, w, 0.0), np.where(ok, y, 0.0)
    n, total = len(y), w.sum()
    at = (future - int(ts[0])) / step if step else n + np.arange(len(future), dtype=float)
    if total <= 0:
        return np.zeros(len(future)), np.zeros(len(future))
    mx, my = (w * x).sum() / total, (w * yy).sum() / total
    sxx, sxy = (w * (x - mx) ** 2).sum(), (w * (x - mx) * (yy - my)).sum()
    slope = sxy / sxx if sxx >= 1e-10 else 0.0
    sse = (w * (yy - my - slope * (x - mx)) ** 2).sum()
    dev = math.sqrt(sse * n / (total * (n - 2))) if n > 2 else 0.0
    spread = np.sqrt(1 + 1 / n + (at - mx) ** 2 / sxx) if n >= 3 and sxx >= 1e-10 else np.ones(len(at))
    return my + slope * (at - mx), deviations * dev * spread


def levinson_durbin(r: list[float]) -> np.ndarray:
    """AR coefficients from autocovariances; cut off where they would be unstable."""
    order = len(r) - 1
    phi = np.zeros(order)
    if order < 1 or not abs(r[0]) > 1e-10 or abs(r[1] / r[0]) >= 1:
        return phi
    phi[0] = r[1] / r[0]
    v = r[0] * (1 - phi[0] ** 2)
    for k in range(1, order):
        if abs(v) < 1e-10:
            break
        reflection = (r[k + 1] - float(phi[:k] @ np.array(r[k:0:-1]))) / v
        if abs(reflection) >= 1:
            break
        phi[:k] = phi[:k] - reflection * phi[:k][::-1]
        phi[k] = reflection
        v *= 1 - reflection**2
    return phi


def _fit(y: np.ndarray, order: int, lag: int = 1) -> np.ndarray:
    variance = _variance(y)
    if order < 1 or len(y) <= order * lag + 1 or not variance > 1e-10:
        return np.zeros(order)
    return levinson_durbin([variance, *[_acf(y, k * lag) * variance for k in range(1, order + 1)]])


def guess_period(y: np.ndarray, interval: int) -> int:
    """The usual period with the largest autocorrelation above 0.3."""
    if len(y) < 24 or not _variance(y) > 1e-10:
        return 0
    usual = (60, 1440) if interval <= HOUR // 60 else (24, 168) if interval <= HOUR else (7, 30)
    best = max(((abs(_acf(y, p)), -p) for p in usual if p < len(y) // 2), default=(0.0, 0))
    return -best[1] if best[0] > 0.3 else 0


def detect_periods(y: np.ndarray, low: int = 4, high: int = 0, most: int = 3, threshold: float = 0.2) -> list[int]:
    """Periods by spectral peaks that the autocorrelation confirms, the surest first."""
    n = len(y)
    high = n // 2 if not high or high > n // 2 else high
    low = max(low, 2)
    ok = np.isfinite(y)
    if n < LEAST_FOR_PERIODS or low > high or not ok.any():
        return []
    y = np.where(ok, y, y[ok].mean())
    if y.max() - y.min() < 1e-10:
        return []
    x = np.arange(n) - (n - 1) / 2
    flat = y - y.mean() - x * ((x @ (y - y.mean())) / (x @ x))
    hann = flat * 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    every = -(-n // MAX_DFT)
    if every > 1:
        cuts = np.arange(0, n, every)
        hann = np.add.reduceat(hann, cuts) / np.diff(np.append(cuts, n))
    size = 1 << max(0, len(hann) - 1).bit_length()
    bins = len(hann) // 2 + 1
    power = np.abs(np.fft.fft(hann, size)[:bins]) ** 2 / ((bins - 1) * 2)
    middle = np.sort(power)[len(power) // 2]
    mad = np.sort(np.abs(power - middle))[len(power) // 2]
    floor = max(middle + (3 + threshold * 10) * mad, power.max() * threshold)
    found = []
    for k in range(1, len(power)):
        if power[k] >= floor and power[k] > power[k - 1] and (k + 1 == len(power) or power[k] > power[k + 1]):
            period = (size * every + k // 2) // k
            acf = _acf(flat, period) if low <= period <= high else 0.0
            if acf >= LEAST_ACF:
                found.append((math.sqrt(power[k] / power.max() * acf), period))
    return [p for _, p in sorted(found, key=lambda f: -f[0])[:most]]


def best_period(y: np.ndarray, interval: int) -> int:
    n = len(y)
    low, high = 4, min(n // 2, 100)
    if interval <= HOUR // 60:
        low, high = 4, min(n // 2, 1440)
    elif interval <= HOUR:
        low, high = 6, min(n // 2, 168)
    elif interval <= 24 * HOUR:
        low, high = 4, min(n // 2, 365)
    return next(iter(detect_periods(y, low, high, 1, 0.15)), 0)


def seasonal(ts: np.ndarray, values: np.ndarray, future: np.ndarray, deviations: float, seasonality: str | None) -> tuple[np.ndarray, np.ndarray]:
    """AR(2) and seasonal AR(1) on seasonal and first differences, differences undone."""
    h, n = len(future), len(values)
    steps = np.arange(h, dtype=float)
    if seasonality == "multi":
        return _multi(values, h, deviations)
    interval = (int(ts[-1]) - int(ts[0])) // (n - 1)
    ok = np.isfinite(values)
    y = np.where(ok, values, values[ok].mean())
    period = best_period(values, interval) if seasonality == "auto" else period_of(seasonality, interval) if seasonality else guess_period(values, interval)
    whole, cycle = y, 0 < period < len(y) // 2
    if cycle:
        y = y[period:] - y[:-period]
    last = y[-1]
    y = np.diff(y) if len(y) > 1 else y
    if len(y) < LEAST:
        return np.full(h, values[-1]), deviations * math.sqrt(_variance(values)) * np.sqrt(1 + steps)
    ar = _fit(y, min(AR_ORDER, len(y) // 4))
    sar = _fit(y, SEASONAL_ORDER, period) if cycle else np.zeros(0)
    path = np.concatenate([y, np.zeros(h)])
    for i in range(len(y), len(path)):
        path[i] = sum(a * path[i - 1 - k] for k, a in enumerate(ar)) + sum(a * path[i - (k + 1) * period] for k, a in enumerate(sar))
    out = last + np.cumsum(path[len(y) :])
    if cycle:
        # The last observed cycle is the base of every forecast cycle.
        out = out + whole[len(whole) - period + np.arange(h) % period]
    p = len(ar)
    fitted = sum((a * y[p - 1 - k : len(y) - 1 - k] for k, a in enumerate(ar)), np.zeros(len(y) - p))
    base = float(((y[p:] - fitted) ** 2).mean()) * 2
    return out, deviations * np.sqrt(base * (1 + np.sqrt(steps + 1)))


def _multi(values: np.ndarray, h: int, deviations: float) -> tuple[np.ndarray, np.ndarray]:
    n, steps = len(values), np.arange(h, dtype=float)
    grow = np.sqrt(1 + steps / n)
    parts = mstl(values, p) if (p := detect_periods(values)) else None
    if parts is None:
        return np.full(h, values[-1]), deviations * math.sqrt(_variance(values)) * grow
    trend, seasonals, periods, residual = parts
    k = min(n, max(10, n // 4))
    slope, start = np.polyfit(np.arange(k), trend[-k:], 1) if k > 1 else (0.0, trend[-1])
    out = slope * (k + steps) + start
    for s, period in zip(seasonals, periods, strict=True):
        out = out + s[(n - period + np.arange(h) % period) % n] * np.maximum(0.5, 1 - 0.01 * steps / period)
    return out, deviations * residual.std() * grow


def _window(ts: np.ndarray, y: np.ndarray, horizon: int, seasonality: str | None) -> int:
    """How many of the last points to use; all unless that trims over a third."""
    n = len(y)
    if seasonality in ("auto", "multi"):
        period = max(detect_periods(y), default=0)
    else:
        period = period_of(seasonality, max(1, (int(ts[-1]) - int(ts[0])) // (n - 1))) if seasonality else 0
    size = min(n, max(CYCLES * period if period else max(4 * horizon, 500), LEAST, 2 * horizon))
    return size if n > size * 3 // 2 else n


def predict(ts: np.ndarray, y: np.ndarray, algorithm: str, deviations: float, seasonality: str | None = None, model: str | None = None, history: str | None = None, horizon: int = 0, span: int = 0) -> pd.DataFrame:
    """(ts, past, forecast, upper, lower). span: end - start of the request, which
    sets the horizon if it is not given."""
    if history and len(ts):
        keep = ts >= ts[-1] - parse_duration(history)
        ts, y = ts[keep], y[keep]
    n = len(y)
    if n >= 2 and span > 0 and not horizon:
        gap = (int(ts[-1]) - int(ts[0])) // (n - 1)
        horizon = span // gap if gap else 0
    horizon = horizon or min(max(n // 5, 50), 2000)
    if n >= 2:
        size = _window(ts, y, horizon, seasonality)
        ts, y, n = ts[-size:], y[-size:], size
    if n < max(LEAST, 2) or not np.isfinite(y).any():
        return pd.DataFrame({"ts": ts, "past": y, "forecast": np.nan, "upper": np.nan, "lower": np.nan})
    gap = (int(ts[-1]) - int(ts[0])) // (n - 1)
    future = int(ts[-1]) + gap * np.arange(1, horizon + 1, dtype=np.int64)
    center, width = linear(ts, y, future, deviations, model or "default") if algorithm == "linear" else seasonal(ts, y, future, deviations, seasonality)
    nan = np.full(n, np.nan)
    # The forecast piece repeats the last value so that both lines meet.
    meet = nan.copy()
    meet[-1] = y[-1]
    return pd.DataFrame(
        {
            "ts": np.concatenate([ts, future]),
            "past": np.concatenate([y, np.full(horizon, np.nan)]),
            "forecast": np.concatenate([meet, center]),
            "upper": np.concatenate([nan, center + width]),
            "lower": np.concatenate([nan, center - width]),
        }
    )


def forecast(series: DataFrame, algorithm: str, deviations: float, seasonality: str | None = None, model: str | None = None, history: str | None = None, horizon: int = 0, span: int = 0, keys: list[str] = ()) -> DataFrame:
    """(keys, ts, past, forecast, upper, lower) of (keys, ts, value), each series by itself."""
    keys = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        out = predict(pdf["ts"].to_numpy("int64"), pdf["value"].to_numpy("float64", na_value=np.nan), algorithm, deviations, seasonality, model, history, horizon, span)
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in series.select(*keys).schema)
    out = series.groupBy(*(keys or [F.lit("all")])).applyInPandas(run, head + "ts long, past double, forecast double, upper double, lower double")
    return out.select(*keys, "ts", *[F.nanvl(c, null()).alias(c) for c in ("past", "forecast", "upper", "lower")])
