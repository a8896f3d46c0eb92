"""Anomaly detection: basic (rolling mean), agile (Holt-Winters), robust (STL).

`basic` is window expressions only; the other two are recursions over one series
and run once per series in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ieee import null
from .stl import anomaly_stl

SEASONS = {None: 0, "hourly": 3600 * 10**9, "daily": 86400 * 10**9, "weekly": 7 * 86400 * 10**9}
WINDOW, LEAST = 60, 10
ALPHA, BETA, GAMMA = 0.3, 0.1, 0.3
MAX_PERIOD = 10_000_000
PIECES = ("raw", "upper", "lower", "scores", "predictions")


def interval_of(ts: np.ndarray) -> int:
    """Median of up to ten gaps at the start, the middle and the end."""
    if len(ts) < 2:
        return 60 * 10**9
    gaps, n = np.diff(ts), len(ts) - 1
    k = min(n, 10)
    some = np.concatenate([gaps[:k], gaps[n // 2 : n // 2 + k] if n > 20 else gaps[:0], gaps[max(0, n - k) :] if n > 10 else gaps[:0]])
    some = np.sort(some[some > 0])
    return int(some[len(some) // 2]) if len(some) else 60 * 10**9


def period_of(seasonality: str | None, interval: int) -> int:
    period = SEASONS[seasonality] // interval
    if period > MAX_PERIOD:
        raise ValueError(f"seasonal period of {period} points is too large")
    return period


def basic(series: DataFrame, bounds: float, keys: list[str] = ()) -> DataFrame:
    """The window counts values that are there: missing ones are numbered apart."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("ts")
    df = series.withColumn("_i", F.row_number().over(w) - 1)
    have = F.col("value").isNotNull()
    # A missing value sees the values up to it, as many as the window holds.
    df = df.withColumn("_k", F.count("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.when(have, 1).otherwise(0))
    seen = df.where(have).withColumn("_n", F.row_number().over(w) - 1)
    past = Window.partitionBy(*keys).orderBy("_n").rowsBetween(-WINDOW, -1)
    seen = seen.withColumns({"_mean": F.avg("value").over(past), "_dev": F.coalesce(F.stddev_samp("value").over(past), F.lit(0.0))})
    upto = Window.partitionBy(*keys).orderBy("_n").rowsBetween(-(WINDOW - 1), 0)
    seen = seen.withColumn("_upto", F.avg("value").over(upto))
    both = seen.unionByName(df.where(~have), allowMissingColumns=True)
    before = F.last("_upto", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("_before", before)
    early = F.col("_i") < LEAST
    prediction = F.when(~have, F.coalesce("_before", F.lit(0.0))).when(early, F.col("value")).otherwise(F.coalesce("_mean", F.lit(0.0)))
    dev = F.greatest(F.col("_dev"), F.abs(F.coalesce("_mean", F.lit(0.0))) * 0.01)
    scale = F.when(~have, 1.0).otherwise(F.when(dev < 1e-10, 1.0).otherwise(dev))
    inf = F.lit(math.inf)
    both = both.withColumns({"predictions": prediction, "_w": scale * bounds})
    both = both.withColumns(
        {
            "upper": F.when(early, F.when(have, inf).otherwise(null())).otherwise(F.col("predictions") + F.col("_w")),
            "lower": F.when(early, F.when(have, -inf).otherwise(null())).otherwise(F.col("predictions") - F.col("_w")),
        }
    )
    score = F.greatest(F.col("value") - F.col("upper"), F.lit(0.0)) + F.greatest(F.col("lower") - F.col("value"), F.lit(0.0))
    return both.select(*keys, "ts", F.col("value").alias("raw"), "upper", "lower", F.when(have & ~early, score).otherwise(0.0).alias("scores"), "predictions")


def _scores(x: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        s = np.maximum(x - upper, 0) + np.maximum(lower - x, 0)
    return np.where(np.isnan(x), 0.0, s)


def agile(ts: np.ndarray, x: np.ndarray, bounds: float, seasonality: str | None) -> tuple[np.ndarray, ...]:
    """(upper, lower, scores, predictions)."""
    n = len(x)
    period = period_of(seasonality, interval_of(ts))
    if period > n:
        period = 0
    head = x[: period or min(30, n)]
    head = head[~np.isnan(head)]
    level, trend = (float(head.mean()) if len(head) else 0.0), 0.0
    season = np.zeros(max(period, 1))
    if period:
        season = np.where(np.isnan(x[:period]), 0.0, x[:period] - level)
        season -= season.mean()
    season = season.tolist()
    predictions, errors = np.empty(n), np.full(n, np.nan)
    for i, v in enumerate(x.tolist()):
        k = i % period if period else 0
        s = season[k] if period else 0.0
        predictions[i] = level + trend + s
        if v == v:
            errors[i] = v - predictions[i]
            before = level
            level = ALPHA * (v - s) + (1 - ALPHA) * (before + trend)
            trend = BETA * (level - before) + (1 - BETA) * trend
            if period:
                season[k] = GAMMA * (v - level) + (1 - GAMMA) * s
    least = max(LEAST, max(period // 4, 2))
    # Sample deviation of the last 60 errors there are, the current one included.
    dev = pd.Series(errors).dropna().rolling(WINDOW, min_periods=2).std(ddof=1).reindex(range(n)).ffill().fillna(0.0).to_numpy()
    scale = np.maximum(dev, np.abs(predictions) * 0.01)
    scale = np.where(scale < 1e-10, 1.0, scale)
    early = np.arange(n) < least
    upper = np.where(early, np.inf, predictions + bounds * scale)
    lower = np.where(early, -np.inf, predictions - bounds * scale)
    return upper, lower, np.where(early, 0.0, _scores(x, upper, lower)), predictions


def robust(ts: np.ndarray, x: np.ndarray, bounds: float, seasonality: str | None) -> tuple[np.ndarray, ...]:
    trend, seasonal, residual = anomaly_stl(x, period_of(seasonality, interval_of(ts)))
    predictions = trend + seasonal
    r = residual[~np.isnan(residual)]
    if not len(r):
        upper, lower = np.full(len(x), np.inf), np.full(len(x), -np.inf)
    else:
        sigma = 1.4826 * np.median(np.abs(r - np.median(r)))
        sigma = max(sigma, 0.01 * np.nanmax(np.abs(x)))
        sigma = sigma if sigma >= 1e-10 else 1.0
        upper, lower = predictions + bounds * sigma, predictions - bounds * sigma
    return upper, lower, _scores(x, upper, lower), predictions


def detect(series: DataFrame, algorithm: str, bounds: float, seasonality: str | None = None, keys: list[str] = ()) -> DataFrame:
    """(keys, ts, raw, upper, lower, scores, predictions) of (keys, ts, value)."""
    keys = list(keys)
    if algorithm == "basic":
        return basic(series, bounds, keys)
    fn = {"agile": agile, "robust": robust}[algorithm]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        x = pdf["value"].to_numpy("float64", na_value=np.nan)
        upper, lower, scores, predictions = fn(pdf["ts"].to_numpy("int64"), x, bounds, seasonality)
        return pdf[[*keys, "ts"]].assign(raw=x, upper=upper, lower=lower, scores=scores, predictions=predictions)

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in series.select(*keys).schema)
    out = series.groupBy(*(keys or [F.lit("all")])).applyInPandas(run, head + "ts long, raw double, upper double, lower double, scores double, predictions double")
    return out.select(*keys, "ts", *[F.nanvl(c, null()).alias(c) for c in PIECES])


def pieces(wide: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The same in long form: (keys, piece, ts, value)."""
    each = F.array(*[F.struct(F.lit(p).alias("piece"), F.col(p).alias("value")) for p in PIECES])
    return wide.withColumn("_p", F.explode(each)).select(*keys, "_p.piece", "ts", "_p.value")


def alert(wide: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The largest score of each series."""
    return wide.groupBy(*keys).agg(F.max("scores").alias("alert"))
