"""A formula compiled to columns over an aligned frame.

Row-wise nodes stay expressions in one projection. Window nodes share one window
specification (one sort); an argument that itself holds a window becomes a column
first. Only recursions (ema, holt_winters, fill_spline, gaussian_smooth) leave
the JVM, once per series in Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import smooth
from ..functions.ieee import divide, known, null, whole
from ..parse.formula import Anomalies, Binary, Call, Forecast, Negate, Node, Number, Ref, TimeShift
from ..parse.values import ParseError


class EvaluationError(ValueError):
    """A formula whose parts do not fit together."""


@dataclass
class Value:
    """const: its number, if it is one. shift: how far its time axis is moved.
    windowed: holds a window expression."""

    col: Column
    const: float | None = None
    shift: int = 0
    windowed: bool = False


def constant(x: float) -> Value:
    return Value(null() if math.isnan(x) else F.lit(float(x)), x)


def _ieee(op: str, a: float, b: float) -> float:
    try:
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[op]()
    except ZeroDivisionError:
        return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)


class Compiler:
    def __init__(self, df: DataFrame, names: list[str], keys: list[str] = ()):
        self.df, self.names, self.keys = df, names, list(keys)
        self.order = Window.partitionBy(*self.keys).orderBy("ts")
        self.full = self.order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        self.upto = self.order.rowsBetween(Window.unboundedPreceding, 0)
        self.made = 0

    def result(self, node: Node) -> DataFrame:
        v = self.value(node)
        ts = F.col("ts") if not v.shift else F.greatest(F.col("ts") + v.shift, F.lit(0).cast("long"))
        return self.df.select(*self.keys, ts.alias("ts"), known(v.col).alias("value"))

    # Nodes

    def value(self, node: Node) -> Value:
        if isinstance(node, Number):
            return constant(node.value)
        if isinstance(node, (Ref, TimeShift)):
            if node.name not in self.names:
                raise EvaluationError(f"undefined query reference: {node.name}")
            return Value(F.col(f"`{node.name}`"), shift=node.offset if isinstance(node, TimeShift) else 0)
        if isinstance(node, Negate):
            v = self.value(node.arg)
            return constant(-v.const) if v.const is not None else Value(-v.col, None, v.shift, v.windowed)
        if isinstance(node, Binary):
            return self.binary(node.op, self.value(node.left), self.value(node.right))
        if isinstance(node, (Anomalies, Forecast)):
            raise EvaluationError("anomalies() and forecast() must be the whole formula")
        return self.call(node)

    def one_axis(self, *values: Value) -> int:
        shifts = {v.shift for v in values if v.const is None}
        if len(shifts) > 1:
            raise EvaluationError("series with different timestamps cannot be combined")
        return shifts.pop() if shifts else 0

    def binary(self, op: str, a: Value, b: Value) -> Value:
        if a.const is not None and b.const is not None:
            return constant(_ieee(op, a.const, b.const))
        col = divide(a.col, b.col) if op == "/" else known({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op])
        return Value(col, None, self.one_axis(a, b), a.windowed or b.windowed)

    def held(self, v: Value) -> Column:
        """v as something a window may be laid over."""
        if not v.windowed:
            return v.col
        name = f"_w{self.made}"
        self.made += 1
        self.df = self.df.withColumn(name, v.col)
        v.col, v.windowed = F.col(name), False
        return v.col

    def number(self, v: Value, what: str) -> float:
        if v.const is None:
            raise EvaluationError(f"{what} must be a number")
        return v.const

    def count(self, v: Value, what: str) -> int:
        n = self.number(v, what)
        if not n >= 1 or math.isinf(n):
            raise EvaluationError(f"{what} must be at least 1")
        return int(n)

    def first(self, v: Value) -> Column:
        """A parameter: a number, or the first value of a series."""
        return v.col if v.const is not None else F.first(self.held(v)).over(self.full)

    def call(self, node: Call) -> Value:
        args = [self.value(x) for x in node.args]
        handler = getattr(self, f"f_{node.name}", None)
        if handler:
            out = handler(*args)
            if isinstance(out, Value):
                return out
            col, windowed = out if isinstance(out, tuple) else (out, any(a.windowed for a in args))
        else:
            x, windowed = self.held(args[0]), True
            col = self.window(node.name, x, args)
        return Value(col, None, self.one_axis(*args), windowed)

    # Row by row

    def f_abs(self, a):
        return F.abs(a.col)

    def f_log(self, a):
        return F.when(a.col > 0, F.ln(a.col))

    def f_log10(self, a):
        return F.when(a.col > 0, F.log10(a.col))

    def f_sqrt(self, a):
        return F.when(a.col >= 0, F.sqrt(a.col))

    def f_ceil(self, a):
        return whole(a.col, F.ceil)

    def f_floor(self, a):
        return whole(a.col, F.floor)

    def f_exp(self, a):
        return F.exp(a.col)

    def f_round(self, a):
        return F.when(F.abs(a.col) >= float(2**52), a.col).otherwise(F.signum(a.col) * whole(F.abs(a.col) + 0.5, F.floor))

    def f_sign(self, a):
        return F.signum(a.col)

    def f_min(self, a, b):
        return F.least(a.col, b.col)

    def f_max(self, a, b):
        return F.greatest(a.col, b.col)

    def f_pow(self, a, b):
        return known(F.pow(a.col, b.col))

    def f_clamp(self, v, lo, hi):
        ok = v.col.isNotNull() & lo.col.isNotNull() & hi.col.isNotNull() & (lo.col <= hi.col)
        return F.when(ok, F.greatest(lo.col, F.least(v.col, hi.col)))

    def f_clamp_min(self, a, c):
        return F.when(a.col.isNotNull(), F.greatest(a.col, self.first(c))), a.windowed or c.const is None

    def f_clamp_max(self, a, c):
        return F.when(a.col.isNotNull(), F.least(a.col, self.first(c))), a.windowed or c.const is None

    def f_cutoff_min(self, a, t):
        return F.when(a.col < self.first(t), null()).otherwise(a.col), a.windowed or t.const is None

    def f_cutoff_max(self, a, t):
        return F.when(a.col > self.first(t), null()).otherwise(a.col), a.windowed or t.const is None

    def f_default_zero(self, a):
        return F.coalesce(a.col, F.lit(0.0))

    def f_fill_value(self, a, v):
        return F.coalesce(a.col, self.first(v)), a.windowed or v.const is None

    def f_as_percent(self, a, total):
        return F.when(total.col != 0, known(a.col * 100.0 / F.when(total.col != 0, total.col)))

    # Across series

    def f_avg_of_series(self, *xs):
        n = sum((x.col.isNotNull().cast("int") for x in xs), F.lit(0))
        return F.when(n > 0, reduce(lambda s, x: s + F.coalesce(x.col, F.lit(0.0)), xs, F.lit(0.0)) / F.when(n > 0, n))

    def f_sum_of_series(self, *xs):
        n = sum((x.col.isNotNull().cast("int") for x in xs), F.lit(0))
        return F.when(n > 0, reduce(lambda s, x: s + F.coalesce(x.col, F.lit(0.0)), xs, F.lit(0.0)))

    def f_min_of_series(self, *xs):
        return F.least(*[x.col for x in xs]) if len(xs) > 1 else xs[0].col

    def f_max_of_series(self, *xs):
        return F.greatest(*[x.col for x in xs]) if len(xs) > 1 else xs[0].col

    def f_count_of_series(self, *xs):
        return sum((x.col.isNotNull().cast("double") for x in xs), F.lit(0.0))

    def f_stddev_of_series(self, *xs):
        have = F.filter(F.array(*[x.col for x in xs]), lambda x: x.isNotNull())
        n = F.size(have)
        mean = F.aggregate(have, F.lit(0.0), lambda s, x: s + x) / F.when(n > 0, n)
        return F.when(n > 0, F.sqrt(F.aggregate(have, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.when(n > 0, n)))

    def f_percentile_of_series(self, p, *xs):
        return percentile(F.array_sort(F.filter(F.array(*[x.col for x in xs]), lambda x: x.isNotNull())), self.percent(p))

    def percent(self, p: Value) -> float:
        x = self.number(p, "the percentile")
        if not 0 <= x <= 100:
            raise EvaluationError(f"a percentile must be in [0, 100], got {x}")
        return x / 100

    def f_histogram_quantile(self, p, *rest):
        share = self.percent(p)
        bounds = [self.number(b, "a bucket bound") for b in rest[:-1:2]]
        if any(math.isinf(b) or math.isnan(b) for b in bounds) or any(b <= a for a, b in zip(bounds, bounds[1:], strict=False)):
            raise EvaluationError("bucket bounds must be finite and ascending")
        raw = [*[v.col for v in rest[1:-1:2]], rest[-1].col]
        counts = [raw[0]]
        for c in raw[1:]:
            counts.append(F.greatest(counts[-1], c))
        total = counts[-1]
        rank = total * share
        ladder = F.lit(bounds[-1])
        for k in reversed(range(len(bounds))):
            low = bounds[k - 1] if k else min(0.0, bounds[0]) if bounds[0] <= 0 else 0.0
            before = counts[k - 1] if k else F.lit(0.0)
            inside = counts[k] - before
            at = F.lit(low) + F.lit(bounds[k] - low) * (rank - before) / F.when(inside > 0, inside)
            ladder = F.when(counts[k] >= rank, F.when(inside > 0, at).otherwise(F.lit(bounds[k]))).otherwise(ladder)
        valid = reduce(lambda x, y: x & y, [c.isNotNull() for c in raw])
        return F.when(valid & (total > 0), ladder)

    def f_topk(self, n, a):
        return self.pick(n, a)

    def f_bottomk(self, n, a):
        return self.pick(n, a)

    def pick(self, n: Value, a: Value) -> Value:
        k = self.number(n, "N")
        if k < 0:
            raise EvaluationError("N must not be negative")
        if int(k) == 0:
            self.df = self.df.where(F.lit(False))
        return a

    # In time order; x is a plain column here

    def window(self, name: str, x: Column, args: list[Value]) -> Column:
        w, full, upto = self.order, self.full, self.upto
        zero = F.lit(0.0)

        def lag(c: Column) -> Column:
            return F.lag(c).over(w)

        d = x - lag(x)
        seconds = (F.col("ts") - F.lag("ts").over(w)).cast("double") / 1e9
        per_second = known(d / F.when(seconds > 0, seconds))
        if name == "diff":
            return known(d)
        if name == "monotonic_diff":
            return F.when(d < 0, x).otherwise(known(d))
        if name == "rate":
            return F.when(seconds > 0, F.when(d < 0, zero).otherwise(known(d)) / F.when(seconds > 0, seconds))
        if name == "deriv":
            return per_second
        if name in ("per_minute", "per_hour"):
            return F.when(seconds <= 0, zero).otherwise(per_second * (60.0 if name == "per_minute" else 3600.0))
        if name in ("increase", "irate", "idelta", "changes", "resets"):
            return self.spans(name, x, d, seconds)
        if name == "delta":
            return known(F.last(x, True).over(full) - F.first(x, True).over(full))
        if name == "count_nonzero":
            return F.coalesce(F.sum(F.when(x != 0, 1.0)).over(full), zero)
        if name == "count_not_null":
            return F.count(x).over(full).cast("double")
        if name == "fill_forward":
            return F.last(x, True).over(upto)
        if name == "fill_backward":
            return F.first(x, True).over(w.rowsBetween(0, Window.unboundedFollowing))
        if name == "fill_linear":
            point = F.when(x.isNotNull(), F.struct("ts", x.alias("v")))
            a, b = F.last(point, True).over(upto), F.first(point, True).over(w.rowsBetween(0, Window.unboundedFollowing))
            gap = (b["ts"] - a["ts"]).cast("double")
            share = F.when(gap == 0, 0.5).otherwise((F.col("ts") - a["ts"]).cast("double") / F.when(gap != 0, gap))
            return F.coalesce(x, a["v"] + (b["v"] - a["v"]) * share)
        if name == "cumsum":
            return F.coalesce(F.sum(x).over(upto), zero)
        if name == "integral":
            area = self.held(Value(F.when(seconds > 0, (x + lag(x)) / 2 * seconds), windowed=True))
            return F.coalesce(F.sum(area).over(upto), zero)
        if name == "normalize":
            low, high = F.min(x).over(full), F.max(x).over(full)
            return F.when(x.isNotNull(), F.when(high == low, zero).otherwise((x - low) / F.when(high != low, high - low)))
        if name == "standardize":
            mean, dev = F.avg(x).over(full), F.stddev_pop(x).over(full)
            return F.when(x.isNotNull(), F.when(dev == 0, zero).otherwise((x - mean) / F.when(dev != 0, dev)))
        if name.startswith("rolling_") or name == "zscore":
            return self.rolling(name, x, args)
        if name == "ema":
            a = self.number(args[1], "ema()'s parameter")
            if not a > 0:
                raise EvaluationError("ema()'s parameter must be positive")
            return self.recursion(x, smooth.ema, a if a <= 1 else 2 / (a + 1))
        if name == "holt_winters":
            alpha, beta = (self.number(v, "a smoothing factor") for v in args[1:])
            if not (0 < alpha <= 1 and 0 < beta <= 1):
                raise EvaluationError("smoothing factors must be in (0, 1]")
            return self.recursion(x, smooth.holt_winters, alpha, beta)
        if name == "gaussian_smooth":
            sigma = self.number(args[1], "sigma")
            if not 0 < sigma <= 1e6:
                raise EvaluationError("sigma must be in (0, 1e6]")
            return self.recursion(x, smooth.gaussian, sigma)
        if name == "fill_spline":
            return self.recursion(x, smooth.fill_spline)
        raise ParseError(f"unknown function: {name}")

    def spans(self, name: str, x: Column, d: Column, seconds: Column) -> Column:
        """One number for the whole series, on every row."""
        w, full = self.order, self.full
        if name == "increase":
            step = self.held(Value(known(d), windowed=True))
            return F.coalesce(F.sum(F.when(step > 0, step)).over(full), F.lit(0.0))
        if name == "irate":
            step = F.when(seconds > 0, F.when(d < 0, F.lit(0.0)).otherwise(known(d)) / F.when(seconds > 0, seconds))
            return F.last(self.held(Value(step, windowed=True))).over(full)
        before = self.held(Value(F.last(x, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), windowed=True))
        if name == "idelta":
            return known(F.last(F.when(x.isNotNull(), F.struct((x - before).alias("d"))), True).over(full)["d"])
        test = (x != before) if name == "changes" else (x < before)
        return F.coalesce(F.sum(F.when(test, 1.0)).over(full), F.lit(0.0))

    def rolling(self, name: str, x: Column, args: list[Value]) -> Column:
        n = self.count(args[1], "N")
        w = self.order.rowsBetween(-(n - 1), 0)
        enough = F.row_number().over(self.order) >= n
        if name in ("rolling_median", "rolling_percentile"):
            p = 0.5 if name == "rolling_median" else self.percent(args[2])
            values = self.held(Value(F.collect_list(x).over(w), windowed=True))
            return F.when(enough, percentile(F.array_sort(values), p))
        if name == "zscore":
            mean, dev, have = F.avg(x).over(w), F.stddev_pop(x).over(w), F.count(x).over(w)
            return F.when(enough & (have == n), F.when(dev == 0, F.lit(0.0)).otherwise((x - mean) / F.when(dev != 0, dev)))
        y = F.coalesce(x, F.lit(0.0))
        return F.when(
            enough,
            {"rolling_avg": lambda: F.avg(x), "rolling_min": lambda: F.min(x), "rolling_max": lambda: F.max(x), "rolling_sum": lambda: F.sum(x), "rolling_stddev": lambda: F.stddev_pop(y)}[name]().over(w),
        )

    def recursion(self, x: Column, fn, *params: float) -> Column:
        """fn over each series' (ts, values) arrays, as a column of the frame."""
        name = f"_r{self.made}"
        self.made += 1
        df = self.df.withColumn("_x", x)
        out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in self.df.schema)}, {name} double"

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ts", kind="stable")
            y = fn(pdf["ts"].to_numpy("int64"), pdf.pop("_x").to_numpy("float64", na_value=math.nan), *params)
            return pdf.assign(**{name: y})

        self.df = df.groupBy(*(self.keys or [F.lit("all")])).applyInPandas(run, out).withColumn(name, known(F.col(name)))
        return F.col(name)


def percentile(values: Column, p: float) -> Column:
    """Linear interpolation over a sorted array; NULL of an empty one."""
    n = F.size(values)
    at = (n - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.coalesce(F.get(values, low + 1), F.get(values, low))
    return F.when(n > 0, a + (b - a) * (at - low))
