"""The registered queries over the driver's tables, with their DuckDB oracles.

`events` is the primary measurement (tags event_type, user_id; field value; seq
event_id), `lineitem` a multi-field one, `orders` another."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import anomaly, catalog, groups, maintenance
from .parse.formula import parse_formula, references
from .parse.query import parse_query
from .plans.align import align, interpolate
from .plans.derived import DerivedQuery, derive, derive_by
from .plans.query import collapsed, numeric, typed
from .session import ship
from .sources import formats, proto, writes
from .sources.points import Source, last_write_wins
from .streaming import subscribe

START, END = 1704067200_000000000, 1706745600_000000000  # 2024-01-01, 2024-02-01
HOUR, DAY, MINUTE = 3600 * 10**9, 86400 * 10**9, 60 * 10**9
ANCHOR = START + 7 * MINUTE

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def events(spark: SparkSession, d: str) -> Source:
    return Source(ship(spark).read.parquet(f"{d}/events.parquet"), "events", ("event_type", "user_id"), ("value",), "ts", "event_id")


def typed_events(spark: SparkSession, d: str) -> Source:
    df = ship(spark).read.parquet(f"{d}/events.parquet").withColumn("big", F.col("value") > 50)
    return Source(df, "events", ("event_type", "user_id"), ("value", "big", "props"), "ts", "event_id")


def lineitem(spark: SparkSession, d: str) -> Source:
    # Order and line make every row a series of its own: none is overwritten.
    return Source(ship(spark).read.parquet(f"{d}/lineitem.parquet"), "lineitem", ("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "l_shipdate")


def shipped(spark: SparkSession, d: str) -> Source:
    # By flag and status only: rows of a day overwrite each other.
    df = ship(spark).read.parquet(f"{d}/lineitem.parquet").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return Source(df, "shipped", ("l_returnflag", "l_linestatus"), ("l_quantity", "l_extendedprice"), "l_shipdate", "seq")


def orders(spark: SparkSession, d: str) -> Source:
    return Source(ship(spark).read.parquet(f"{d}/orders.parquet"), "orders", ("o_orderstatus", "o_orderpriority", "o_orderkey"), ("o_totalprice",), "o_orderdate")


def add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


def rounded(df: DataFrame, *cols: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in (cols or ("value",))})


# Events as the oracle sees them: nanoseconds and missing values.
EV = "(SELECT event_type, user_id, event_id, value, epoch_us(ts) * 1000 AS t FROM events)"
RANGE = f"t BETWEEN {START} AND {END}"
SQL = {
    "avg": "avg(value)",
    "min": "min(value)",
    "max": "max(value)",
    "sum": "sum(value)",
    "count": "CAST(count(value) AS DOUBLE)",
    "latest": "arg_max(value, (t, event_type, user_id))",
    "first": "arg_min(value, (t, event_type, user_id))",
    "median": "median(value)",
    "exact_median": "median(value)",
    "stddev": "stddev_pop(value)",
    "stdvar": "var_pop(value)",
    "spread": "max(value) - min(value)",
}


def _slice(spark, d):
    df = numeric(events(spark, d), "avg:events(value){event_type:click} by {user_id}", START, END, "1h")
    return rounded(df)


add(
    "q_slice_avg_clicks_by_user_1h",
    _slice,
    f"SELECT user_id, 'value' AS field, t // {HOUR} * {HOUR} AS ts, round(avg(value), 6) AS value FROM {EV} WHERE event_type = 'click' AND {RANGE} GROUP BY 1, 3",
)

# A-01..A-12: each method with an epoch grid, without a grid, and from a start.
for _m in SQL:
    _to = 8 if _m == "stdvar" else 6
    add(
        f"a_{_m}_by_type_1h",
        lambda s, d, m=_m, to=_to: rounded(numeric(events(s, d), f"{m}:events(value){{}} by {{event_type}}", START, END, "1h"), to=to),
        f"SELECT event_type, 'value' AS field, t // {HOUR} * {HOUR} AS ts, round({SQL[_m]}, {_to}) AS value FROM {EV} WHERE {RANGE} GROUP BY 1, 3",
    )
    add(
        f"a_{_m}_no_interval",
        lambda s, d, m=_m, to=_to: rounded(numeric(events(s, d), f"{m}:events(value)", START, END), to=to),
        f"SELECT 'value' AS field, t AS ts, round({SQL[_m]}, {_to}) AS value FROM {EV} WHERE {RANGE} GROUP BY 2",
    )
    add(
        f"a_{_m}_start_anchored_6h",
        lambda s, d, m=_m, to=_to: rounded(numeric(events(s, d), f"{m}:events(value){{event_type:purchase}}", ANCHOR, END, "6h", "start"), to=to),
        f"SELECT 'value' AS field, {ANCHOR} + (t - {ANCHOR}) // {6 * HOUR} * {6 * HOUR} AS ts, round({SQL[_m]}, {_to}) AS value FROM {EV} WHERE event_type = 'purchase' AND t BETWEEN {ANCHOR} AND {END} GROUP BY 2",
    )
    add(
        f"a17_{_m}_collapsed_by_type",
        lambda s, d, m=_m, to=_to: rounded(collapsed(events(s, d), f"{m}:events(value){{}} by {{event_type}}", START, END), to=to),
        f"SELECT event_type, 'value' AS field, round({SQL[_m]}, {_to}) AS value FROM {EV} WHERE {RANGE} GROUP BY 1",
    )

add(
    "a18_strings_latest_per_bucket_1d",
    lambda s, d: typed(typed_events(s, d), "count:events(props)", START, END, "1d").select("event_type", "user_id", "field", "ts", "s"),
    f"SELECT event_type, user_id, 'props' AS field, epoch_us(ts) * 1000 // {DAY} * {DAY} AS ts, arg_max(props, ts) AS s FROM events WHERE props IS NOT NULL AND epoch_us(ts) * 1000 BETWEEN {START} AND {END} GROUP BY 1, 2, 4",
)
add(
    "a19_booleans_latest_per_bucket_1d",
    lambda s, d: typed(typed_events(s, d), "avg:events(big)", START, END, "1d").select("event_type", "user_id", "field", "ts", "b"),
    f"SELECT event_type, user_id, 'big' AS field, epoch_us(ts) * 1000 // {DAY} * {DAY} AS ts, arg_max(value > 50, ts) AS b FROM events WHERE value IS NOT NULL AND epoch_us(ts) * 1000 BETWEEN {START} AND {END} GROUP BY 1, 2, 4",
)
add(
    "a18_strings_raw",
    lambda s, d: typed(typed_events(s, d), "avg:events(props){event_type:click}", START, END).select("event_type", "user_id", "field", "ts", "s"),
    f"SELECT event_type, user_id, 'props' AS field, epoch_us(ts) * 1000 AS ts, props AS s FROM events WHERE event_type = 'click' AND props IS NOT NULL AND epoch_us(ts) * 1000 BETWEEN {START} AND {END}",
)
add(
    "a20_booleans_as_numeric_1d",
    lambda s, d: rounded(numeric(typed_events(s, d), "avg:events(big){} by {event_type}", START, END, "1d", booleans_as_numeric=True)),
    f"SELECT event_type, 'big' AS field, t // {DAY} * {DAY} AS ts, round(avg(CAST(value > 50 AS DOUBLE)), 6) AS value FROM {EV} WHERE {RANGE} AND value IS NOT NULL GROUP BY 1, 3",
)

# Several fields in one shuffle.
LI = "(SELECT *, epoch_us(l_shipdate) * 1000 AS t FROM lineitem)"
_FIELDS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
add(
    "q02_all_fields_avg_by_flag_30d",
    lambda s, d: rounded(numeric(lineitem(s, d), "avg:lineitem(){} by {l_returnflag,l_linestatus}", None, None, "30d")),
    " UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, '{f}' AS field, t // {30 * DAY} * {30 * DAY} AS ts, round(avg({f}), 6) AS value FROM {LI} GROUP BY 1, 2, 4" for f in _FIELDS),
)
add(
    "q02_two_fields_max_1d",
    lambda s, d: rounded(numeric(lineitem(s, d), "max:lineitem(l_quantity,l_tax){l_returnflag:R}", None, None, "1d")),
    " UNION ALL ".join(f"SELECT '{f}' AS field, t // {DAY} * {DAY} AS ts, round(max({f}), 6) AS value FROM {LI} WHERE l_returnflag = 'R' GROUP BY 2" for f in ("l_quantity", "l_tax")),
)

# Scopes.
for _name, _scope, _where in (
    ("q03_scope_exact_two", "event_type:click,user_id:7", "event_type = 'click' AND user_id = 7"),
    ("q04_scope_star", "event_type:c*", "regexp_full_match(event_type, 'c.*')"),
    ("q04_scope_question", "event_type:?lick", "regexp_full_match(event_type, '.lick')"),
    ("q05_scope_tilde_regex", "event_type:~(click|view)", "regexp_full_match(event_type, '(click|view)')"),
    ("q05_scope_slash_regex", "user_id:/1[0-9,]+/", "regexp_full_match(CAST(user_id AS VARCHAR), '1[0-9,]+')"),
    ("q03_scope_missing_tag", "nothing:x", "false"),
):
    add(
        _name,
        lambda s, d, scope=_scope: rounded(numeric(events(s, d), f"sum:events(value){{{scope}}}", START, END, "1d")),
        f"SELECT 'value' AS field, t // {DAY} * {DAY} AS ts, round(sum(value), 6) AS value FROM {EV} WHERE {_where} AND {RANGE} GROUP BY 2",
    )
add(
    "q08_group_by_unknown_tag_is_empty",
    lambda s, d: numeric(events(s, d), "avg:events(value){} by {nothing}", START, END, "1h"),
    "SELECT CAST(NULL AS VARCHAR) AS nothing, 'value' AS field, CAST(0 AS BIGINT) AS ts, CAST(0 AS DOUBLE) AS value WHERE false",
)
add(
    "q09_time_range_inclusive",
    lambda s, d: numeric(events(s, d), "count:events(value)", "05-01-2024 00:00:00", "06-01-2024 12:00:00", "1h"),
    f"SELECT 'value' AS field, t // {HOUR} * {HOUR} AS ts, CAST(count(value) AS DOUBLE) AS value FROM {EV} WHERE t BETWEEN 1704412800000000000 AND 1704542400000000000 GROUP BY 2",
)

# S-08: last write wins.
add(
    "s08_last_write_wins",
    lambda s, d: last_write_wins(shipped(s, d)).df.select("l_returnflag", "l_linestatus", (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("ts"), "l_quantity", "l_extendedprice"),
    "SELECT l_returnflag, l_linestatus, epoch_us(l_shipdate) * 1000 AS ts, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS l_quantity, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS l_extendedprice FROM lineitem GROUP BY 1, 2, 3",
)
add(
    "s08_sum_after_last_write_wins_7d",
    lambda s, d: rounded(numeric(shipped(s, d), "sum:shipped(l_quantity){} by {l_returnflag}", None, None, "7d")),
    f"SELECT l_returnflag, 'l_quantity' AS field, t // {7 * DAY} * {7 * DAY} AS ts, round(sum(q), 6) AS value FROM (SELECT l_returnflag, l_linestatus, epoch_us(l_shipdate) * 1000 AS t, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS q FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 3",
)


# Formulas. a and b are daily sums of two event types, c has gaps (one user's).
def two(spark, d, formula, interval="6h", **kw):
    q = (
        DerivedQuery(**kw)
        .query("a", "sum:events(value){event_type:click}")
        .query("b", "sum:events(value){event_type:purchase}")
        .formula(formula)
        .between(START, END)
        .every(interval)
    )
    return rounded(derive({"events": events(spark, d)}, q, strict=False))


def _grid(kind: str, step: int) -> str:
    return f"SELECT t // {step} * {step} AS ts, sum(value) AS v FROM {EV} WHERE event_type = '{kind}' AND {RANGE} GROUP BY 1"


KINDS = {"a": "click", "b": "purchase"}


def on(name: str) -> str:
    """The series x<name> at the timestamps of g, interpolated on a line: neighbours by as-of joins."""
    return f"""(SELECT g.ts, CASE WHEN p.ts = g.ts THEN p.v WHEN p.ts IS NULL THEN n.v WHEN n.ts IS NULL THEN p.v
      ELSE p.v + (n.v - p.v) * ((g.ts - p.ts) / (n.ts - p.ts)) END AS v
      FROM g ASOF LEFT JOIN x{name} p ON g.ts >= p.ts ASOF LEFT JOIN x{name} n ON g.ts <= n.ts)"""


def frame(step: int = 6 * HOUR, names: str = "ab") -> str:
    """The resampled frame f (ts, a, b): a dense grid over the common range."""
    series = ", ".join(f"x{n} AS ({_grid(KINDS[n], step)})" for n in names)
    common = " JOIN ".join(f"x{n}" for n in names).replace("JOIN xb", "JOIN xb USING (ts)")
    joined = f"{on(names[0])} r{names[0]}" + "".join(f" JOIN {on(n)} r{n} USING (ts)" for n in names[1:])
    return f"""WITH {series}, lim AS (SELECT min(ts) AS lo, max(ts) AS hi FROM {common}),
      g AS (SELECT unnest(range(lo, hi + 1, {step})) AS ts FROM lim),
      f AS (SELECT ts, {", ".join(f"r{n}.v AS {n}" for n in names)} FROM {joined})"""


def formula(name: str, text: str, sql: str, interval: str = "6h", step: int = 6 * HOUR) -> None:
    """sql: over f (ts, a, b), or what of them the formula refers to."""
    names = "".join(references(parse_formula(text)))
    add(name, lambda s, d: two(s, d, text, interval), f"{frame(step, names)} SELECT ts, round({sql}, 6) AS value FROM f")


for _n, _t, _s in (
    ("f01_add", "a + b", "a + b"),
    ("f02_subtract", "100 - b", "100 - b"),
    ("f03_multiply", "a * b", "a * b"),
    ("f04_divide", "a / b", "CASE WHEN b = 0 THEN CASE WHEN a > 0 THEN 'inf'::DOUBLE WHEN a < 0 THEN '-inf'::DOUBLE END ELSE a / b END"),
    ("f05_negate", "-a + 2 * 3", "-a + 6"),
    ("f06_precedence", "(a / (a + b)) * 100 - 2 * -3", "(a / (a + b)) * 100 + 6"),
    ("m01_abs", "abs(a - b)", "abs(a - b)"),
    ("m02_log", "log(a - b)", "CASE WHEN a - b > 0 THEN ln(a - b) END"),
    ("m03_log10", "log10(a)", "CASE WHEN a > 0 THEN log10(a) END"),
    ("m04_sqrt", "sqrt(a - b)", "CASE WHEN a - b >= 0 THEN sqrt(a - b) END"),
    ("m05_ceil", "ceil(a / 7)", "ceil(a / 7)"),
    ("m06_floor", "floor(a / 7)", "floor(a / 7)"),
    ("m07_exp", "exp(a / 1000)", "exp(a / 1000)"),
    ("m08_round", "round(a / 10)", "round(a / 10)"),
    ("m09_sign", "sign(a - b)", "CAST(sign(a - b) AS DOUBLE)"),
    ("m10_min", "min(a, b)", "least(a, b)"),
    ("m11_max", "max(a, b)", "greatest(a, b)"),
    ("m12_pow", "pow(a / 100, 2)", "pow(a / 100, 2)"),
    ("m13_clamp", "clamp(a, 500, b)", "CASE WHEN b >= 500 THEN greatest(500, least(a, b)) END"),
    ("m14_clamp_min", "clamp_min(a, 900)", "greatest(a, 900)"),
    ("m15_clamp_max", "clamp_max(a, 900)", "least(a, 900)"),
    ("m16_cutoff_min", "cutoff_min(a, 900)", "CASE WHEN a >= 900 THEN a END"),
    ("m17_cutoff_max", "cutoff_max(a, 900)", "CASE WHEN a <= 900 THEN a END"),
    ("m18_default_zero", "default_zero(cutoff_min(a, 900))", "CASE WHEN a >= 900 THEN a ELSE 0 END"),
    ("m19_fill_value", "fill_value(cutoff_min(a, 900), -1)", "CASE WHEN a >= 900 THEN a ELSE -1 END"),
    ("x01_as_percent", "as_percent(a, a + b)", "CASE WHEN a + b <> 0 THEN a * 100 / (a + b) END"),
    ("x02_avg_of_series", "avg_of_series(a, cutoff_min(b, 900))", "CASE WHEN b >= 900 THEN (a + b) / 2 ELSE a END"),
    ("x03_sum_of_series", "sum_of_series(a, b, 1)", "a + b + 1"),
    ("x04_min_of_series", "min_of_series(a, b, 700)", "least(a, b, 700)"),
    ("x05_max_of_series", "max_of_series(a, b, 700)", "greatest(a, b, 700)"),
    ("x06_percentile_of_series", "percentile_of_series(25, a, b, 700)", "list_aggregate([a, b, 700], 'quantile_cont', 0.25)"),
    ("x07_count_of_series", "count_of_series(cutoff_min(a, 900), b)", "CAST((a >= 900)::INT + 1 AS DOUBLE)"),
    ("x08_stddev_of_series", "stddev_of_series(a, b, 700)", "list_aggregate([a, b, 700], 'stddev_pop')"),
    (
        "x09_histogram_quantile",
        "histogram_quantile(90, 1, a, 5, a + b, a + 2 * b)",
        "CASE WHEN a + 2 * b > 0 THEN CASE WHEN a >= 0.9 * (a + 2 * b) THEN 0.9 * (a + 2 * b) / a WHEN a + b >= 0.9 * (a + 2 * b) THEN 1 + 4 * (0.9 * (a + 2 * b) - a) / b ELSE 5 END END",
    ),
    ("x10_topk", "topk(1, a)", "a"),
    ("x11_bottomk", "bottomk(2, a + b)", "a + b"),
):
    formula(_n, _t, _s)

W = "OVER (ORDER BY ts)"
ALL = "OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
R5 = "OVER (ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
SEC = f"((ts - lag(ts) {W}) / 1e9)"


def ordered(name: str, text: str, sql: str, inner: str = "a - b") -> None:
    """text with x for the series a - b (so that both queries are used); sql over (ts, x)."""
    add(
        name,
        lambda s, d: two(s, d, re.sub(r"\bx\b", f"({inner})", text)),
        f"{frame()}, z AS (SELECT ts, {inner} AS x FROM f), y AS (SELECT ts, x, x - lag(x) {W} AS d, {SEC} AS s FROM z) SELECT ts, round({sql}, 6) AS value FROM y",
    )


for _n, _t, _s in (
    ("t01_diff", "diff(x)", "d"),
    ("t02_monotonic_diff", "monotonic_diff(x)", "CASE WHEN d < 0 THEN x ELSE d END"),
    ("t03_rate", "rate(x)", "CASE WHEN d < 0 THEN 0 ELSE d END / s"),
    ("t04_irate", "irate(x)", f"last(CASE WHEN d < 0 THEN 0 ELSE d END / s) {ALL}"),
    ("t05_increase", "increase(x)", f"sum(CASE WHEN d > 0 THEN d ELSE 0 END) {ALL}"),
    ("t06_deriv", "deriv(x) * 1000", "d / s * 1000"),
    ("t07_delta", "delta(x)", f"last(x) {ALL} - first(x) {ALL}"),
    ("t08_idelta", "idelta(x)", f"last(d) {ALL}"),
    ("t09_changes", "changes(x)", f"CAST(sum((d <> 0)::INT) {ALL} AS DOUBLE)"),
    ("t10_resets", "resets(x)", f"CAST(sum((d < 0)::INT) {ALL} AS DOUBLE)"),
    ("t11_per_minute", "per_minute(x, 60)", "d / s * 60"),
    ("t12_per_hour", "per_hour(x, 60)", "d / s * 3600"),
    ("t13_count_nonzero", "count_nonzero(x)", f"CAST(sum((x <> 0)::INT) {ALL} AS DOUBLE)"),
    ("t14_count_not_null", "count_not_null(x)", f"CAST(count(x) {ALL} AS DOUBLE)"),
    ("t19_cumsum", "cumsum(x)", f"sum(x) {W}"),
    ("t21_normalize", "normalize(x)", f"(x - min(x) {ALL}) / (max(x) {ALL} - min(x) {ALL})"),
    ("t22_standardize", "standardize(x)", f"(x - avg(x) {ALL}) / stddev_pop(x) {ALL}"),
    ("r01_rolling_avg", "rolling_avg(x, 5)", f"CASE WHEN row_number() {W} >= 5 THEN avg(x) {R5} END"),
    ("r02_rolling_min", "rolling_min(x, 5)", f"CASE WHEN row_number() {W} >= 5 THEN min(x) {R5} END"),
    ("r03_rolling_max", "rolling_max(x, 5)", f"CASE WHEN row_number() {W} >= 5 THEN max(x) {R5} END"),
    ("r04_rolling_sum", "rolling_sum(x, 5)", f"CASE WHEN row_number() {W} >= 5 THEN sum(x) {R5} END"),
    ("r05_rolling_median", "rolling_median(x, 5)", f"CASE WHEN row_number() {W} >= 5 THEN quantile_cont(x, 0.5) {R5} END"),
    ("r06_rolling_percentile", "rolling_percentile(x, 5, 90)", f"CASE WHEN row_number() {W} >= 5 THEN quantile_cont(x, 0.9) {R5} END"),
    ("r07_rolling_stddev", "rolling_stddev(x, 5)", f"CASE WHEN row_number() {W} >= 5 THEN stddev_pop(x) {R5} END"),
    ("r08_zscore", "zscore(x, 5)", f"CASE WHEN row_number() {W} >= 5 THEN CASE WHEN stddev_pop(x) {R5} = 0 THEN 0 ELSE (x - avg(x) {R5}) / stddev_pop(x) {R5} END END"),
):
    ordered(_n, _t, _s)


def _gaps(name: str, text: str, sql: str) -> None:
    """x is a, missing where below 900; b is used so that the frame is the same."""
    add(
        name,
        lambda s, d: two(s, d, re.sub(r"\bx\b", "cutoff_min(a + 0 * b, 900)", text)),
        f"{frame()}, y AS (SELECT ts, CASE WHEN a >= 900 THEN a END AS x FROM f) SELECT ts, round({sql}, 6) AS value FROM y",
    )


BACK, AHEAD = "OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_PT, _PV = f"last(CASE WHEN x IS NOT NULL THEN ts END IGNORE NULLS) {BACK}", f"last(x IGNORE NULLS) {BACK}"
_NT, _NV = f"first(CASE WHEN x IS NOT NULL THEN ts END IGNORE NULLS) {AHEAD}", f"first(x IGNORE NULLS) {AHEAD}"
_gaps("t15_fill_forward", "fill_forward(x)", _PV)
_gaps("t16_fill_backward", "fill_backward(x)", _NV)
_gaps("t17_fill_linear", "fill_linear(x)", f"coalesce(x, {_PV} + ({_NV} - {_PV}) * ((ts - {_PT}) / ({_NT} - {_PT})))")
add(
    "t20_integral",
    lambda s, d: two(s, d, "integral(a - b)"),
    f"{frame()}, z AS (SELECT ts, a - b AS x FROM f), y AS (SELECT ts, (x + lag(x) {W}) / 2 * {SEC} AS v FROM z) SELECT ts, round(coalesce(sum(v) {W}, 0), 6) AS value FROM y",
)
add(
    "t23_time_shift",
    lambda s, d: two(s, d, "time_shift(a, '1d') * 2", "1d"),
    f"{frame(DAY, 'a')} SELECT ts + {DAY} AS ts, round(a * 2, 6) AS value FROM f",
)
for _n, _t, _step in (
    ("r09_ema", "ema(a - b, 0.3)", "SELECT 1::BIGINT AS n, (SELECT x FROM o WHERE n = 1) AS s, 0::DOUBLE AS tr UNION ALL SELECT r.n + 1, 0.3 * o.x + 0.7 * r.s, 0 FROM r JOIN o ON o.n = r.n + 1"),
    (
        "r10_holt_winters",
        "holt_winters(a - b, 0.5, 0.2)",
        "SELECT 1::BIGINT AS n, (SELECT x FROM o WHERE n = 1) AS s, 0::DOUBLE AS tr UNION ALL SELECT r.n + 1, 0.5 * o.x + 0.5 * (r.s + r.tr), 0.2 * ((0.5 * o.x + 0.5 * (r.s + r.tr)) - r.s) + 0.8 * r.tr FROM r JOIN o ON o.n = r.n + 1",
    ),
):
    add(
        _n,
        lambda s, d, t=_t: two(s, d, t),
        f"WITH RECURSIVE {frame().removeprefix('WITH ')}, o AS (SELECT row_number() {W} AS n, ts, a - b AS x FROM f), r AS ({_step}) SELECT o.ts, round(r.s, 6) AS value FROM r JOIN o USING (n)",
    )
_BELL = "exp(-0.5 * ((q.i - p.i) / 2.0) ** 2)"
add(
    "r11_gaussian_smooth",
    lambda s, d: two(s, d, "gaussian_smooth(a - b, 2)"),
    f"{frame()}, o AS (SELECT row_number() {W} AS i, ts, a - b AS x FROM f) SELECT p.ts, round(sum(q.x * {_BELL}) / sum({_BELL}), 6) AS value FROM o p JOIN o q ON q.i BETWEEN p.i - 6 AND p.i + 6 GROUP BY p.ts",
)
add("t18_fill_spline", lambda s, d: two(s, d, "fill_spline(cutoff_min(a + 0 * b, 900))"))

# Alignment.
for _how, _times in (("inner", "SELECT ts FROM xa JOIN xb USING (ts)"), ("outer", "SELECT ts FROM xa UNION SELECT ts FROM xb"), ("left", "SELECT ts FROM xa")):
    add(
        f"j_align_{_how}",
        lambda s, d, how=_how: rounded(align({k: numeric(events(s, d), f"sum:events(value){{event_type:{t}}}", START, END, "1m") for k, t in KINDS.items()}, how), "a", "b"),
        "WITH "
        + ", ".join(f"x{k} AS (SELECT t // {MINUTE} * {MINUTE} AS ts, sum(value) AS v FROM {EV} WHERE event_type = '{t}' AND {RANGE} GROUP BY 1)" for k, t in KINDS.items())
        + f", g AS ({_times}) SELECT ts, round(ra.v, 6) AS a, round(rb.v, 6) AS b FROM {on('a')} ra JOIN {on('b')} rb USING (ts)",
    )
_SRC = f"SELECT t // {MINUTE} * {MINUTE} AS ts, sum(value) AS v FROM {EV} WHERE event_type = 'click' AND {RANGE} GROUP BY 1"
_TGT = f"SELECT DISTINCT t // {MINUTE} * {MINUTE} + {MINUTE // 2} AS ts FROM {EV} WHERE event_type = 'purchase' AND {RANGE}"
for _mode, _value in (
    ("linear", "CASE WHEN p.ts IS NULL THEN n.v WHEN n.ts IS NULL THEN p.v ELSE p.v + (n.v - p.v) * ((g.ts - p.ts) / (n.ts - p.ts)) END"),
    ("previous", "p.v"),
    ("next", "n.v"),
    ("zero", "0::DOUBLE"),
    ("nan", "NULL::DOUBLE"),
):

    def _interpolated(s, d, mode=_mode):
        src = numeric(events(s, d), "sum:events(value){event_type:click}", START, END, "1m")
        at = numeric(events(s, d), "sum:events(value){event_type:purchase}", START, END, "1m").select((F.col("ts") + MINUTE // 2).alias("ts"))
        return rounded(interpolate(src, at, mode))

    add(f"j05_interpolate_{_mode}", _interpolated, f"WITH x AS ({_SRC}), g AS ({_TGT}) SELECT g.ts, round({_value}, 6) AS value FROM g ASOF LEFT JOIN x p ON g.ts >= p.ts ASOF LEFT JOIN x n ON g.ts <= n.ts")
add("j04_resample_dense_grid", lambda s, d: two(s, d, "a + b", "1h"), f"{frame(HOUR)} SELECT ts, round(a + b, 6) AS value FROM f")


# Groups.
def by_user(s, d):
    return numeric(events(s, d), "avg:events(value){} by {user_id}", START, END, "1d").select("user_id", "ts", "value")


_BYUSER = f"SELECT user_id, t // {DAY} * {DAY} AS ts, avg(value) AS value FROM {EV} WHERE {RANGE} GROUP BY 1, 2"
for _fn, _dir in (("topk", "DESC"), ("bottomk", "ASC")):
    add(
        f"{'x12' if _fn == 'topk' else 'x13'}_group_{_fn}",
        lambda s, d, fn=_fn: rounded(getattr(groups, fn)(by_user(s, d), ["user_id"], 5)),
        f"WITH x AS ({_BYUSER}), m AS (SELECT user_id FROM x GROUP BY 1 ORDER BY avg(value) {_dir}, user_id LIMIT 5) SELECT user_id, ts, round(value, 6) AS value FROM x SEMI JOIN m USING (user_id)",
    )
for _fn, _s in (("avg", "avg(value)"), ("sum", "sum(value)"), ("min", "min(value)"), ("max", "max(value)"), ("percentile", "quantile_cont(value, 0.9)")):
    add(
        f"x14_group_{_fn}_of_series",
        lambda s, d, fn=_fn: rounded(groups.of_series(by_user(s, d), fn, 90)),
        f"SELECT ts, round({_s}, 6) AS value FROM ({_BYUSER}) GROUP BY 1",
    )
add(
    "v_formula_by_group",
    lambda s, d: rounded(derive_by({"events": events(s, d)}, DerivedQuery().query("a", "sum:events(value)").formula("rolling_avg(a, 3) - a").between(START, END).every("1d"), ["event_type"])),
    f"WITH x AS (SELECT event_type, t // {DAY} * {DAY} AS ts, sum(value) AS a FROM {EV} WHERE {RANGE} GROUP BY 1, 2) SELECT event_type, ts, round(CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts) >= 3 THEN avg(a) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) - a END, 6) AS value FROM x",
)


# Analytics.
def one(s, d, text, interval="1h"):
    q = DerivedQuery().query("a", "avg:events(value)").formula(text).between(START, END).every(interval)
    return derive({"events": events(s, d)}, q)


_P60 = "OVER (ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
_HOURLY = f"SELECT t // {HOUR} * {HOUR} AS ts, avg(value) AS v FROM {EV} WHERE {RANGE} GROUP BY 1"


def bounded(least: str, scale: str, at: str, bounds: int) -> str:
    """Select list of the anomaly pieces: the first `least` points have no bounds and no score."""
    up, low = f"({at} + {bounds} * {scale})", f"({at} - {bounds} * {scale})"
    return f"""ts, round(v, 6) AS raw, CASE WHEN i < {least} THEN 'infinity'::DOUBLE ELSE round({up}, 6) END AS upper,
      CASE WHEN i < {least} THEN '-infinity'::DOUBLE ELSE round({low}, 6) END AS lower,
      CASE WHEN i < {least} THEN 0 ELSE round(greatest(v - {up}, 0) + greatest({low} - v, 0), 6) END AS scores, round({at}, 6) AS predictions"""


_BASIC = f"""WITH x AS ({_HOURLY}),
    m AS (SELECT ts, v, row_number() {W} - 1 AS i, avg(v) {_P60} AS mean, stddev_samp(v) {_P60} AS dev FROM x),
    b AS (SELECT ts, v, i, CASE WHEN i < 10 THEN v ELSE mean END AS mean, greatest(dev, abs(mean) * 0.01) AS s FROM m)
    SELECT {bounded("10", "s", "mean", 2)} FROM b"""
add("n01_anomalies_basic", lambda s, d: rounded(one(s, d, "anomalies(a, 'basic', 2)"), "raw", "upper", "lower", "scores", "predictions"), _BASIC)
add(
    "n06_anomaly_pieces",
    lambda s, d: rounded(anomaly.pieces(one(s, d, "anomalies(a, 'basic', 2)"))),
    f"WITH n AS ({_BASIC}) " + " UNION ALL ".join(f"SELECT '{p}' AS piece, ts, {p} AS value FROM n" for p in anomaly.PIECES),
)
# Holt-Winters with a season as a queue, whose head is the next point's; the period from the usual gap.
add(
    "n02_anomalies_agile",
    lambda s, d: rounded(one(s, d, "anomalies(a, 'agile', 2, 'daily')"), "raw", "upper", "lower", "scores", "predictions"),
    f"""WITH RECURSIVE x AS ({_HOURLY}),
    o AS (SELECT row_number() {W} - 1 AS i, ts, v FROM x),
    l AS (SELECT list(v ORDER BY ts) AS vs, list(ts ORDER BY ts) AS t FROM x),
    g AS (SELECT vs, [t[j + 1] - t[j] FOR j IN range(1, len(t))] AS gaps, len(t) - 1 AS n FROM l),
    q AS (SELECT vs, list_sort(gaps[1:10] || gaps[n // 2 + 1:n // 2 + 10] || gaps[n - 9:n]) AS few FROM g),
    p AS (SELECT vs, CAST({DAY} // few[len(few) // 2 + 1] AS BIGINT) AS period FROM q),
    h AS (SELECT period, list_avg(vs[1:period]) AS level, [z - list_avg(vs[1:period]) FOR z IN vs[1:period]] AS season FROM p),
    r(i, level, trend, season, guess) AS (
      SELECT -1::BIGINT, level, 0::DOUBLE, season, 0::DOUBLE FROM h
      UNION ALL
      SELECT i, 0.3 * (v - s) + 0.7 * (level + trend), 0.1 * (0.3 * (v - s) + 0.7 * (level + trend) - level) + 0.9 * trend,
        list_append(season[2:], 0.3 * (v - (0.3 * (v - s) + 0.7 * (level + trend))) + 0.7 * s), level + trend + s
      FROM (SELECT o.i, o.v, r.level, r.trend, r.season, r.season[1] AS s FROM r JOIN o ON o.i = r.i + 1)),
    e AS (SELECT o.i, o.ts, o.v, r.guess, coalesce(stddev_samp(o.v - r.guess) OVER (ORDER BY o.i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 0) AS dev FROM o JOIN r USING (i)),
    b AS (SELECT *, greatest(dev, abs(guess) * 0.01) AS s, greatest(10, (SELECT period FROM h) // 4) AS least FROM e)
    SELECT {bounded("least", "s", "guess", 2)} FROM b""",
)
add("n03_anomalies_robust", lambda s, d: one(s, d, "anomalies(a, 'robust', 3, 'daily')"))
add("p02_forecast_seasonal", lambda s, d: one(s, d, "forecast(a, 'seasonal', 2, seasonality='daily')"))
add("p03_forecast_multi", lambda s, d: one(s, d, "forecast(a, 'seasonal', 2, seasonality='multi')"))
add("p04_forecast_auto", lambda s, d: one(s, d, "forecast(a, 'seasonal', 2, seasonality='auto')"))


def line(x: str, weight: str = "1.0", start: str = "0", keys: str = "") -> str:
    """Weighted least squares over the series x (keys, ts, v), from point `start` on (of n points), and its future."""
    k, using = (f"{keys}, ", f"USING ({keys})") if keys else ("", "ON true")
    by = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""WITH x AS ({x}),
    o AS (SELECT {k}ts, v, row_number() OVER ({by} ORDER BY ts) - 1 AS i, count(*) OVER ({by}) AS n FROM x),
    lim AS (SELECT {k}min(ts) AS lo, max(ts) AS hi, (max(ts) - min(ts)) // (any_value(n) - 1) AS gap FROM o {group}),
    c AS (SELECT {k}i, v, {weight} AS w FROM o WHERE i >= {start}),
    m AS (SELECT {k}sum(w) AS total, sum(w * i) / sum(w) AS mx, sum(w * v) / sum(w) AS my, count(*) AS n FROM c {group}),
    q AS (SELECT {k}any_value(total) AS total, any_value(mx) AS mx, any_value(my) AS my, any_value(m.n) AS n,
      sum(w * (i - mx) ** 2) AS sxx, sum(w * (i - mx) * (v - my)) / sum(w * (i - mx) ** 2) AS slope FROM c JOIN m {using} {group}),
    e AS (SELECT {k}any_value(total) AS total, any_value(mx) AS mx, any_value(my) AS my, any_value(n) AS n, any_value(sxx) AS sxx, any_value(slope) AS slope,
      sqrt(sum(w * (v - my - slope * (i - mx)) ** 2) * any_value(n) / (any_value(total) * (any_value(n) - 2))) AS dev FROM c JOIN q {using} {group}),
    h AS (SELECT {k}lo, hi, gap, unnest(range(1, ({END} - {START}) // gap + 1)) AS j FROM lim),
    f AS (SELECT {k}hi + gap * j AS ts, my + slope * ((hi + gap * j - lo) / gap - mx) AS y,
      2 * dev * sqrt(1 + 1 / n + ((hi + gap * j - lo) / gap - mx) ** 2 / sxx) AS s FROM h JOIN e {using})
    SELECT {k}ts, round(v, 6) AS past, CASE WHEN i = n - 1 THEN round(v, 6) END AS forecast, NULL::DOUBLE AS upper, NULL::DOUBLE AS lower FROM o
    UNION ALL SELECT {k}ts, NULL, round(y, 6), round(y + s, 6), round(y - s, 6) FROM f"""


FORECAST = ("past", "forecast", "upper", "lower")
_DAILY = f"SELECT t // {DAY} * {DAY} AS ts, avg(value) AS v FROM {EV} WHERE {RANGE} GROUP BY 1"
_BYTYPE = f"SELECT event_type, t // {DAY} * {DAY} AS ts, avg(value) AS v FROM {EV} WHERE {RANGE} GROUP BY 1, 2"
add("p01_forecast_linear", lambda s, d: rounded(one(s, d, "forecast(a, 'linear', 2)", "1d"), *FORECAST), line(_DAILY))
add("p01_forecast_simple", lambda s, d: rounded(one(s, d, "forecast(a, 'linear', 2, model='simple')", "1d"), *FORECAST), line(_DAILY, start="n // 2"))
add(
    "p01_forecast_reactive",
    lambda s, d: rounded(one(s, d, "forecast(a, 'linear', 2, model='reactive', history='1w')"), *FORECAST),
    line(f"SELECT * FROM ({_HOURLY}) WHERE ts >= (SELECT max(t // {HOUR} * {HOUR}) FROM {EV} WHERE {RANGE}) - {7 * DAY}", "exp(-0.05 * (n - 1 - i))"),
)
add(
    "p10_forecast_by_type",
    lambda s, d: rounded(derive_by({"events": events(s, d)}, DerivedQuery().query("a", "avg:events(value)").formula("forecast(a, 'linear', 2)").between(START, END).every("1d"), ["event_type"]), *FORECAST),
    line(_BYTYPE, keys="event_type"),
)

# Catalog.
add("d02_tags", lambda s, d: catalog.tags(events(s, d)), "SELECT DISTINCT 'event_type' AS key, event_type AS value FROM events WHERE event_type IS NOT NULL UNION ALL SELECT DISTINCT 'user_id', user_id::VARCHAR FROM events WHERE user_id IS NOT NULL")
add(
    "d05_series",
    lambda s, d: catalog.find_series(events(s, d), parse_query("avg:events(){event_type:c*}").scopes).select("event_type", "user_id", "field", "series_key"),
    "SELECT DISTINCT event_type, user_id, 'value' AS field, 'events,event_type=' || event_type || ',user_id=' || user_id || ' value' AS series_key FROM events WHERE event_type LIKE 'c%' AND value IS NOT NULL",
)
add("d05_series_by_tag", lambda s, d: catalog.series_by_tag(events(s, d), "event_type"), "SELECT event_type AS value, count(DISTINCT user_id) AS n_series FROM events WHERE value IS NOT NULL GROUP BY 1")
add(
    "d06_field_stats",
    lambda s, d: catalog.field_stats(events(s, d)),
    f"SELECT event_type, user_id, 'value' AS field, count(value) AS n, min(t) AS min_ts, max(t) AS max_ts FROM {EV} WHERE value IS NOT NULL GROUP BY 1, 2",
)
add("a24_cardinality_exact", lambda s, d: catalog.cardinality(events(s, d), exact=True), "SELECT count(*) AS estimate FROM (SELECT DISTINCT event_type, user_id FROM events WHERE value IS NOT NULL)")
add("a24_tag_cardinality_exact", lambda s, d: catalog.cardinality(events(s, d), "event_type", True), "SELECT event_type AS value, count(DISTINCT user_id) AS estimate FROM events WHERE value IS NOT NULL GROUP BY 1")


def gaps(s, d):
    """Fields that not every series has."""
    df = lineitem(s, d).df.withColumn("l_tax", F.expr("if(l_linenumber > 3, null, l_tax)")).withColumn("l_discount", F.expr("if(l_returnflag = 'R', null, l_discount)"))
    return Source(df, "lineitem", ("l_returnflag", "l_orderkey", "l_linenumber"), ("l_quantity", "l_tax", "l_discount"), "l_shipdate")


_TAGSETS = "SELECT DISTINCT l_returnflag, l_orderkey, l_linenumber, {f} FROM lineitem WHERE {c}"
_GAPS = " UNION ALL ".join(_TAGSETS.format(f=f"'{f}' AS f", c=c) for f, c in (("q", "l_quantity IS NOT NULL"), ("t", "l_linenumber <= 3 AND l_tax IS NOT NULL"), ("d", "l_returnflag <> 'R' AND l_discount IS NOT NULL")))
add("a24_cardinality_of_gappy_fields", lambda s, d: catalog.cardinality(gaps(s, d), exact=True), f"SELECT count(*) AS estimate FROM ({_GAPS})")
add("a24_tag_cardinality_of_gappy_fields", lambda s, d: catalog.cardinality(gaps(s, d), "l_returnflag", True), f"SELECT l_returnflag AS value, count(*) AS estimate FROM ({_GAPS}) GROUP BY 1")
add("a24_cardinality_estimate", lambda s, d: catalog.cardinality(events(s, d)))


# The canonical long table, deletes, retention.
def points(s, d):
    e = events(s, d).df
    return e.select(
        F.lit("events").alias("measurement"),
        F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string")).alias("tags"),
        F.lit("value").alias("field"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts"),
        F.col("value").alias("v"),
        F.lit(None).cast("long").alias("l"),
        F.lit(None).cast("boolean").alias("b"),
        F.lit(None).cast("string").alias("s"),
        F.col("event_id").alias("seq"),
    )


MID = START + 10 * DAY
add("d01_measurements", lambda s, d: catalog.measurements(points(s, d), "ev"), "SELECT 'events' AS measurement, 1::BIGINT AS total")
add("d03_fields", lambda s, d: catalog.fields_of_points(points(s, d), "events"), "SELECT 'value' AS field, 'float' AS type")
add(
    "d07_delete_series_range",
    lambda s, d: maintenance.delete(points(s, d), [maintenance.Delete.parse({"measurement": "events", "tags": {"event_type": "click", "user_id": "7"}, "field": "value", "startTime": START, "endTime": MID})]).select("seq", "ts"),
    f"SELECT event_id AS seq, t AS ts FROM {EV} WHERE NOT (event_type = 'click' AND user_id = 7 AND t BETWEEN {START} AND {MID})",
)
add(
    "d08_delete_pattern_batch",
    lambda s, d: maintenance.delete(points(s, d), [maintenance.Delete.parse(x) for x in ({"measurement": "events", "tags": {"event_type": "view"}}, {"measurement": "events", "fields": ["value"], "startTime": MID}, {"measurement": "other"})]).select("seq", "ts"),
    f"SELECT event_id AS seq, t AS ts FROM {EV} WHERE event_type <> 'view' AND t < {MID}",
)
add("d10_retention_ttl", lambda s, d: maintenance.expire(events(s, d), "2w", END).select("event_id"), f"SELECT event_id FROM {EV} WHERE t >= {END - 14 * DAY}")
add(
    "d11_downsample",
    lambda s, d: rounded(maintenance.downsample(events(s, d), maintenance.Downsample("2w", "6h", "avg"), END)),
    f"SELECT event_type, user_id, 'value' AS field, CASE WHEN t < {END - 14 * DAY} THEN t // {6 * HOUR} * {6 * HOUR} ELSE t END AS ts, round(avg(value), 6) AS value FROM {EV} WHERE value IS NOT NULL GROUP BY 1, 2, 4, t < {END - 14 * DAY}",
)
add(
    "s13_compaction",
    lambda s, d: maintenance.compact(points(s, d).unionAll(points(s, d).withColumns({"seq": F.col("seq") + 10**9, "v": F.col("v") + 1})), ttl={"events": "2w"}, now=END).select("field", "ts", F.round("v", 6).alias("v"), "seq"),
    f"SELECT 'value' AS field, t AS ts, round(arg_max(value, event_id) + 1, 6) AS v, max(event_id) + 1000000000 AS seq FROM {EV} WHERE t >= {END - 14 * DAY} GROUP BY event_type, user_id, t",
)
add(
    "s15_response_statistics",
    lambda s, d: formats.statistics(numeric(events(s, d), "avg:events(value){} by {event_type}", START, END, "1h"), ["event_type"]),
    f"SELECT count(DISTINCT event_type) AS series_count, count(*) AS point_count FROM (SELECT event_type, t // {HOUR} FROM {EV} WHERE {RANGE} GROUP BY ALL)",
)
add(
    "s15_response_json",
    lambda s, d: formats.response(numeric(events(s, d), "max:events(value){} by {event_type}", START, END, "1d"), "events", ["event_type"]),
    f"""SELECT event_type, '{{"measurement":"events","groupTags":{{"event_type":"' || event_type || '"}},"fields":{{"value":{{"timestamps":' || replace(list(ts ORDER BY ts)::VARCHAR, ' ', '')
      || ',"values":' || replace(list(v ORDER BY ts)::VARCHAR, ' ', '') || '}}}}}}' AS series FROM ({_BYTYPE.replace('avg', 'max')}) GROUP BY 1""",
)


def _written(s, d):
    e = events(s, d).df.where("value IS NOT NULL")
    body = F.to_json(F.struct(F.lit("events").alias("measurement"), F.struct("event_type", F.col("user_id").cast("string").alias("user_id")).alias("tags"), F.struct(F.col("value").alias("value")).alias("fields"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp")))
    got, _ = writes.parse(e.select(body.alias("body")), now=0)
    return got.select("measurement", F.col("tags")["event_type"].alias("event_type"), "field", "ts", F.round("v", 6).alias("v"))


add("s01_json_writes", _written, f"SELECT 'events' AS measurement, event_type, 'value' AS field, t AS ts, round(value, 6) AS v FROM {EV} WHERE value IS NOT NULL")

# The same aggregation a live subscription runs, over finished buckets.
add(
    "l02_tumbling_10m",
    lambda s, d: rounded(subscribe.tumbling(events(s, d), "avg:events(value){event_type:click}", "10m")).drop("text"),
    f"SELECT event_type, user_id, 'value' AS field, t // {10 * MINUTE} * {10 * MINUTE} AS ts, round(avg(value), 6) AS value, count(*) AS n FROM {EV} WHERE event_type = 'click' AND value IS NOT NULL GROUP BY 1, 2, 4",
)
for _m in subscribe.METHODS:
    add(
        f"l03_tumbling_{_m}",
        lambda s, d, m=_m: rounded(subscribe.tumbling(events(s, d), f"{m}:events(value)", "6h")).drop("text"),
        f"SELECT event_type, user_id, 'value' AS field, t // {6 * HOUR} * {6 * HOUR} AS ts, round({SQL[_m].replace('(t, event_type, user_id)', 't')}, 6) AS value, count(*) AS n FROM {EV} WHERE value IS NOT NULL GROUP BY 1, 2, 4",
    )
add(
    "l04_string_buckets",
    lambda s, d: subscribe.tumbling(typed_events(s, d), "latest:events(props)", "6h").drop("value"),
    f"SELECT event_type, user_id, 'props' AS field, t // {6 * HOUR} * {6 * HOUR} AS ts, arg_max(props, t) AS text, count(*) AS n FROM (SELECT *, epoch_us(ts) * 1000 AS t FROM events) WHERE props IS NOT NULL GROUP BY 1, 2, 4",
)
_CARRIED = ", ".join(
    f"CASE WHEN last_value(CASE WHEN {n} IS NOT NULL THEN ts END IGNORE NULLS) {W} >= ts - {subscribe.CARRY * MINUTE} THEN last_value({n} IGNORE NULLS) {W} END AS {n}" for n in KINDS
)
add(
    "l07_carried_formula",
    lambda s, d: rounded(subscribe.carried({k: numeric(events(s, d), f"sum:events(value){{event_type:{t}}}", START, END, "1m").select("ts", "value") for k, t in KINDS.items()}, "a - b", "1m")),
    "WITH "
    + ", ".join(f"x{k} AS (SELECT t // {MINUTE} * {MINUTE} AS ts, sum(value) AS v FROM {EV} WHERE event_type = '{t}' AND {RANGE} GROUP BY 1)" for k, t in KINDS.items())
    + f", g AS (SELECT ts, xa.v AS a, xb.v AS b FROM xa FULL JOIN xb USING (ts)), c AS (SELECT ts, {_CARRIED} FROM g) SELECT ts, round(a - b, 6) AS value FROM c",
)


# The remaining rows of the inventory that are plans of their own.
def _arrays(s, d):
    """One array write per series and day, parsed back to points."""
    e = events(s, d).df.where("value IS NOT NULL")
    ns = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t")
    by = e.groupBy("event_type", "user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct(ns, "value"))).alias("p"))
    body = F.to_json(
        F.struct(
            F.lit("events").alias("measurement"),
            F.struct("event_type", F.col("user_id").cast("string").alias("user_id")).alias("tags"),
            F.struct(F.col("p.value").alias("value")).alias("fields"),
            F.col("p.t").alias("timestamps"),
        )
    )
    got, _ = writes.parse(by.select(body.alias("body")), now=0)
    return got.select(F.col("tags")["event_type"].alias("event_type"), F.col("tags")["user_id"].alias("user_id"), "ts", F.round("v", 6).alias("v"))


def _binary(s, d):
    """The same as binary requests of one write each, built and parsed back."""
    import pyarrow as pa

    e = events(s, d).df.where("value IS NOT NULL")
    ns = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t")
    by = e.groupBy("event_type", F.col("user_id").cast("string").alias("user_id"), F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct(ns, "value"))).alias("p"))

    def encode(batches):
        for batch in batches:
            bodies = [proto.request([("events", {"event_type": r["event_type"], "user_id": r["user_id"]}, {"value": ("v", [x["value"] for x in r["p"]])}, [x["t"] for x in r["p"]])]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary())], ["body"])

    got, _ = proto.parse(by.select("event_type", "user_id", "p").mapInArrow(encode, "body binary"), now=0)
    return got.select(F.col("tags")["event_type"].alias("event_type"), F.col("tags")["user_id"].alias("user_id"), "ts", F.round("v", 6).alias("v"))


add("s05_proto_writes", _binary, f"SELECT event_type, user_id::VARCHAR AS user_id, t AS ts, round(value, 6) AS v FROM {EV} WHERE value IS NOT NULL")
add("s02_array_writes", _arrays, f"SELECT event_type, user_id::VARCHAR AS user_id, t AS ts, round(value, 6) AS v FROM {EV} WHERE value IS NOT NULL")


def _failures(s, d):
    """Batches of two writes, of which the one for errors has no measurement."""
    e = events(s, d).df.where("value IS NOT NULL")
    name = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    entry = F.struct(name.alias("measurement"), F.struct(F.col("value").alias("v")).alias("fields"), F.col("event_id").alias("timestamp"))
    extra = F.struct(F.lit("all").alias("measurement"), F.struct(F.col("value").alias("v")).alias("fields"), F.col("event_id").alias("timestamp"))
    good, bad = writes.parse(e.select(F.to_json(F.struct(F.array(entry, extra).alias("writes"))).alias("body")), now=0)
    return good.groupBy("measurement").agg(F.count("*").alias("n")).unionAll(bad.agg(F.lit("failed"), F.count("*")))


add("s03_batch_writes", _failures, "SELECT event_type AS measurement, count(*) AS n FROM events WHERE value IS NOT NULL AND event_type <> 'error' GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM events WHERE value IS NOT NULL UNION ALL SELECT 'failed', count(*) FROM events WHERE value IS NOT NULL AND event_type = 'error'")


def _bound(s, d):
    """Integers written to a field that began as a float, or as a boolean."""
    e = events(s, d).df
    body = F.to_json(F.struct(F.lit("m").alias("measurement"), F.struct(F.col("user_id").alias("f"), (F.col("user_id") % 2).alias("b")).alias("fields"), F.col("event_id").alias("timestamp")))
    types = s.createDataFrame([("m", "f", "double"), ("m", "b", "boolean")], "measurement string, field string, type string")
    good, _ = writes.parse(e.select(body.alias("body")), now=0, bound=types)
    return good.groupBy("ts").agg(F.max("v").alias("f"), F.max("b").alias("b"))


add("s07_type_binding", _bound, "SELECT event_id AS ts, CAST(user_id AS DOUBLE) AS f, user_id % 2 = 1 AS b FROM events")
add(
    "d04_series_by_id",
    lambda s, d: catalog.series_by_id(events(s, d), s.range(1).select(F.xxhash64(F.lit("events,event_type=click,user_id=7 value"))).first()[0]).select("event_type", "user_id", "field", "series_key"),
    "SELECT DISTINCT event_type, user_id, 'value' AS field, 'events,event_type=click,user_id=7 value' AS series_key FROM events WHERE event_type = 'click' AND user_id = 7 AND value IS NOT NULL",
)
add(
    "l01_raw_subscription",
    lambda s, d: subscribe.raw(events(s, d), "latest:events(value){event_type:~c.*}").drop("text"),
    f"SELECT event_type, user_id, 'value' AS field, t AS ts, value FROM {EV} WHERE event_type LIKE 'c%' AND value IS NOT NULL",
)
add(
    "l06_formula_of_one_query",
    lambda s, d: rounded(subscribe.batches(subscribe.tumbling(events(s, d), "sum:events(value)", "1h"), "abs(diff(a)) + 1", ["event_type", "user_id"])),
    f"""WITH x AS (SELECT event_type, user_id, t // {HOUR} * {HOUR} AS ts, sum(value) AS a FROM {EV} WHERE value IS NOT NULL GROUP BY ALL)
    SELECT event_type, user_id, 'value' AS field, ts, round(abs(a - lag(a) OVER (PARTITION BY event_type, user_id ORDER BY ts)) + 1, 6) AS value FROM x""",
)
add(
    "n05_alert_by_type",
    lambda s, d: rounded(anomaly.alert(derive_by({"events": events(s, d)}, DerivedQuery().query("a", "avg:events(value)").formula("anomalies(a, 'basic', 2)").between(START, END).every("1h"), ["event_type"]), ["event_type"]), "alert"),
    f"""WITH x AS (SELECT event_type, t // {HOUR} * {HOUR} AS ts, avg(value) AS v FROM {EV} WHERE {RANGE} GROUP BY 1, 2),
    m AS (SELECT event_type, v, row_number() OVER k - 1 AS i, avg(v) OVER p AS mean, stddev_samp(v) OVER p AS dev FROM x
      WINDOW k AS (PARTITION BY event_type ORDER BY ts), p AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
    b AS (SELECT event_type, i, v, mean, greatest(dev, abs(mean) * 0.01) AS s FROM m)
    SELECT event_type, round(max(CASE WHEN i < 10 THEN 0 ELSE greatest(v - (mean + 2 * s), 0) + greatest(mean - 2 * s - v, 0) END), 6) AS alert FROM b GROUP BY 1""",
)
