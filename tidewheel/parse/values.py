"""Times, intervals and durations in nanoseconds."""

from __future__ import annotations

import calendar
import re
from datetime import datetime
from decimal import Decimal

MAX_TS = (1 << 63) - 1
#: Nanoseconds of each unit.
UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9}
WEEK = 7 * UNITS["d"]


class ParseError(ValueError):
    """A query, formula, time or duration that cannot be understood."""


def parse_time(value: int | float | str) -> int:
    """A number or numeric string is nanoseconds as is; else dd-mm-yyyy hh:mm:ss
    in UTC. Bounds above what a signed 64-bit integer holds are clamped."""
    if isinstance(value, bool):
        raise ParseError("a time must be a number or a string")
    if isinstance(value, (int, float)):
        ns = int(value)
    elif re.fullmatch(r"\s*-?\d+\s*", value):
        ns = int(value)
    else:
        m = re.fullmatch(r"(\d{2})-(\d{2})-(\d{4}) (\d{2}):(\d{2}):(\d{2})", value.strip())
        if not m:
            raise ParseError(f"invalid time: {value!r}")
        day, month, year, hour, minute, second = map(int, m.groups())
        try:
            ns = calendar.timegm(datetime(year, month, day, hour, minute, second).timetuple()) * 10**9
        except ValueError as e:
            raise ParseError(f"invalid time: {value!r}") from e
    if ns < 0:
        raise ParseError("a time must not be negative")
    return min(ns, MAX_TS)


def parse_interval(value: int | float | str | None) -> int:
    """0 without one; a bare number is nanoseconds."""
    if value is None or value == "":
        return 0
    if isinstance(value, (int, float)):
        if value < 0:
            raise ParseError("an interval must not be negative")
        return min(int(value), MAX_TS)
    m = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*(ns|us|µs|μs|ms|s|m|h|d)?\s*", value)
    if not m:
        raise ParseError(f"invalid interval: {value!r}")
    ns = int(Decimal(m[1]) * UNITS[m[2] or "ns"])
    if ns <= 0:
        raise ParseError(f"an interval must be positive: {value!r}")
    return min(ns, MAX_TS)


def parse_duration(value: str) -> int:
    """As an interval with a unit, weeks too; rounded."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*(ns|us|µs|μs|ms|s|m|h|d|w)\s*", value)
    if not m:
        raise ParseError(f"invalid duration: {value!r}")
    ns = round(Decimal(m[1]) * (WEEK if m[2] == "w" else UNITS[m[2]]))
    if ns <= 0:
        raise ParseError(f"a duration must be positive: {value!r}")
    return min(ns, MAX_TS)


def parse_offset(value: str) -> int:
    """A duration that may have a sign."""
    text = value.strip()
    return -parse_duration(text[1:]) if text.startswith("-") else parse_duration(text.removeprefix("+"))
