"""The formula language: a precedence-climbing parser to small frozen nodes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .values import ParseError, parse_duration, parse_offset

MAX_DEPTH, MAX_ARGS, MAX_LENGTH = 100, 1000, 10240

#: Fixed names: one argument.
UNARY = frozenset(
    "abs log log10 sqrt ceil floor exp round sign deriv delta idelta changes resets standardize diff monotonic_diff default_zero count_nonzero count_not_null rate irate increase fill_forward fill_backward fill_linear fill_spline cumsum integral normalize".split()
)
#: Fixed names: smallest and largest number of arguments.
CALLS = {
    **dict.fromkeys("min max pow clamp_min clamp_max cutoff_min cutoff_max per_minute per_hour rolling_avg rolling_min rolling_max rolling_stddev rolling_sum rolling_median zscore fill_value ema gaussian_smooth topk bottomk as_percent".split(), (2, 2)),
    **dict.fromkeys("clamp holt_winters rolling_percentile".split(), (3, 3)),
    **dict.fromkeys("avg_of_series sum_of_series min_of_series max_of_series count_of_series stddev_of_series".split(), (1, MAX_ARGS)),
    "percentile_of_series": (2, MAX_ARGS),
    "histogram_quantile": (4, MAX_ARGS),
}
SPECIAL = ("anomalies", "forecast", "time_shift")


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Negate:
    arg: Node


@dataclass(frozen=True)
class Binary:
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class TimeShift:
    name: str
    offset: int


@dataclass(frozen=True)
class Anomalies:
    name: str
    algorithm: str
    bounds: float
    seasonality: str | None = None


@dataclass(frozen=True)
class Forecast:
    name: str
    algorithm: str
    deviations: float
    seasonality: str | None = None
    model: str | None = None
    history: str | None = None


Node = Number | Ref | Negate | Binary | Call | TimeShift | Anomalies | Forecast

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|'([^']*)'|\"([^\"]*)\"|([-+*/(),=]))")


class _Parser:
    def __init__(self, text: str):
        if len(text) > MAX_LENGTH:
            raise ParseError(f"formula is longer than {MAX_LENGTH} characters")
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected character in formula: {text[at:].strip()[0]!r}")
            kind = m.lastindex
            self.tokens.append(({1: "number", 2: "name", 3: "string", 4: "string", 5: m[5]}[kind], m[kind]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at, self.depth = 0, 0

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    def take(self, kind: str | None = None, what: str = "") -> str:
        have, value = self.tokens[self.at]
        if kind and have != kind:
            raise ParseError(f"expected {what or kind}, got {value or have!r}")
        self.at += 1
        return value

    def whole(self) -> Node:
        if self.kind == "end":
            raise ParseError("formula is empty")
        node = self.expression(0)
        self.take("end", "end of formula")
        return node

    def expression(self, least: int) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise ParseError(f"formula is nested deeper than {MAX_DEPTH}")
        left = self.operand()
        while (power := {"+": 1, "-": 1, "*": 2, "/": 2}.get(self.kind, 0)) > least:
            op = self.take()
            left = Binary(op, left, self.expression(power))
        self.depth -= 1
        return left

    def operand(self) -> Node:
        if self.kind in ("-", "+"):
            self.depth += 1
            if self.depth > MAX_DEPTH:
                raise ParseError(f"formula is nested deeper than {MAX_DEPTH}")
            sign, arg = self.take(), self.operand()
            self.depth -= 1
            if sign == "+":
                return arg
            return Number(-arg.value) if isinstance(arg, Number) else Negate(arg)
        if self.kind == "number":
            value = float(self.take())
            if value in (float("inf"),):
                raise ParseError("number out of range")
            return Number(value)
        if self.kind == "(":
            self.take()
            node = self.expression(0)
            self.take(")")
            return node
        if self.kind == "name":
            name = self.take()
            return self.call(name) if self.kind == "(" else Ref(name)
        raise ParseError(f"unexpected {self.tokens[self.at][1] or 'end of formula'!r}")

    def call(self, name: str) -> Node:
        if name in SPECIAL:
            return getattr(self, name)()
        if name not in UNARY and name not in CALLS:
            raise ParseError(f"unknown function: {name}")
        self.take("(")
        args: list[Node] = []
        if self.kind != ")":
            args.append(self.expression(0))
            while self.kind == ",":
                self.take()
                if len(args) >= MAX_ARGS:
                    raise ParseError(f"too many arguments (limit {MAX_ARGS})")
                args.append(self.expression(0))
        self.take(")")
        low, high = CALLS.get(name, (1, 1))
        if not low <= len(args) <= high or (name == "histogram_quantile" and len(args) % 2):
            raise ParseError(f"function {name!r} got {len(args)} arguments")
        return Call(name, tuple(args))

    def start(self) -> str:
        self.take("(")
        name = self.take("name", "a query reference")
        self.take(",")
        return name

    def time_shift(self) -> Node:
        name = self.start()
        offset = parse_offset(self.take("string", "an offset string"))
        self.take(")")
        return TimeShift(name, offset)

    def choice(self, allowed: tuple[str, ...]) -> str:
        value = self.take("string", " or ".join(map(repr, allowed)))
        if value not in allowed:
            raise ParseError(f"{value!r} is none of {', '.join(allowed)}")
        return value

    def width(self) -> float:
        self.take(",")
        value = float(self.take("number", "a number from 1 to 4"))
        if not 1 <= value <= 4:
            raise ParseError(f"must be between 1 and 4, got {value}")
        return value

    def anomalies(self) -> Node:
        name = self.start()
        algorithm = self.choice(("basic", "agile", "robust"))
        bounds = self.width()
        seasonality = None
        if self.kind == ",":
            self.take()
            seasonality = self.choice(("hourly", "daily", "weekly"))
        self.take(")")
        return Anomalies(name, algorithm, bounds, seasonality)

    def forecast(self) -> Node:
        name = self.start()
        algorithm = self.choice(("linear", "seasonal"))
        deviations = self.width()
        options: dict[str, str] = {}
        while self.kind == ",":
            self.take()
            key = self.take("name", "a parameter name")
            self.take("=")
            if key == "seasonality":
                options[key] = self.choice(("hourly", "daily", "weekly", "auto", "multi"))
            elif key == "model":
                options[key] = self.choice(("default", "simple", "reactive"))
            elif key == "history":
                options[key] = self.take("string", "a duration string")
                parse_duration(options[key])
            else:
                raise ParseError(f"unknown parameter: {key}")
        self.take(")")
        return Forecast(name, algorithm, deviations, **options)


def parse_formula(text: str) -> Node:
    node = _Parser(text).whole()
    if not isinstance(node, (Anomalies, Forecast)) and any(isinstance(x, (Anomalies, Forecast)) for x in walk(node)):
        raise ParseError("anomalies() and forecast() must be the whole formula")
    return node


def walk(node: Node):
    yield node
    for x in (node.arg,) if isinstance(node, Negate) else (node.left, node.right) if isinstance(node, Binary) else node.args if isinstance(node, Call) else ():
        yield from walk(x)


def references(node: Node) -> list[str]:
    """Names of the sub-queries a formula uses, sorted."""
    return sorted({x.name for x in walk(node) if isinstance(x, (Ref, TimeShift, Anomalies, Forecast))})
