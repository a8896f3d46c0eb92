"""`method:measurement(fields){scopes} by {keys}` as a frozen specification."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .values import ParseError

METHODS = ("avg", "min", "max", "sum", "count", "latest", "first", "median", "exact_median", "stddev", "stdvar", "spread")
MAX_PATTERN = 512


@dataclass(frozen=True)
class Scope:
    """A condition on one tag. kind: exact, wildcard or regex; pattern: for the
    last two a regular expression that must match the whole value."""

    key: str
    value: str
    kind: str = "exact"
    pattern: str = ""
    prefix: str = ""


@dataclass(frozen=True)
class QuerySpec:
    method: str
    measurement: str
    fields: tuple[str, ...] = ()
    scopes: tuple[Scope, ...] = ()
    group_by: tuple[str, ...] = field(default=())


def parse_query(text: str) -> QuerySpec:
    if not text.strip():
        raise ParseError("query string cannot be empty")
    method, colon, rest = text.lstrip().partition(":")
    if not colon:
        raise ParseError("query needs an aggregation method")
    method = method.strip().lower()
    if method not in METHODS:
        raise ParseError(f"unknown aggregation method: {method!r}")
    m = re.match(r"([^({]*)", rest)
    measurement, rest = m[1].strip(), rest[m.end() :]
    if not measurement:
        raise ParseError("query measurement must be present")
    if not rest.startswith("("):
        raise ParseError("query is missing field parentheses after the measurement")
    inside, closed, rest = rest[1:].partition(")")
    if not closed:
        raise ParseError("query is missing the closing parenthesis of its fields")
    fields = _names(inside, "field") if inside.strip() else ()
    rest = rest.lstrip()
    scopes: tuple[Scope, ...] = ()
    if rest.startswith("{"):
        inside, closed, rest = rest[1:].partition("}")
        if not closed:
            raise ParseError("query is missing the closing brace of its scopes")
        scopes = _scopes(inside)
        rest = rest.lstrip()
    keys: tuple[str, ...] = ()
    if rest:
        m = re.match(r"by(?=[ \t{]|$)\s*", rest)
        if not m:
            raise ParseError(f"unexpected characters after query: {rest!r}")
        rest = rest[m.end() :]
        if not rest.startswith("{"):
            raise ParseError("query is missing the open brace of its group")
        inside, closed, rest = rest[1:].partition("}")
        if not closed:
            raise ParseError("query is missing the closing brace of its group")
        keys = tuple(dict.fromkeys(_names(inside, "group")))
        if rest.strip():
            raise ParseError(f"unexpected characters after group by: {rest!r}")
    return QuerySpec(method, measurement, tuple(dict.fromkeys(fields)), scopes, keys)


def _names(text: str, what: str) -> tuple[str, ...]:
    names = tuple(x.strip() for x in text.split(","))
    if not all(names):
        raise ParseError(f"empty {what} name")
    return names


#: One `key:value`: the value is /.../ (slashes escaped by backslash), or runs to
#: a comma outside of [...]; a backslash keeps the next bracket from counting.
_PAIR = re.compile(r"([^:,]*):(\s*/(?:\\.|[^/\\])*/?[^,]*|(?:\\.|\[(?:\\.|[^\]\\])*(?:\]|$)|[^,\\\[]|\\$)*)(?:,|$)", re.S)


def _scopes(text: str) -> tuple[Scope, ...]:
    text, at, out = text.strip(), 0, {}
    while at < len(text):
        m = _PAIR.match(text, at)
        if not m:
            raise ParseError(f"invalid scope, expected key:value: {text[at:]!r}")
        key, value = m[1].strip(), m[2].strip()
        if not key or not value:
            raise ParseError(f"empty key or value in scope: {m[0]!r}")
        if key in out:
            raise ParseError(f"duplicate scope key: {key!r}")
        out[key] = make_scope(key, value)
        at = m.end()
    return tuple(out.values())


def make_scope(key: str, value: str) -> Scope:
    if value.startswith("~"):
        return _regex(key, value, value[1:])
    if len(value) >= 2 and value.startswith("/") and value.endswith("/"):
        return _regex(key, value, value[1:-1])
    if "*" in value or "?" in value:
        parts = re.split(r"([*?])", value)
        pattern = "".join({"*": ".*", "?": "."}.get(p, java_quote(p)) for p in parts)
        return Scope(key, value, "wildcard", f"^(?s:{pattern})$", parts[0])
    return Scope(key, value)


def java_quote(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|/\-#&~])", r"\\\1", text)


def _regex(key: str, value: str, pattern: str) -> Scope:
    check_pattern(pattern)
    try:
        re.compile(pattern)
    except re.error as e:
        raise ParseError(f"invalid regular expression for {key!r}: {e}") from e
    plain = re.match(r"[A-Za-z0-9_\- ]*", pattern)[0]
    if len(plain) < len(pattern) and pattern[len(plain)] in "*?{|+":
        plain = plain[:-1]
    return Scope(key, value, "regex", f"^(?:{pattern})$", "" if "|" in pattern else plain)


def check_pattern(pattern: str) -> None:
    """Refuses long patterns and groups that are repeated around a repetition or
    an alternation, which could take exponential time."""
    if len(pattern) > MAX_PATTERN:
        raise ParseError(f"pattern is longer than {MAX_PATTERN} characters")
    open_groups: list[list[bool]] = []
    for m in re.finditer(r"\\.|[()+*|]", pattern, re.S):
        c = m[0]
        if c == "(":
            open_groups.append([False, False])
        elif c == ")" and open_groups:
            repeats, choice = open_groups.pop()
            if (repeats or choice) and pattern[m.end() : m.end() + 1] in ("+", "*", "{"):
                raise ParseError("pattern repeats a group that holds a repetition or alternation")
            if open_groups and repeats:
                open_groups[-1][0] = True
        elif open_groups and c in "+*":
            open_groups[-1][0] = True
        elif open_groups and c == "|":
            open_groups[-1][1] = True
