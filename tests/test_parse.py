import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewheel.parse import formula as f
from tidewheel.parse.query import METHODS, check_pattern, parse_query
from tidewheel.parse.values import MAX_TS, ParseError, parse_duration, parse_interval, parse_offset, parse_time
from tidewheel.sources.formats import split_series_key


def test_query_parts():
    q = parse_query(" AVG:server metrics(cpu, mem){host:web-*,dc:eu} by {host, rack}")
    assert (q.method, q.measurement, q.fields, q.group_by) == ("avg", "server metrics", ("cpu", "mem"), ("host", "rack"))
    assert [(s.key, s.kind, s.prefix) for s in q.scopes] == [("host", "wildcard", "web-"), ("dc", "exact", "")]
    assert parse_query("sum:m()").fields == ()


@pytest.mark.parametrize("text", ["", "m(f)", "foo:m(f)", "avg:(f)", "avg:m", "avg:m{a:b}", "avg:m(a,,b)", "avg:m(f", "avg:m(f){a}", "avg:m(f){a:}", "avg:m(f){a:b,a:c}", "avg:m(f){} by {}", "avg:m(f){} bytes {a}", "avg:m(f){} by {a} x", "avg:m(f){a:~(}", "avg:m(f) by"])
def test_query_errors(text):
    with pytest.raises(ParseError):
        parse_query(text)


def test_scope_values_keep_commas_in_patterns():
    q = parse_query("avg:m(f){a:~x[1,2]+,b:/p,q/,c:v}")
    assert [(s.key, s.value) for s in q.scopes] == [("a", "~x[1,2]+"), ("b", "/p,q/"), ("c", "v")]
    assert q.scopes[1].pattern == "^(?:p,q)$"


@pytest.mark.parametrize("pattern", ["(a+)+", "((a*))*", "(a|b)+", "(x|y){2}", "a" * 513])
def test_dangerous_patterns(pattern):
    with pytest.raises(ParseError):
        check_pattern(pattern)


def test_safe_patterns():
    for p in ("(ab)+", "a+b*", "(a|b)", r"(a\+)+", "server-[0-9]+"):
        check_pattern(p)


def test_times_and_durations():
    assert parse_time(5) == parse_time("5") == 5
    assert parse_time("01-01-2024 00:00:00") == 1704067200 * 10**9
    assert parse_time(9999999999999999999) == MAX_TS
    for bad in ("31-02-2024 00:00:00", "x", -1, "1-1-2024 00:00:00"):
        with pytest.raises(ParseError):
            parse_time(bad)
    assert parse_interval("5m") == 300 * 10**9 and parse_interval("1.5h") == 5400 * 10**9 and parse_interval("7") == 7
    assert parse_interval("999999999d") == MAX_TS
    assert parse_duration("2w") == 14 * 86400 * 10**9
    assert parse_offset("-1h") == -3600 * 10**9
    for bad in ("5", "0s", "5y", ""):
        with pytest.raises(ParseError):
            parse_duration(bad)


def test_formula_precedence():
    assert f.parse_formula("a + b * -2") == f.Binary("+", f.Ref("a"), f.Binary("*", f.Ref("b"), f.Number(-2.0)))
    assert f.parse_formula("a - b - c").left == f.Binary("-", f.Ref("a"), f.Ref("b"))
    assert f.parse_formula("-a * b") == f.Binary("*", f.Negate(f.Ref("a")), f.Ref("b"))
    assert f.references(f.parse_formula("time_shift(z, '7d') / max(b, a)")) == ["a", "b", "z"]
    assert len(f.UNARY) + len(f.CALLS) + len(f.SPECIAL) == 66


@pytest.mark.parametrize(
    "text",
    ["", "a +", "foo(a)", "abs(a, b)", "clamp(a, 1)", "histogram_quantile(1, 2, a)", "(a", "a b", "anomalies(a, 'fast', 2)", "anomalies(a, 'basic', 5)", "forecast(a, 'linear', 2, foo='x')", "forecast(a, 'linear', 2) + 1", "time_shift(a + b, '1d')", "a $ b", "(" * 101 + "a" + ")" * 101, "a" * 10241],
)
def test_formula_errors(text):
    with pytest.raises(ParseError):
        f.parse_formula(text)


def test_series_keys():
    assert split_series_key(r"m\,x,host=a\ b,dc=eu cpu") == ("m,x", {"host": "a b", "dc": "eu"}, "cpu")
    with pytest.raises(ValueError):
        split_series_key("m,host cpu")


@given(st.text(max_size=60))
def test_parsers_only_raise_parse_errors(text):
    for parse in (parse_query, f.parse_formula, parse_interval, parse_duration, lambda t: parse_query("avg:m(f){" + t + "}")):
        try:
            parse(text)
        except ParseError:
            pass


def test_all_methods():
    assert [parse_query(f"{m.upper()}:x(y)").method for m in METHODS] == list(METHODS)
