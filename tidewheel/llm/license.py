"""License scans: Aho-Corasick over phrases and tags, shunting-yard over expressions.

A text's words (A-Z lowered) are joined by single spaces; one pass of an
Aho-Corasick automaton over that string finds every place where a phrase's words
stand consecutively, overlapping places included. Where an identifier tag is
found, the expression behind it in the raw text is parsed by a shunting-yard
parser (WITH binds tightest, then AND, then OR) and evaluated: its labels are
collected, and it is permissive if some choice among its ORs is.

Score: 1 - product over distinct evidence of (1 - weight): 0.9 for a parsed tag,
0.8 for a base phrase, 0.6 for another notice, 0 without any.

Edge cases: a null text is empty: no words, places or labels, null word numbers;
an expression that does not parse adds no label; repeated rows each get a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER_TABLE, slices

#: Phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices; they add labels only.
NOTICES = {
    "all rights reserved": "proprietary",
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl",
    "unlicense": "unlicense",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
}
TAGS = ("spdx license identifier", "license expression")
PERMISSIVE = frozenset("mit apache bsd isc bsl unlicense cc0 cc-by public-domain zlib python".split())
FAMILIES = ("agpl", "lgpl", "gpl", "apache", "mit", "bsd", "mpl", "epl", "isc", "bsl", "unlicense", "cc0", "zlib", "python")

WORDS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TAG = re.compile(r"(?:spdx-license-identifier|license-expression)\s*[:=]\s*([^\n\r]*)", re.I)
PIECE = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
BINDS = {"or": 1, "and": 2, "with": 3}


def family(name: str) -> str:
    """The label of an identifier: its licence without version."""
    low = name.lower().rstrip("+")
    if low.startswith("cc-"):
        return re.sub(r"-\d.*$", "", low)
    return next((f for f in FAMILIES if low == f or low.startswith(f + "-")), low)


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the longest leading expression in postfix order, or None."""
    out: list[str] = []
    held: list[str] = []
    want = True  # an identifier or an opening parenthesis
    at = 0
    while m := PIECE.match(expression, at):
        t = m[1]
        op = t.lower() if t.lower() in BINDS else ""
        if want and (op or t == ")"):
            return None
        if not want and not op and t != ")":
            break
        at = m.end()
        if t == "(":
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        elif op:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[op]:
                out.append(held.pop())
            held.append(op)
            want = True
        else:
            out.append(t.rstrip(".:"))
            want = False
    if want or "(" in held:
        return None
    return out + held[::-1]


def evaluate(rpn: list[str]) -> tuple[frozenset, bool]:
    """Labels of the expression, and whether it can be met by permissive ones."""
    stack: list[tuple[frozenset, bool]] = []
    for t in rpn:
        if t == "with":
            stack.pop()  # an exception adds a permission, no licence
        elif t in BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append((a[0] | b[0], a[1] and b[1] if t == "and" else a[1] or b[1]))
        else:
            stack.append((frozenset([family(t)]), family(t) in PERMISSIVE))
    return stack[-1]


@cache
def automaton():
    import ahocorasick

    found: dict[str, list] = {}
    for phrases, kind in ((BASE, "base"), (NOTICES, "notice"), (dict.fromkeys(TAGS, ""), "tag")):
        for phrase, label in phrases.items():
            found.setdefault(f" {phrase} ", []).append((kind, label))
    a = ahocorasick.Automaton()
    for phrase, what in found.items():
        a.add_word(phrase, (len(phrase), what))
    a.make_automaton()
    return a


def scan(text: str | None) -> tuple:
    """The values of COLUMNS, in time that grows with the text's length."""
    line = f" {WORDS.sub(' ', (text or '').translate(LOWER_TABLE)).strip(' ')} "
    n_words = line.count(" ") - 1 if len(line) > 2 else 0
    places: list[int] = []
    base: set[str] = set()
    more: set[str] = set()
    doubt, tagged, permissive = 1.0, False, None
    at = before = 0  # `before` spaces stand before line[at]
    for end, (size, what) in automaton().iter(line):
        for kind, label in what:
            if kind == "base":
                start = end - size + 1
                before += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
                at = start
                places.append(before)
                doubt *= 1 if label in base else 0.2
                base.add(label)
            elif kind == "notice":
                doubt *= 1 if label in more else 0.4
                more.add(label)
            else:
                tagged = True
    if tagged:
        for m in TAG.finditer(text):
            rpn = postfix(m[1])
            if rpn:
                labels, free = evaluate(rpn)
                more |= labels
                permissive = free if permissive is None else permissive and free
                doubt *= 0.1
    return n_words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1 - doubt, permissive


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"
TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]


def licenses(docs: DataFrame) -> DataFrame:
    """docs' columns in a struct `row`, with what scan() finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            for part, texts in slices(batch):
                found = zip(*map(scan, texts.to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(c, t) for c, t in zip(found, TYPES, strict=True))], ["row", *names])

    d = docs.select(F.struct("*").alias("row"), "text")
    return d.mapInArrow(run, f"row {d.schema['row'].dataType.simpleString()}, {COLUMNS}")


def digest(docs: DataFrame) -> DataFrame:
    found = licenses(docs.select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
