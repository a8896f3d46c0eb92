"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Every window of a document is looked up by hash in the broadcast table; a hit is
verified word by word against the benchmark's own text before it counts. Items
shorter than the window are one window of their own length. The table is
broadcast in blocks of at most BLOCK windows (its size is counted first), and
documents pass each block in turn, so a benchmark of any size works without a
shuffle of the corpus.

Edge cases: a null or empty text has no words; an item without words, or with a
null text, gives no window; windows of an item with a null id hit words, but it is
in no list and not counted; repeated item ids count once for a document; repeated
documents, and documents with a null id, each get a row; an empty benchmark hits
nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .text import PUNCT, Words, slices

WINDOW = 13
#: Windows in one broadcast block: 16 bytes each and the items' texts.
BLOCK = 1_000_000


class Table:
    """Windows of benchmark items by length: sorted hashes, and for each the
    item and its words as bytes joined by a null byte."""

    def __init__(self, items: pa.Table):
        ids = items.column("item_id").to_pylist()
        by: dict[int, list[tuple[int, int, bytes]]] = defaultdict(list)
        w = Words(items.column("text"), PUNCT)
        for i, item in enumerate(ids):
            a, b = int(w.first[i]), int(w.first[i + 1])
            k = min(WINDOW, b - a)
            for j in range(a, b - k + 1) if k else ():
                by[k].append((0, item, key_of(w, j, k)))
        self.lengths = {}
        for k, rows in by.items():
            rows = sorted(set(rows), key=lambda r: (r[2], r[1] is not None, str(r[1])))
            texts = sorted({r[2] for r in rows})
            spaced = Words(pa.array([t.replace(b"\x00", b" ").decode() for t in texts]), PUNCT, lower=False)
            h, at = spaced.runs(k)
            assert len(h) == len(texts), "each window has its own words"
            owners = defaultdict(list)
            for _, item, t in rows:
                owners[t] += [item] if item is not None else []
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(h >> np.uint64(44)).astype(np.int64)] = True
            self.lengths[k] = (h[order], [(texts[i], owners[texts[i]]) for i in order], seen)


def key_of(w: Words, first: int, k: int) -> bytes:
    return b"\x00".join(w.data[w.start[i] : w.end[i]].tobytes() for i in range(first, first + k))


def scan(w: Words, table: Table) -> tuple[np.ndarray, dict[int, set]]:
    """Words inside an occurring window, and the items found by text."""
    mark = np.zeros(len(w.h) + 1, np.int64)
    items: dict[int, set] = defaultdict(set)
    for k, (hashes, windows, seen) in table.lengths.items():
        h, at = w.runs(k)
        maybe = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
        h, at = h[maybe], at[maybe]
        lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        hit = np.flatnonzero(hi > lo)
        doc = np.searchsorted(w.first, at[hit], "right") - 1
        for x, d in zip(hit.tolist(), doc.tolist(), strict=True):
            p = int(at[x])
            text = key_of(w, p, k)
            for t, owners in windows[lo[x] : hi[x]]:
                if t == text:
                    mark[p] += 1
                    mark[p + k] -= 1
                    items[d].update(owners)
    return np.cumsum(mark[:-1]) > 0, items


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    # No item has more windows than characters.
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // (BLOCK * 6))
    if n <= 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs' columns in a struct `row`, with n_words, n_hit, items (distinct item ids,
    sorted as strings) and hits (begin and end of each run of hit words, in words).

    One block is broadcast at a time: between blocks what was found is kept by a
    checkpoint and the block is released."""
    sc = docs.sparkSession.sparkContext
    out = docs.select(F.struct("*").alias("row"), "text")
    kind = out.schema["row"].dataType.simpleString()
    blocks = _blocks(benchmark)
    for i, block in enumerate(blocks):
        table = sc.broadcast(Table(block.toArrow()))
        out = out.mapInArrow(_pass(table, ["row", "text"], i == 0), f"row {kind}, text string, n_words long, items array<string>, hits array<long>")
        if i + 1 < len(blocks):
            out = graph.cut(out)
            table.destroy()
    hit = F.expr("aggregate(sequence(0, int(size(hits) / 2) - 1), 0L, (s, i) -> s + hits[2 * i + 1] - hits[2 * i])")
    return out.withColumn("n_hit", F.when(F.size("hits") > 0, hit).otherwise(F.lit(0)).cast("long"))


def _pass(table, keep: list[str], first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch in batches:
            for part, texts in slices(batch):
                w = Words(texts, PUNCT)
                hit, items = scan(w, t)
                if not first:
                    for d, (old, spans) in enumerate(zip(part.column("items").to_pylist(), part.column("hits").to_pylist(), strict=True)):
                        items[d].update(old)
                        for a, b in zip(spans[::2], spans[1::2], strict=True):
                            hit[w.first[d] + a : w.first[d] + b] = True
                found = [sorted(map(str, items[d])) if d in items else [] for d in range(len(w))]
                runs = [[] for _ in found]
                for d in items:
                    a, b = w.first[d], w.first[d + 1]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
                    runs[d] = edge.tolist()
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(w.counts(), pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.int64()))],
                    [*keep, "n_words", "items", "hits"],
                )

    return run


def is_contaminated(n_words, n_hit):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without the contaminated ones; the columns of docs."""
    found = contamination(docs, benchmark)
    return found.where(~is_contaminated(F.col("n_words"), F.col("n_hit"))).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Texts of contaminated documents without their hit words (and what stands
    between two neighbouring hit words); other documents as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans, n, k in zip(*(batch.column(c).to_pylist() for c in ("text", "hits", "n_words", "n_hit")), strict=True):
                if k and 20 * k >= n:
                    w, raw = Words(pa.array([text]), PUNCT), text.encode()
                    out, at = [], 0
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        out.append(raw[at : w.start[a]])
                        at = int(w.end[b - 1])
                    text = (b"".join(out) + raw[at:]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    found = contamination(docs, benchmark)
    out = found.mapInArrow(run, f"row {found.schema['row'].dataType.simpleString()}, text string")
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
