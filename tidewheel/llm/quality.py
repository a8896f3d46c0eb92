"""Quality by positive-unlabelled learning.

Features of a whole text, counted over its bytes and words at once: shares of
byte classes, word and line statistics, repetition, and a hashed histogram of
byte pairs. A small network minimises the non-negative unbiased risk (Kiryo et
al. 2017): pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)),
with trusted positives, unlabelled web text and the class prior pi. No label 0 is
used anywhere. The prior is estimated from scores of a network that tells
positives from unlabelled text: the share of unlabelled texts above a cut, over
the share of positives above it, bounds pi, and the cut where that bound with its
sampling error is lowest gives the estimate (best bin, Garg et al. 2021).

Training takes at most POSITIVES trusted texts and UNLABELLED other texts, those
with the smallest hashes; only their features reach the driver. Held-out rows
lend neither label nor text.

Edge cases: a null or empty text has features of zero and gets the score of
that; repeated rows each get a row, and count once in training; a null doc_id is
scored and not held out; without positives or unlabelled texts every score is
0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SPACE, Words, slices
from .toxicity import HELD_OUT, sigmoid

POSITIVES, UNLABELLED = 6000, 12000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 25, 512, 0.003, 1e-4, 5
PAIRS = 256
_CLASSES = np.zeros(256, np.int64)
for _i, _c in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), range(0x80, 0x100), b" ", b"\n\r\t", b".", b",;:", b"!?", b"#*$%&|<>~^@=+", b"\"'()[]{}-_/\\"), 1):
    _CLASSES[list(_c)] = _i
N_CLASSES = 12
N_STATS = 16
DIM = N_CLASSES + N_STATS + PAIRS


def features(texts: pa.Array) -> np.ndarray:
    w = Words(texts, SPACE, lower=False)
    n = len(w)
    out = np.zeros((n, DIM), np.float32)
    size = np.diff(w.off)
    doc = np.repeat(np.arange(n), size)
    at = np.maximum(size, 1)[:, None]
    kind = _CLASSES[w.data]
    out[:, :N_CLASSES] = np.bincount(doc * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES) / at
    if len(w.data) > 1:
        pair = (w.data[:-1].astype(np.int64) * 31 + w.data[1:] * 7) % PAIRS
        both = doc[:-1] == doc[1:]
        out[:, N_CLASSES + N_STATS :] = np.sqrt(np.bincount(doc[:-1][both] * PAIRS + pair[both], minlength=n * PAIRS).reshape(n, PAIRS) / at)
    words = w.counts()
    of = np.repeat(np.arange(n), words)
    many = np.maximum(words, 1)
    length = (w.end - w.start).astype(float)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(of, x, n) / many

    order = np.lexsort((w.h, of))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (of[order][1:] != of[order][:-1]) | (w.h[order][1:] != w.h[order][:-1])
    distinct = np.bincount(of[order][fresh], minlength=n)
    same = np.zeros(len(of))
    same[1:] = (w.h[1:] == w.h[:-1]) & (of[1:] == of[:-1])
    last = kind[w.end - 1] if len(w.end) else np.zeros(0, np.int64)
    first = kind[w.start] if len(w.start) else np.zeros(0, np.int64)
    runs, where = w.runs(4)
    run_of = of[where] if len(where) else np.zeros(0, np.int64)
    order = np.lexsort((runs, run_of))
    again = np.zeros(len(order))
    again[1:] = (run_of[order][1:] == run_of[order][:-1]) & (runs[order][1:] == runs[order][:-1])
    repeated = np.bincount(run_of[order] if len(order) else run_of, again, n) / many
    lines = np.bincount(doc[w.data == 10], minlength=n) + (size > 0)
    stats = [
        np.log1p(words),
        mean(length) / 10,
        np.sqrt(np.maximum(0, mean(length**2) - mean(length) ** 2)) / 10,
        distinct / many,
        distinct / np.sqrt(many) / 10,
        mean(same),
        mean((first == 2).astype(float)),
        mean((last == 2).astype(float)),
        mean((last == 7).astype(float)),
        mean((last == 9).astype(float)),
        mean((last == 10).astype(float)),
        mean((length == 1).astype(float)),
        repeated,
        np.log1p(lines),
        words / np.maximum(lines, 1) / 50,
        mean((first == 3).astype(float)),
    ]
    out[:, N_CLASSES : N_CLASSES + N_STATS] = np.stack(stats, 1)
    return out


class Model:
    """One hidden layer over standardised features."""

    def __init__(self, prior: float):
        self.prior = prior
        self.p: dict[str, np.ndarray] | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        p = self.p
        return np.tanh((x - p["mean"]) / p["dev"] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"][0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        return np.full(len(texts), self.prior) if self.p is None else sigmoid(self.logit(features(texts)).astype(np.float64))

    def fit(self, pos: np.ndarray, unl: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> Model:
        """Non-negative unbiased risk; with a prior of 0 the plain risk of positives against unlabelled."""
        rng = np.random.default_rng(seed)
        both = np.concatenate([pos, unl])
        mean, dev = both.mean(0), both.std(0) + 1e-3
        p = self.p = {"mean": mean, "dev": dev, "w1": (rng.standard_normal((DIM, HIDDEN)) / np.sqrt(DIM)).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32), "w2": (rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32), "b2": np.zeros(1, np.float32)}
        pos, unl = ((x - mean) / dev for x in (pos, unl))
        names = ("w1", "b1", "w2", "b2")
        state = {k: (np.zeros_like(p[k]), np.zeros_like(p[k])) for k in names}
        pi, n = self.prior, 0
        weight = 2 * pi or 1.0
        half = BATCH // 2
        for _ in range(epochs * max(8, -(-len(unl) // BATCH))):
            x = np.concatenate([pos[rng.integers(0, len(pos), half)], unl[rng.integers(0, len(unl), half)]])
            h = np.tanh(x @ p["w1"] + p["b1"])
            s = sigmoid(h @ p["w2"] + p["b2"])
            # Sigmoid loss: l+(f) = 1 - s, l-(f) = s; its slope is s (1 - s).
            slope = s * (1 - s) / half
            negative = s[half:].mean() - pi * s[:half].mean()
            d = np.empty(2 * half, np.float32)
            if negative >= 0:
                d[:half] = -weight * slope[:half]
                d[half:] = slope[half:]
            else:
                # The negative part went below zero: step back along its gradient.
                d[:half] = pi * slope[:half]
                d[half:] = -slope[half:]
            dh = d[:, None] * p["w2"] * (1 - h * h)
            grads = {"w1": x.T @ dh + DECAY * p["w1"], "b1": dh.sum(0), "w2": h.T @ d + DECAY * p["w2"], "b2": d.sum(keepdims=True)}
            n += 1
            for k in names:
                m, v = state[k]
                m += 0.1 * (grads[k] - m)
                v += 0.001 * (grads[k] ** 2 - v)
                p[k] -= RATE * np.sqrt(1 - 0.999**n) / (1 - 0.9**n) * m / (np.sqrt(v) + 1e-8)
        return self


def class_prior(pos: np.ndarray, unl: np.ndarray, seed: int = SEED) -> float:
    """The share of positives in unl: half of the texts train, the others are counted."""
    p, u = Model(0.0).fit(pos[::2], unl[::2], seed, EPOCHS // 3), (pos[1::2], unl[1::2])
    if not len(u[0]) or not len(u[1]):
        return 0.5
    a, b = (np.sort(p.logit(x))[::-1] for x in u)
    n, m = len(a), len(b)
    # Shares above each positive's score.
    above_p = np.arange(1, n + 1) / n
    above_u = np.searchsorted(-b, -a, "right") / m
    slip = np.sqrt(np.log(4 / 0.1) / (2 * n)) + np.sqrt(np.log(4 / 0.1) / (2 * m))
    best = int(np.argmin((above_u + slip) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch):
            x = features(texts)
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("h"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIM).cast(pa.list_(pa.float32()))], ["label", "h", "x"])


def fit(docs: DataFrame, labels: DataFrame, m: int = 3, r: int = 1) -> Model:
    held = HELD_OUT.format(m=m, r=r)
    good = labels.where(f"quality = 1 AND doc_id IS NOT NULL AND NOT ({held})").select("doc_id").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    good = good.orderBy(*order).limit(POSITIVES).withColumn("label", F.lit(1))
    ids = docs.where(f"text IS NOT NULL AND doc_id IS NOT NULL AND NOT ({held})").select("doc_id").distinct()
    web = ids.orderBy(*order).limit(UNLABELLED).withColumn("label", F.lit(0))
    # Of texts that share an id the smallest counts, so at most POSITIVES + UNLABELLED rows remain.
    chosen = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(good.union(web)), "doc_id")
    chosen = chosen.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", F.xxhash64("doc_id").alias("h"), "text")
    rows = chosen.mapInArrow(_vectors, "label int, h long, x array<float>").toArrow()
    label = rows.column("label").to_numpy()
    # The order of rows depends on tasks, that of their ids' hashes doesn't.
    order = np.lexsort((rows.column("h").to_numpy(), label))
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, DIM)[order]
    pos, unl = x[label[order] == 1], x[label[order] == 0]
    if not len(pos) or not len(unl):
        return Model(0.5)
    return Model(class_prior(pos, unl)).fit(pos, unl)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns in a struct `row`, with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                s = shared.value.scores(texts)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(s.astype(np.float64)), pa.array((s >= 0.5).astype(np.int32))], ["row", "score", "predicted"])

    d = docs.select(F.struct("*").alias("row"), "text")
    return d.mapInArrow(run, f"row {d.schema['row'].dataType.simpleString()}, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame, m: int = 3, r: int = 1) -> DataFrame:
    s = score(docs.select("doc_id", "text"), fit(docs, labels, m, r))
    return s.select("row.doc_id", "score", "predicted").selectExpr("doc_id", f"coalesce({HELD_OUT.format(m=m, r=r)}, false) AS held_out", "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of good quality, with their columns."""
    return score(docs, fit(docs, labels)).where("predicted = 1").select("row.*")
