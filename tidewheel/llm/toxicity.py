"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Two levels. A word is read by its bytes with a bidirectional GRU and attention
pooling, and joined with a hashed embedding of the whole word. A window of
WINDOW words is read by a second bidirectional GRU with attention pooling. All
windows of a text, STRIDE apart so that neighbours overlap, are scored; the
text's score is the largest. Everything is numpy: the word level runs once per
distinct word of a slice of texts, the window level over thousands of windows at
a time.

Training (in one task) takes at most SAMPLE labelled texts of each class, the
ones with the smallest hashes among those of at most MAX_CHARS characters; that
sample is the only bound. Labels belong to texts, so windows are found as in
multiple-instance learning: a toxic text is first represented by the window with
the most telling word or prefix, later by the one that the network, too, finds bad; clean
texts give random windows and the ones that fooled the network. A third of the
sample is never trained on; the cut between the classes is set over all of it.

Edge cases: a null or empty text, or one without words, is scored as an empty
window; repeated rows each get a row; words over PIECE bytes are read in pieces;
without labelled texts of both classes every score is 0; a null doc_id is scored
and not held out; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .text import PUNCT, slices, words_of

WINDOW, STRIDE, PIECE = 32, 16, 32
SAMPLE, MAX_CHARS = 2500, 20_000
CHAR_DIM, CHAR_HIDDEN, WORD_DIM, HIDDEN, VOCABULARY = 8, 16, 8, 12, 1 << 16
ROUNDS, STEPS, BATCH, RATE, DROP, SEED = 3, 180, 96, 0.01, 0.5, 11
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), {m}) = {r}"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gru(g: np.ndarray, active: np.ndarray, u: np.ndarray, back: bool, out: np.ndarray, cache: list | None = None) -> None:
    """Fills out (T, N, h). g: inputs to the gates (T, N, 3h). Rows are sorted by
    length, the longest first; active[t] of them reach step t."""
    h3 = u.shape[1]
    k1, k2 = h3 // 3, 2 * h3 // 3
    h = np.zeros((g.shape[1], k1), g.dtype)
    for t in range(len(g) - 1, -1, -1) if back else range(len(g)):
        k = active[t]
        old = h[:k]
        a = old @ u
        zr = g[t, :k, :k2] + a[:, :k2]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :k1], zr[:, k1:]
        n = np.tanh(g[t, :k, k2:] + r * a[:, k2:])
        new = n + z * (old - n)
        if cache is not None:
            cache.append((t, k, old.copy(), z, r, a[:, k2:], n))
        h[:k] = new
        out[t, :k] = new


def gru_back(grad: np.ndarray, u: np.ndarray, cache: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of u; grad: of what gru() put out."""
    h = u.shape[0]
    dg, du = np.zeros((*grad.shape[:2], 3 * h), grad.dtype), np.zeros_like(u)
    dh = np.zeros(grad.shape[1:], grad.dtype)
    for t, k, old, z, r, c, n in reversed(cache):
        d = dh[:k] + grad[t, :k]
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (old - n) * z * (1 - z)
        dr = dn * c * r * (1 - r)
        da = np.concatenate([dz, dr, dn * r], 1)
        dg[t, :k] = np.concatenate([dz, dr, dn], 1)
        du += old.T @ da
        dh[:k] = d * z + da @ u.T
    return dg, du


def reach(lengths: np.ndarray) -> np.ndarray:
    """How many of the (descending) lengths exceed t, for each step t."""
    return np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")


def scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows with equal at, as (n, columns)."""
    order = np.argsort(at, kind="stable")
    keys = at[order]
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[keys[cuts]] = np.add.reduceat(rows[order], cuts, axis=0)
    return out


class Level:
    """Bidirectional GRU with attention pooling over inputs x (T, N, d)."""

    def __init__(self, p: dict, name: str):
        self.p, self.name = p, name

    def run(self, gates: tuple[np.ndarray, np.ndarray], lengths: np.ndarray, keep: bool = False) -> np.ndarray:
        p, s = self.p, self.name
        active = reach(lengths)
        gf, gb = gates
        h = p[s + "uf"].shape[0]
        states = np.zeros((*gf.shape[:2], 2 * h), np.float32)
        self.cf, self.cb = ([], []) if keep else (None, None)
        gru(gf, active, p[s + "uf"], False, states[:, :, :h], self.cf)
        gru(gb, active, p[s + "ub"], True, states[:, :, h:], self.cb)
        live = np.arange(gf.shape[0])[:, None] < lengths[None, :]
        w = np.where(live, np.exp(np.clip(states @ p[s + "v"], -20, 20)), 0).astype(np.float32)
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", w, states, optimize=True)
        if keep:
            self.states, self.w, self.pooled = states, w, pooled
        return pooled

    def back(self, dp: np.ndarray, grads: dict) -> tuple[np.ndarray, np.ndarray]:
        p, s, w, states = self.p, self.name, self.w, self.states
        h = p[s + "uf"].shape[0]
        score = np.einsum("nh,tnh->tn", dp, states, optimize=True) - (dp * self.pooled).sum(1)
        da = w * score
        grads[s + "v"] = np.einsum("tn,tnh->h", da, states, optimize=True)
        ds = w[:, :, None] * dp[None] + da[:, :, None] * p[s + "v"]
        df, grads[s + "uf"] = gru_back(ds[:, :, :h], p[s + "uf"], self.cf)
        db, grads[s + "ub"] = gru_back(ds[:, :, h:], p[s + "ub"], self.cb)
        return df, db


class Vocabulary:
    """Distinct words of a slice: bytes, lengths (longest first) and embedding rows."""

    def __init__(self, texts: pa.Array):
        w = words_of(texts, PUNCT)
        length = w.end - w.start
        if len(length) and length.max() > PIECE:
            parts = -(-length // PIECE)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start = np.repeat(w.start, parts) + nth * PIECE
            end = np.minimum(start + PIECE, np.repeat(w.end, parts))
            h = np.repeat(w.h, parts) + nth.astype(np.uint64)
            first = np.concatenate([[0], np.cumsum(parts)])[w.first]
        else:
            start, end, h, first = w.start, w.end, w.h, w.first
        self.first = first
        u, at, word = np.unique(h, return_index=True, return_inverse=True)
        size = (end - start)[at]
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(u), np.int64)
        place[order] = np.arange(len(u))
        self.words = place[word].astype(np.int32)
        self.size = size[order]
        self.hash = u[order]
        self.row = (self.hash >> np.uint64(48)).astype(np.int64)
        t = np.arange(int(self.size[0]) if len(u) else 0)
        inside = t[:, None] < self.size[None, :]
        where = np.where(inside, start[at][order].astype(np.int32)[None, :] + t[:, None].astype(np.int32), np.int32(0))
        self.bytes = w.data[where] if len(u) else np.zeros((0, 0), np.uint8)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and length of every window; each text has one at least."""
        n = np.diff(self.first)
        many = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        text = np.repeat(np.arange(len(n)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        start = self.first[text] + nth * STRIDE
        return text, start, np.minimum(WINDOW, self.first[text + 1] - start)


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)

        def random(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"chars": random(256, CHAR_DIM) * 4, "words": np.zeros((VOCABULARY, WORD_DIM), np.float32), "out": random(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for s, d, h in (("c", CHAR_DIM, CHAR_HIDDEN), ("w", 2 * CHAR_HIDDEN + WORD_DIM, HIDDEN)):
            for x in "fb":
                self.p |= {f"{s}w{x}": random(d, 3 * h), f"{s}b{x}": np.zeros(3 * h, np.float32), f"{s}u{x}": random(h, 3 * h)}
            self.p[s + "v"] = random(2 * h)
        self.shift = 0.0

    def word_vectors(self, v: Vocabulary, rows: np.ndarray | None = None, keep: bool = False, drop: np.ndarray | None = None) -> np.ndarray:
        """Of the distinct words (rows: of those only, ascending; drop: factors of their embeddings)."""
        p, level = self.p, Level(self.p, "c")
        rows = np.arange(len(v.size)) if rows is None else rows
        out = np.zeros((len(rows), 2 * CHAR_HIDDEN + WORD_DIM), np.float32)
        tables = [p["chars"] @ p["cw" + x] + p["cb" + x] for x in "fb"]
        for a in range(0, len(rows), 8192):
            r = rows[a : a + 8192]
            size = v.size[r]
            b = v.bytes[: size[0], r]
            out[a : a + 8192, : 2 * CHAR_HIDDEN] = level.run((tables[0][b], tables[1][b]), size, keep)
            if keep:
                self.char_level, self.char_bytes = level, b
        out[:, 2 * CHAR_HIDDEN :] = p["words"][v.row[rows]] * (1 if drop is None else drop[:, None])
        return out

    def logits(self, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, start, length and logit of every window."""
        p = self.p
        text, start, length = v.windows()
        x = self.word_vectors(v)
        tables = [np.vstack([x @ p["ww" + d] + p["wb" + d], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"]
        out = np.full(len(text), p["bias"][0], np.float32)
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        for a in range(0, len(order), 4096):
            r = order[a : a + 4096]
            at = start[r][None, :] + np.arange(length[r[0]])[:, None]
            at = v.words[np.minimum(at, len(v.words) - 1)]
            out[r] += Level(p, "w").run((tables[0][at], tables[1][at]), length[r]) @ p["out"]
        return text, start, length, out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The largest score of each text's windows."""
        text, _, _, logit = self.logits(Vocabulary(texts))
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, logit)
        return sigmoid(best - self.shift)

    def step(self, v: Vocabulary, words: np.ndarray, length: np.ndarray, label: np.ndarray, state: dict, rng: np.random.Generator) -> float:
        """One step of Adam over a batch of windows; words: of each, in a row."""
        p, grads = self.p, {}
        order = np.argsort(-length, kind="stable")
        length, label = length[order], label[order]
        words = words[order].T[: length[0]]
        rows, at = np.unique(words, return_inverse=True)
        at = at.reshape(words.shape)
        # Without its embedding now and then, a word must be judged by its bytes.
        drop = np.where(rng.random(len(rows)) < DROP, 0, 1 / (1 - DROP)).astype(np.float32)
        x = self.word_vectors(v, rows, True, drop)
        tables = [x @ p["ww" + d] + p["wb" + d] for d in "fb"]
        level = Level(p, "w")
        pooled = level.run((tables[0][at], tables[1][at]), length, True)
        prob = sigmoid(pooled @ p["out"] + p["bias"])
        err = ((prob - label) / len(label)).astype(np.float32)
        grads["out"], grads["bias"] = pooled.T @ err, err.sum(keepdims=True)
        live = (np.arange(length[0])[:, None] < length[None, :])[:, :, None]
        dx = np.zeros_like(x)
        for d, g in zip("fb", level.back(err[:, None] * p["out"], grads), strict=True):
            g = (g * live).reshape(-1, 3 * HIDDEN)
            dt = scatter(at.ravel(), g, len(rows))
            grads["ww" + d], grads["wb" + d] = x.T @ dt, dt.sum(0)
            dx += dt @ p["ww" + d].T
        grads["words"] = (v.row[rows], dx[:, 2 * CHAR_HIDDEN :] * drop[:, None])
        # The last block of words is the one kept; a batch's distinct words fit in one.
        dc = np.zeros_like(p["chars"])
        b = self.char_bytes
        for d, g in zip("fb", self.char_level.back(dx[:, : 2 * CHAR_HIDDEN], grads), strict=True):
            dt = scatter(b.ravel(), g.reshape(-1, 3 * CHAR_HIDDEN), 256)
            grads["cw" + d], grads["cb" + d] = p["chars"].T @ dt, dt.sum(0)
            dc += dt @ p["cw" + d].T
        grads["chars"] = dc
        self._adam(grads, state)
        return float(-np.mean(np.where(label > 0, np.log(prob + 1e-9), np.log(1 - prob + 1e-9))))

    def _adam(self, grads: dict, state: dict) -> None:
        n = state["n"] = state.get("n", 0) + 1
        rate = RATE * max(0.1, 1 - n / (ROUNDS * STEPS)) * np.sqrt(1 - 0.999**n) / (1 - 0.9**n)
        for k, g in grads.items():
            m, s = state.setdefault(k, (np.zeros_like(self.p[k]), np.zeros_like(self.p[k])))
            if isinstance(g, tuple):
                r, i = np.unique(g[0], return_inverse=True)
                gr = np.zeros((len(r), g[1].shape[1]), np.float32)
                np.add.at(gr, i, g[1])
                m[r] = 0.9 * m[r] + 0.1 * gr
                s[r] = 0.999 * s[r] + 0.001 * gr * gr
                self.p[k][r] -= rate * m[r] / (np.sqrt(s[r]) + 1e-8)
            else:
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                self.p[k] -= rate * m / (np.sqrt(s) + 1e-8)


def _telling(v: Vocabulary, label: np.ndarray) -> np.ndarray:
    """For each distinct word the largest log-odds, by texts, of itself and its
    first 4 to 6 bytes, towards label 1."""
    text = np.repeat(np.arange(len(label)), np.diff(v.first))
    best = np.zeros(len(v.size))
    for k in (0, 4, 5, 6):
        if k and len(v.bytes) < k:
            break
        key = v.hash if not k else (v.bytes[:k].astype(np.uint64) << (8 * np.arange(k, dtype=np.uint64))[:, None]).sum(0)
        ids, of = np.unique(key, return_inverse=True)
        seen = np.unique(of[v.words] * len(label) + text)
        n = [np.bincount(seen[label[seen % len(label)] == c] // len(label), minlength=len(ids)) for c in (0, 1)]
        odds = np.log((n[1] + 0.1) / (label.sum() + 1)) - np.log((n[0] + 0.1) / ((1 - label).sum() + 1))
        odds = np.where(n[1] >= 2, odds + 0.3 * np.log(np.maximum(n[1], 1)), 0)
        best = np.maximum(best, np.where(v.size >= k, odds[of], 0))
    return best


def train(texts: pa.Array, label: np.ndarray, clean_weight: float = 1.0, seed: int = SEED) -> Network | None:
    """A network, or None without texts of both classes. clean_weight: clean
    labelled texts there are for each one in the sample; it weighs in the cut."""
    if len(label) == 0 or label.min() == label.max():
        return None
    rng = np.random.default_rng(seed)
    net = Network(seed)
    v = Vocabulary(texts)
    text, start, length = v.windows()
    full = length > 0
    odds = np.concatenate([_telling(v, label), [0.0]]).astype(np.float32)
    at = (start[:, None] + np.arange(WINDOW)).astype(np.int32)
    words = v.words[np.minimum(at, max(0, len(v.words) - 1))] if len(v.words) else np.zeros(at.shape, np.int64)
    at = odds[np.where(np.arange(WINDOW) < length[:, None], words, len(odds) - 1)]
    told, where = at.max(1), at.argmax(1)
    worth = told
    # Every third text only helps to set the cut, unless texts are few.
    fit_on = (np.arange(len(label)) % 3 > 0) | (np.bincount(label, minlength=2)[label] < 300)
    full &= fit_on[text]
    clean = np.flatnonzero((label[text] == 0) & full)
    state: dict = {}

    def top(score: np.ndarray, c: int) -> np.ndarray:
        order = np.lexsort((-score, text))
        order = order[full[order]]
        head = np.r_[True, np.diff(text[order]) > 0] if len(order) else np.zeros(0, bool)
        return (w := order[head])[label[text[w]] == c]

    for i in range(ROUNDS):
        if i:
            worth = net.logits(v)[3]
        bad, hard = top(worth + told, 1), top(worth, 0)
        if not len(bad) or not len(clean):
            break
        # The clean windows that look worst are as many as those drawn at random.
        hard = hard[np.argsort(-worth[hard])][: max(BATCH, len(hard) // 4)]
        for _ in range(STEPS):
            pick = np.concatenate([rng.choice(bad, BATCH // 2), rng.choice(clean, BATCH // 4), rng.choice(hard, BATCH // 4)])
            some, sizes = words[pick], length[pick]
            # Half of the toxic windows lend their telling word, with neighbours, to clean ones.
            for j in range(BATCH // 4):
                q, n = where[pick[j]], rng.integers(1, 4)
                if told[pick[j]] > 0:
                    q = max(0, q - rng.integers(0, n))
                    lent = some[j, q : min(q + n, length[pick[j]])].copy()
                    to = rng.choice(clean)
                    put = rng.integers(0, max(1, length[to] - len(lent) + 1))
                    lent = lent[: length[to] - put]
                    if where[pick[j]] < q + len(lent):
                        some[j] = words[to]
                        some[j, put : put + len(lent)] = lent
                        sizes[j] = length[to]
            net.step(v, some, sizes, label[text[pick]].astype(np.float32), state, rng)
    best = np.full(len(label), -np.inf)
    np.maximum.at(best, text, net.logits(v)[3])
    net.shift = threshold(best, label, clean_weight)
    return net


def threshold(score: np.ndarray, label: np.ndarray, clean_weight: float = 1.0) -> float:
    """The cut between scores with the best F1 for label 1, a clean text counting clean_weight times."""
    order = np.argsort(-score)
    s, y = score[order], label[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (hit + clean_weight * np.cumsum(1 - y) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(f1.argmax())
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i] - 1)


def sample(docs: DataFrame, labels: DataFrame, target: str, m: int, r: int, bound: int = SAMPLE) -> DataFrame:
    """(h, doc_id, text, label, weight): at most bound labelled rows of each class,
    none held out; weight: how many clean labelled rows stand behind each clean one
    of these. Of texts that share an id the smallest is taken."""
    known = labels.where(f"{target} IN (0, 1) AND doc_id IS NOT NULL AND NOT ({HELD_OUT.format(m=m, r=r)})").groupBy("doc_id").agg(F.max(target).alias("label"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    some = known.where("label = 1").orderBy("h", "doc_id").limit(bound).union(known.where("label = 0").orderBy("h", "doc_id").limit(bound))
    weight = max(1.0, known.where("label = 0").count() / bound)
    rows = docs.where(f"text IS NOT NULL AND length(text) <= {MAX_CHARS}").select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return rows.groupBy("h", "doc_id", "label").agg(F.min("text").alias("text")).withColumn("weight", F.lit(weight))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    net = None
    if rows:
        t = pa.Table.from_batches(rows).combine_chunks()
        net = train(t.column("text").chunk(0), t.column("label").to_numpy().astype(np.int64), t.column("weight")[0].as_py())
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net, 5)], pa.binary())], ["net"])


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", m: int = 5, r: int = 0) -> Network | None:
    """Trains in one task on the bounded sample; only the network reaches the driver."""
    rows = sample(docs, labels, target, m, r).repartition(1).sortWithinPartitions("h", "doc_id").select("text", "label", "weight")
    found = rows.mapInArrow(_train, "net binary").toArrow().column("net")
    del rows
    graph.release(docs.sparkSession)
    return pickle.loads(found[0].as_py()) if len(found) else None


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs' columns in a struct `row`, with score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            for part, texts in slices(batch):
                s = net.scores(texts) if net else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(s.astype(np.float64)), pa.array((s >= 0.5).astype(np.int32))], ["row", "score", "predicted"])

    d = docs.select(F.struct("*").alias("row"), "text")
    return d.mapInArrow(run, f"row {d.schema['row'].dataType.simpleString()}, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame, m: int = 5, r: int = 0) -> DataFrame:
    s = score(docs.select("doc_id", "text"), fit(docs, labels, "toxic", m, r))
    return s.select("row.doc_id", "score", "predicted").selectExpr("doc_id", f"coalesce({HELD_OUT.format(m=m, r=r)}, false) AS held_out", "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not found toxic, with their columns."""
    return score(docs, fit(docs, labels)).where("predicted = 0").select("row.*")
