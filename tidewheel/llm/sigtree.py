"""N-gram Jaccard join by signature trees.

Method. A document's set holds its distinct word shingles. Documents with equal
sets are one class from the start. A node of a signature tree holds the OR of its
documents' token bitmaps, their size range and the largest number of tokens that
share a bit; a dual traversal drops a pair of nodes when their size ranges can't
meet the threshold, when even the largest possible overlap is too small, or when
both already lie in one component.

Trees are built where links can be: any two linked sets share one of their first
n - ceil(t n) + 1 tokens in a common order (the prefix principle), so a tree
stands over the documents of each prefix token. The order puts tokens that many
documents hold last. These trees give a spanning forest of candidate links,
whose components contain all true ones; inside each component a second tree over
the exact sets decides. Both steps keep forests, never all pairs.

Skew: copies collapse before any shuffle of keys; frequent tokens come last in
the order; a token or candidate component above a size goes to several tasks as
pairs of blocks (graph.block_pairs), without dropping a pair.

Edge cases: a null or empty text, or one without words, has an empty set and
links with nothing; fewer than `words` words make one shingle of the whole
sequence; a null id keeps its n_shingles, has a null component and links with
nothing; rows that repeat an id count as one document with several texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .text import SPACE, Words, slices

#: A token is frequent if more than this share of the documents of some task hold it.
FREQUENT = 1e-3
#: Documents of one token, and bytes of exact sets of one component, in a block.
TOKEN_BLOCK, SET_BLOCK = 4096, 48 << 20
LEAF = 16
_EMPTY = np.zeros(0, np.uint64)


def frequent_tokens(docs: DataFrame, words: int) -> np.ndarray:
    """Tokens that more than FREQUENT of the documents hold, counted over all
    documents in the lowest quarter of hash values (prefixes hardly reach
    further). At most 4 * mean set size / FREQUENT values, whatever the number
    of documents. The order built on them is valid for any outcome."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows, held = _EMPTY, 0, []
        n = np.zeros(0, np.int64)
        total = 0

        def fold() -> None:
            nonlocal seen, n, held
            low = np.concatenate([seen, *held])
            each = np.concatenate([n, np.ones(len(low) - len(seen), np.int64)])
            u, at = np.unique(low, return_inverse=True)
            seen, n, held = u, np.bincount(at, each, len(u)).astype(np.int64), []
            if len(seen) > 2_000_000:  # lossy counting: what is rare so far isn't frequent
                keep = n > max(1, FREQUENT / 4 * total)
                seen, n = seen[keep], n[keep]

        for batch in batches:
            for _, texts in slices(batch):
                total += len(texts)
                for s in Words(texts, SPACE).shingle_sets(words):
                    low = s[: np.searchsorted(s, np.uint64(1 << 62))]
                    held.append(low)
                    rows += len(low)
                if rows > 500_000:
                    fold()
                    rows = 0
        fold()
        keep = n >= max(8, FREQUENT / 2 * total)
        yield pa.RecordBatch.from_arrays([pa.array(seen[keep].view(np.int64)), pa.array(n[keep]), pa.array(np.full(keep.sum(), total))], ["token", "n", "total"])

    found = docs.select("text").mapInArrow(count, "token long, n long, total long")
    total = docs.count()
    hot = found.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > max(8, FREQUENT * total)).select("token").toArrow()
    return np.sort(hot.column("token").to_numpy().view(np.uint64))


def bitmap(tokens: np.ndarray, per_token: int) -> bytes:
    """One bit of 2**k >= per_token * n for each token."""
    width = max(64, 1 << int(per_token * max(1, len(tokens)) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of a bitmap brought to a smaller width: bits that agree modulo width meet."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


class Node:
    __slots__ = ("lo", "hi", "slack", "bits", "rows", "kids")

    def __init__(self, rows: np.ndarray, kids: list, lo: int, hi: int, slack: int, bits: np.ndarray):
        self.rows, self.kids, self.lo, self.hi, self.slack, self.bits = rows, kids, lo, hi, slack, bits


class SignatureTree:
    """A tree over sets given by sizes and bitmaps (uint64 words, a power of two many)."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[np.ndarray], percent: int):
        self.sizes, self.percent = sizes, percent
        self.bits = bitmaps
        self.slack = np.array([n - int(np.bitwise_count(b).sum()) for n, b in zip(sizes.tolist(), bitmaps, strict=True)], np.int64)
        widths = np.array([len(b) for b in bitmaps])
        first = np.array([b[0] for b in bitmaps], np.uint64)
        order = np.lexsort((first, sizes, widths))
        level = []
        for at in np.split(order, np.flatnonzero(np.diff(widths[order])) + 1):
            for i in range(0, len(at), LEAF):
                r = at[i : i + LEAF]
                stack = np.stack([bitmaps[x] for x in r])
                level.append(Node(r, [], int(sizes[r].min()), int(sizes[r].max()), int(self.slack[r].max()), np.bitwise_or.reduce(stack)))
                level[-1].kids = stack  # a leaf keeps its rows' bitmaps
        while len(level) > 1:
            level = [self._over(level[i : i + 4]) for i in range(0, len(level), 4)]
        self.top = level[0] if level else None

    @staticmethod
    def _over(kids: list[Node]) -> Node:
        if len(kids) == 1:
            return kids[0]
        width = min(len(k.bits) for k in kids)
        # Slack was measured at a kid's own width; folded further, only its size bounds.
        slack = max(k.slack if len(k.bits) == width else k.hi for k in kids)
        return Node(np.concatenate([k.rows for k in kids]), kids, min(k.lo for k in kids), max(k.hi for k in kids), slack, np.bitwise_or.reduce([fold(k.bits, width) for k in kids]))

    def possible(self, x: Node, y: Node) -> bool:
        p = self.percent
        if 100 * x.hi < p * y.lo or 100 * y.hi < p * x.lo:
            return False
        width = min(len(x.bits), len(y.bits))
        common = int(np.bitwise_count(fold(x.bits, width) & fold(y.bits, width)).sum())
        # A folded bitmap may hold several tokens of one document in a bit; only an unfolded one bounds by its slack.
        most = min(common + (x.slack if len(x.bits) == width else x.hi), common + (y.slack if len(y.bits) == width else y.hi))
        return (100 + p) * most >= p * (x.lo + y.lo)

    def traverse(self, forest: graph.Forest, check=None) -> None:
        """Joins in forest what may link, or what check(i, j) confirms."""
        if self.top is None:
            return
        stack = [(self.top, self.top)]
        while stack:
            x, y = stack.pop()
            if x is not y and not self.possible(x, y):
                continue
            if len(x.rows) + len(y.rows) > 2:
                up = forest.roots()
                rx = up[x.rows]
                if (rx == rx[0]).all() and (up[y.rows] == rx[0]).all():
                    continue
            xl, yl = isinstance(x.kids, np.ndarray), isinstance(y.kids, np.ndarray)
            if xl and yl:
                self._leaves(x, y, forest, check)
            elif x is y:
                stack += [(a, b) for i, a in enumerate(x.kids) for b in x.kids[i + 1 :]] + [(a, a) for a in x.kids]
            elif yl or (not xl and len(x.rows) >= len(y.rows)):
                stack += [(a, y) for a in x.kids]
            else:
                stack += [(x, b) for b in y.kids]

    def _leaves(self, x: Node, y: Node, forest: graph.Forest, check) -> None:
        p = self.percent
        a, b = x.kids, y.kids
        width = min(a.shape[1], b.shape[1])
        a, b = fold(a, width), fold(b, width)
        sx, sy = self.sizes[x.rows], self.sizes[y.rows]
        common = np.bitwise_count(a[:, None, :] & b[None, :, :]).sum(2, dtype=np.int64)
        slack_x = sx - np.bitwise_count(a).sum(1, dtype=np.int64)
        slack_y = sy - np.bitwise_count(b).sum(1, dtype=np.int64)
        most = np.minimum(common + slack_x[:, None], common + slack_y[None, :])
        most = np.minimum(most, np.minimum(sx[:, None], sy[None, :]))
        may = (100 + p) * most >= p * (sx[:, None] + sy[None, :])
        if x is y:
            may = np.triu(may, 1)
        for i, j in np.argwhere(may):
            i, j = x.rows[i], y.rows[j]
            if forest.root(i) != forest.root(j) and (check is None or check(i, j)):
                forest.join(i, j)


def _forest_edges(ids: np.ndarray, forest: graph.Forest, all_rows: bool) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) with b the smallest id of a's tree; all_rows: members alone in theirs too."""
    up = forest.roots()
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, up, ids)
    low = low[up]
    keep = np.ones(len(ids), bool) if all_rows else low != ids
    return ids[keep], low[keep]


def _candidates(percent: int):
    def group(ids: np.ndarray, sizes: np.ndarray, bitmaps: list) -> tuple | None:
        if len(ids) == 2:
            # Most groups are pairs: one comparison, the same bound, no tree.
            n, m = int(sizes[0]), int(sizes[1])
            if 100 * n < percent * m or 100 * m < percent * n:
                return None
            a, b = (int.from_bytes(x, "little") for x in bitmaps)
            width = 8 * min(map(len, bitmaps))
            (a, wa), (b, wb) = ((x, 8 * len(y)) for x, y in zip((a, b), bitmaps, strict=True))
            while wa > width:
                wa //= 2
                a = a >> wa | a & ((1 << wa) - 1)
            while wb > width:
                wb //= 2
                b = b >> wb | b & ((1 << wb) - 1)
            both = (a & b).bit_count()
            most = min(both + n - a.bit_count(), both + m - b.bit_count(), n, m)
            if (100 + percent) * most < percent * (n + m):
                return None
            return ([max(ids)], [min(ids)]) if ids[0] != ids[1] else None
        forest = graph.Forest(len(ids))
        SignatureTree(sizes, [np.frombuffer(b, np.uint64) for b in bitmaps], percent).traverse(forest)
        return _forest_edges(ids, forest, False)

    return group


def _exact(percent: int, kind: type = np.uint64):
    def group(ids: np.ndarray, tokens: list) -> tuple:
        forest = graph.Forest(len(ids))
        if len(ids) <= 8:
            # A tree over so few sets is one leaf.
            few = [frozenset(np.frombuffer(b, kind).tolist()) for b in tokens]
            for i in range(len(few)):
                for j in range(i):
                    if forest.root(i) != forest.root(j):
                        both = len(few[i] & few[j])
                        if 100 * both >= percent * (len(few[i]) + len(few[j]) - both):
                            forest.join(i, j)
            return _forest_edges(ids, forest, True)
        sets = [np.frombuffer(b, kind) for b in tokens]
        sizes = np.array([len(s) for s in sets], np.int64)

        def linked(i: int, j: int) -> bool:
            x, y = sets[i], sets[j]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            return 100 * both >= percent * (len(x) + len(y) - both)

        SignatureTree(sizes, [np.frombuffer(bitmap(s.astype(np.uint64), 8), np.uint64) for s in sets], percent).traverse(forest, linked)
        return _forest_edges(ids, forest, True)

    return group


def _features(hot, words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = hot.value
        for batch in batches:
            for part, texts in slices(batch):
                n, key, prefix, bits = [], [], [], []
                for s in Words(texts, SPACE).shingle_sets(words):
                    n.append(len(s))
                    if not len(s):
                        key.append(None)
                        prefix.append(None)
                        bits.append(None)
                        continue
                    lanes = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(s * np.uint64(0xD6E8FEB86659FD93) ^ (s >> np.uint64(32)))], np.uint64)
                    key.append(lanes.tobytes())
                    bits.append(bitmap(s, 1))
                    p = len(s) - -(-percent * len(s) // 100) + 1
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        often = frequent[at] == s
                        s = np.concatenate([s[~often], s[often]]) if often.any() else s
                    prefix.append(s[:p].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["id", "n", "key", "prefix", "bits"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                out = [s.tobytes() for s in Words(texts, SPACE).shingle_sets(words)]
                keep = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(out, pa.binary())], [*keep, "tokens"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable
    by links; two sets link when 100 * intersection >= percent * union)."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hot = spark.sparkContext.broadcast(frequent_tokens(d, words))
    feats = graph.cut(d.mapInArrow(_features(hot, words, percent), "id long, n long, key binary, prefix array<long>, bits binary"))
    # Copies collapse: one row per class of equal sets, its smallest id standing for it.
    linkable = feats.where("n > 0 AND id IS NOT NULL")
    classes = linkable.groupBy("key", "n").agg(F.min_by(F.struct("id", "prefix"), "id").alias("c")).select("key", "n", "c.*")
    rows = classes.select("id", F.explode("prefix").alias("token"))
    # A count and an equi-join, which adaptive execution splits where a token is hot.
    shared = graph.cut(rows.join(rows.groupBy("token").agg(F.count("*").alias("m")).where("m > 1"), "token").select("id", "token", "m"))
    sized = feats.where("n > 0").select("id", "n")
    bits = linkable.select("id", "n", "bits").dropDuplicates(["id", "n", "bits"])
    keyed = graph.block_pairs(shared.join(bits, "id"), "id", "m", TOKEN_BLOCK)
    cand = graph.cut(graph.by_group(keyed, ["token", "bi", "bj"], ["id", "n", "bits"], _candidates(percent), 2).distinct())
    label = graph.components(cand, "a", "b")
    member = label.join(sized.groupBy("id").agg(F.max("n").alias("n")), "id")
    member = graph.cut(member.join(member.groupBy("component").agg(F.sum(F.col("n") * 8).alias("bytes")), "component"))
    sets = _join_text(d, member.select("id", "component", "bytes")).mapInArrow(_sets(words), "id long, component long, bytes long, tokens binary")
    exact = graph.by_group(graph.block_pairs(sets, "id", "bytes", SET_BLOCK), ["component", "bi", "bj"], ["id", "tokens"], _exact(percent))
    exact = graph.cut(exact)
    if not member.where(F.col("bytes") > SET_BLOCK).isEmpty():
        found = graph.components(exact, "a", "b").select(F.col("id").alias("rep"), F.col("component").alias("low"))
    else:
        found = exact.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("low"))
    whole = classes.select("key", "n", F.col("id").alias("rep")).join(found, "rep", "left").select("key", "n", F.coalesce("low", "rep").alias("low"))
    out = feats.select("id", "n", "key").join(whole, ["key", "n"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("low", "id")).alias("component_id"),
    )


def _join_text(d: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the wanted ids with what ids carries; the short side is the hash table."""
    return d.join(ids.hint("shuffle_hash"), "id")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest doc_id of each component, with all its
    columns; documents without words, or with a null id, all stay."""
    c = jaccard_components(docs, "doc_id", "text", words, percent)
    gone = c.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti")
