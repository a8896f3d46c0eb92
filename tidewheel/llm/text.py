"""Vectorised word splitting and hashing over Arrow string arrays.

One pass of numpy over the raw UTF-8 bytes of a slice of texts yields every
word's 64-bit hash and position, with no Python object per word. Separators are
ASCII, so multi-byte characters are never cut. Slices hold about SLICE_BYTES of
text (or one longer text), which bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: Words `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z.
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER_TABLE = {c: c + 32 for c in range(0x41, 0x5B)}

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).view(np.uint64) | np.uint64(1)
_LANE = _rng.integers(1, 2**63, 64, dtype=np.int64).view(np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        x[0] = 1
        have = np.cumprod(x, dtype=np.uint64)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """Words of a slice of texts. h: hash of each word; first[i]:first[i + 1] are
    the words of text i; start and end: byte positions in data."""

    def __init__(self, texts: pa.Array, separators: np.ndarray, lower: bool = True):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type)
        off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
        off = off[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(off) else np.zeros(0, np.uint8)
        off = off - off[0]
        self.data = data = LOWER[data] if lower else data
        self.off = off
        n = len(data)
        sep = separators[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = sep[:-1], sep[1:]
        edges = off[(off > 0) & (off < n)]
        before[edges], after[edges - 1] = True, True
        self.start = np.flatnonzero(~sep & before)
        self.end = np.flatnonzero(~sep & after) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_BASE, n), out=total[1:])
        h = (total[self.end] - total[self.start]) * powers(_INV, n + 1)[self.start]
        self.h = mix(h + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.off) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every k consecutive words of one text, and the first word's index."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h += self.h[j : j + n] * _LANE[j]
        left = np.repeat(self.first[1:], self.counts())[:n] - np.arange(n)
        at = np.flatnonzero(left >= k)
        return mix(h[at] + np.uint64(k)), at

    def shingle_sets(self, k: int) -> Iterator[np.ndarray]:
        """Sorted distinct k-word shingles of each text; of fewer words, the
        whole sequence as one; without words, none."""
        h, at = self.runs(k)
        cut = np.searchsorted(at, self.first)
        for i in range(len(self)):
            a, b = self.first[i], self.first[i + 1]
            if b - a >= k:
                yield np.unique(h[cut[i] : cut[i + 1]])
            elif b > a:
                whole = (self.h[a:b] * _LANE[: b - a]).sum(dtype=np.uint64)
                yield mix(np.array([whole + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def words_of(texts: pa.Array, separators: np.ndarray) -> Words:
    """Words of many texts, split slice by slice to keep memory low."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = [Words(t, separators) for _, t in slices(batch)]
    all_ = Words(pa.array([], pa.string()), separators)
    bytes_, words = 0, 0
    firsts, starts, ends = [np.zeros(1, np.int64)], [], []
    for p in parts:
        kind = np.int32 if bytes_ + len(p.data) < 2**31 else np.int64
        starts.append((p.start + bytes_).astype(kind))
        ends.append((p.end + bytes_).astype(kind))
        firsts.append(p.first[1:] + words)
        bytes_ += len(p.data)
        words += len(p.h)
    if parts:
        all_.data = np.concatenate([p.data for p in parts])
        all_.start, all_.end, all_.first = np.concatenate(starts), np.concatenate(ends), np.concatenate(firsts)
        all_.h = np.concatenate([p.h for p in parts])
        all_.off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.off) for p in parts]))])
    return all_


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in parts of about SLICE_BYTES of text, each with its texts."""
    texts = batch.column(column)
    if not len(texts):
        return
    size = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0.0
        to = max(at + 1, int(np.searchsorted(size, base + SLICE_BYTES, "right")))
        part = batch.slice(at, to - at)
        yield part, part.column(column)
        at = to


def hash_text(words: list[str]) -> np.ndarray:
    """Hashes as Words gives them for these words."""
    return Words(pa.array(["\x20".join(words)]), SPACE, lower=False).h
