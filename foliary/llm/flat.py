"""Vectorized byte, word and line work over Arrow string columns, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once. A longer document is a block of its own.
BLOCK = 1 << 20

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, for two independent polynomial hashes.
TABLES = _rng.integers(1, 2**64, size=(2, 256), dtype=np.uint64) | np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets in them) of runs of rows. Null counts as empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, data = texts.buffers()
    offs = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, len(texts))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        m = max(n, BLOCK + 1)
        base = np.uint64(BASES[which])
        inverse = np.uint64(pow(BASES[which], -1, 2**64))
        out = []
        for b in (base, inverse):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = _powers[which] = (out[0], out[1])
        if m > 64 * BLOCK:  # not kept for a giant document
            del _powers[which]
    return have


class Rolling:
    """Hashes of any ranges of a sequence, each in constant time: of bytes, or of units that are 64-bit values."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        up, self.down = powers(len(data) + 1, which)
        values = TABLES[which][data] if data.dtype == np.uint8 else mix(data + TABLES[which][0])
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of True that stays within a document."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and document of every word."""
    starts, ends, docs = runs(~SPACE[data], offs)
    h = mix(Rolling(data)(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h, starts, ends, docs


def shingles(words: np.ndarray, docs: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first word of each run of k words. 1 to k-1 words in all make one shingle; none make none."""
    m = len(words)
    first = np.searchsorted(docs, np.arange(n_docs), side="left")
    count = np.searchsorted(docs, np.arange(n_docs), side="right") - first
    at = np.flatnonzero(docs[: max(0, m - k + 1)] == docs[k - 1 :]) if m >= k else np.zeros(0, np.int64)
    h = words[at].copy()
    for i in range(1, k):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[at + i])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        g = words[first[short]].copy()
        for i in range(1, k - 1):
            more = count[short] > i
            g[more] = mix(g[more] * np.uint64(0x2545F4914F6CDD1D) + words[first[short][more] + i])
        g = mix(g + count[short].astype(np.uint64))
        h, at = np.concatenate([h, g]), np.concatenate([at, first[short]])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, docs[at] if len(at) else np.zeros(0, np.int64), at


def copies(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each element, how many equal ones of its document come before it."""
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    at = np.arange(len(d))
    rank = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty(len(d), np.int64)
    out[order] = rank
    return out
