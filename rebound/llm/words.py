"""Word and shingle hashing shared by the operators that compare texts.

Everything here works on one Arrow batch inside a task: texts arrive as UTF-8
bytes, words are runs of bytes other than the six ASCII blanks, and a batch is
held as one flat array of 64-bit word hashes with an offset per document, so
the per-position work is numpy and only the split itself is per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are handed on in chunks of about so many bytes, whatever the batch holds.
CHUNK_BYTES = 2 << 20
#: A worker forgets its word hashes when it has seen so many different words.
CACHE_WORDS = 1 << 17

_BASE = np.uint64(0x9FB21C651E98DF25)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    """word -> 64-bit hash; computed on first use, emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply); ``salt`` gives another function."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def utf8(column) -> list:
    """A string column of a batch as a list of UTF-8 bytes (None for null)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def chunks(texts: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``limit`` bytes of text each (one long text may exceed it)."""
    a = held = 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= limit:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def word_hashes(texts: list, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(flat word hashes, offsets): the words of text i are flat[offsets[i]:offsets[i + 1]]."""
    words: list = []
    offsets = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            words += (t.lower() if lower else t).split()
        offsets[i + 1] = len(words)
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)), offsets


def shingles(flat: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words, document after document, with offsets.

    A document with fewer words, but at least one, has its whole sequence as
    its one shingle; a document without words has none.
    """
    count = np.diff(offsets)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    start = np.arange(out[-1], dtype=np.int64) - np.repeat(out[:-1] - offsets[:-1], n)
    runs = np.zeros(max(0, len(flat) - size + 1), np.uint64)  # of every place, across documents too
    for j in range(size):
        runs = runs * _BASE + flat[j:j + len(runs)]
    acc = np.zeros(len(start), np.uint64)
    full = np.repeat(count >= size, n)
    acc[full] = runs[start[full]]
    for k in np.flatnonzero((count > 0) & (count < size)):
        v = 0
        for h in flat[offsets[k]:offsets[k + 1]].tolist():
            v = v * int(_BASE) + h
        acc[out[k]] = np.uint64((v + (int(count[k]) << 56) + 1) & (2**64 - 1))
    return mix(acc, size), out
