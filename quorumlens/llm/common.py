"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def n_words(text: Column) -> Column:
    """Number of words of a text as BIGINT, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


class WordHashes(dict):
    """64-bit hash of a word, remembered; forgets all when it holds ``most`` words, so memory is bounded."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX2
    return x ^ (x >> np.uint64(29))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` word hashes; fewer words make one window of all of them."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = mixed(hashes[:n] + np.uint64(width))
    for k in range(1, width):
        out = mixed(out * _MIX + hashes[k : k + n])
    return out


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as Python values, a small slice of a batch at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*[part.column(n).to_pylist() for n in names], strict=True)


class Batches:
    """Gathers output rows into Arrow batches of bounded rows and bytes."""

    def __init__(self, schema: pa.Schema, rows: int = 2000, size: int = 8_000_000):
        self.schema, self.rows, self.size = schema, rows, size
        self._kept: list[tuple] = []
        self._bytes = 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self._kept.append(row)
        self._bytes += size
        if len(self._kept) >= self.rows or self._bytes >= self.size:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self._kept:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self._kept), self.schema, strict=True)]
            self._kept, self._bytes = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
