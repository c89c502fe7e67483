"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a finaliser with two multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgets all before it holds more than `limit` words."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of `width` consecutive word hashes, by doubling: log2(width) passes over the array."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, span, done, length = hashes, 1, None, 0
    factor, done_factor = np.uint64(base), np.uint64(1)
    w = width
    while w:
        if w & 1:  # put the run of `span` words behind what is done
            done = power if done is None else done[: len(hashes) - length - span + 1] * factor + power[length : len(hashes) - span + 1]
            length += span
        w >>= 1
        if w:
            power = power[: len(power) - span] * factor + power[span:]
            factor = np.uint64((int(factor) * int(factor)) & 0xFFFFFFFFFFFFFFFF)
            span *= 2
    return mix64(done[:n])


def release() -> None:
    """Give memory that this worker no longer uses back to the system; workers are kept for later tasks, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into runs of rows whose texts hold about `most` bytes (one row at least), texts as bytes."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            part = batch.slice(start, stop - start)
            yield part, [b"" if t is None else t for t in texts.slice(start, stop - start).to_pylist()]
            start = stop
    release()
