"""Shared helpers of the corpus operators: reading tables, words, hashing on Arrow batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that jobs on long texts need: a shared folder for checkpoints, and small
    batches to Python workers (texts differ in length by four orders of magnitude)."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(part: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``part``, the work of a task on its batches, that gives freed memory back after each batch and at its end: Spark
    keeps Python workers, so what one step's tasks took would stand beside the next step's needs."""

    @functools.wraps(part)
    def run(batches: Iterator) -> Iterator:
        try:
            for out in part(batches):
                yield out
                give_back()
        finally:
            give_back()

    return run


def text_of(col: Column | str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


# ---------------------------------------------------------------- vectorised word hashing

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (wrap-around arithmetic)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept between batches."""
    have = _powers.kept
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = np.full(size, _B, dtype=np.uint64)
        base[0] = 1
        inv = np.full(size, np.uint64(pow(int(_B), -1, 1 << 64)), dtype=np.uint64)
        inv[0] = 1
        with np.errstate(over="ignore"):
            have = _powers.kept = (np.multiply.accumulate(base), np.multiply.accumulate(inv))
    return have[0][:n], have[1][:n]


_powers.kept = None


def word_hashes(data: bytes, lower: bool = True) -> np.ndarray:
    """One 64-bit hash for each word of UTF-8 ``data``, in order; A-Z count as a-z if ``lower``.

    A polynomial hash of each word comes from one running sum over the bytes, so the work is a
    fixed number of passes however the words are cut.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    if raw.size == 0:
        return np.empty(0, dtype=np.uint64)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    start, end = edge[0::2], edge[1::2]
    if start.size == 0:
        return np.empty(0, dtype=np.uint64)
    power, inverse = _powers(raw.size)
    with np.errstate(over="ignore"):
        value = (_LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)
        total = np.zeros(raw.size + 1, dtype=np.uint64)
        np.cumsum(value * power, out=total[1:])
        words = (total[end] - total[start]) * inverse[start]
        return mix64(words ^ ((end - start).astype(np.uint64) << np.uint64(56)))


def shingle_set(data: bytes, width: int, lower: bool = True) -> np.ndarray:
    """The sorted distinct hashes of all ``width``-word shingles; with fewer words the whole
    sequence is one shingle; no word gives the empty set."""
    words = word_hashes(data, lower)
    n = words.size
    if n == 0:
        return words
    with np.errstate(over="ignore"):
        k = min(width, n)
        acc = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
        for i in range(k):
            acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + words[i:n - k + 1 + i])
    return np.unique(acc)
