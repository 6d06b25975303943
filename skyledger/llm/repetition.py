"""Quality rules on repetition inside a text, from a suffix array over its words (operator 6).

The suffix array comes from prefix doubling; the ranks of each doubling also give the longest
common prefix of neighbouring suffixes.  Its longest-common-prefix intervals are the repeated
substrings that can't be extended to the right; those whose occurrences don't all follow the same
word are the maximal repeats.  A position is in the span of the innermost interval that holds its
suffix, so the union of all repeats' spans is the union of one span a position: the covered part.

A text is rejected if the covered part (by its characters) or the longest repeat is above its limit.

Defined results: null and empty texts have no words and fail the base rule of 20 words.  Every
measure depends on one text alone; rows and other columns stay as they are.  Work and memory are
n log n for a text of n words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_PATTERN, word_hashes

#: The shortest repeat that counts, in words.
MIN_REPEAT_WORDS = 8
#: Base rules: least words, and the part of words in repeated windows (per cent).
BASE_WORDS, BASE_REPEAT_PERCENT = 20, 30
#: The method's limits: covered part (per cent of the words' code points), and longest repeat (words).
COVERED_PERCENT, LONGEST_REPEAT_WORDS = 30, 30

_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_A_WORD = re.compile(r"[^\x20\x09-\x0D]")
_WORD = re.compile(WORD_PATTERN)


def suffix_ranks(tokens: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ... the rank of each position's next 2**k tokens (beyond the end: less than any
    token), until all ranks differ; a last entry of -1 stands for the empty suffix."""
    n = tokens.size
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    levels, width = [np.append(rank, -1).astype(np.int32)], 1
    while int(rank.max()) < n - 1:
        after = np.full(n, -1, dtype=np.int64)
        after[:n - width] = rank[width:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        levels.append(np.append(rank, -1).astype(np.int32))
        width *= 2
    return levels


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' starts in order, and the common prefix of each with the next one."""
    n = tokens.size
    if n < 2:
        return np.arange(n), np.zeros(0, dtype=np.int64)
    levels = suffix_ranks(tokens)
    order = np.argsort(levels[-1][:n])
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 2, -1, -1):         # the common prefix is below 2**last
        step = (levels[k][a] == levels[k][b]).astype(np.int64) << k
        common += step
        a += step
        b += step
    return order, common


def prefix_intervals(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """The intervals (length, first, last) of the suffix array whose suffixes share ``length`` tokens, at least ``least``,
    and no more; inner ones before those that hold them."""
    places = np.flatnonzero(common >= least)
    for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
        open_ = []
        for i, length in zip(run.tolist(), common[run].tolist()):
            first = i
            while open_ and open_[-1][0] > length:
                top, first = open_.pop()
                yield top, first, i
            if not open_ or open_[-1][0] < length:
                open_.append((length, first))
        while open_:
            top, first = open_.pop()
            yield top, first, int(run[-1]) + 1


def maximal_repeats(tokens: np.ndarray, least: int = MIN_REPEAT_WORDS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Starts and lengths of the innermost repeat at each place that has one of ``least`` tokens or more, and the lengths
    of the maximal repeats, one entry a repeated substring."""
    order, common = suffix_array(tokens)
    best = np.zeros(tokens.size + 1, dtype=np.int64)
    best[order[:-1]] = common                        # a suffix's innermost interval is that of its nearer neighbour
    best[order[1:]] = np.maximum(best[order[1:]], common)
    start = np.flatnonzero(best >= least)
    if not start.size:
        return start, best[start], []
    before = np.where(order > 0, tokens[order - 1], 0)
    changes = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (order[1:] == 0) | (order[:-1] == 0))])
    lengths = [length for length, first, last in prefix_intervals(common, least) if changes[last] > changes[first]]
    return start, best[start], lengths


def covered(start: np.ndarray, length: np.ndarray, at: np.ndarray | None = None) -> int:
    """How many positions the union of spans holds (starts rising); with ``at``, what they weigh: ``at[i]`` is the
    weight of all positions before i."""
    if start.size == 0:
        return 0
    end = start + length
    before = np.concatenate([[0], np.maximum.accumulate(end)[:-1]])
    from_ = np.minimum(np.maximum(start, before), end)
    return int((end - from_).sum() if at is None else (at[end] - at[from_]).sum())


def measure(text: str | None, least: int = MIN_REPEAT_WORDS) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest repeat, maximal repeats, covered characters."""
    text = text or ""
    tokens = word_hashes(text.encode("utf-8"), lower=False)
    start, length, repeats = maximal_repeats(tokens, least)
    chars = 0
    if start.size:
        chars = covered(start, length, np.concatenate([[0], np.cumsum([len(w) for w in _WORD.findall(text)])]))
    lines = [x for x in text.split("\n") if _A_WORD.search(x)]
    return (tokens.size, len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)),
            covered(start, length), max(repeats, default=0), len(repeats), chars)


_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "n_repeats", "covered_chars"]


@F.pandas_udf(T.StructType([T.StructField(f, T.LongType()) for f in _FIELDS]))
def _measures(batch: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in batch], columns=_FIELDS)


def judge(df: DataFrame, covered_percent: int = COVERED_PERCENT, longest_words: int = LONGEST_REPEAT_WORDS,
          text: str = "text") -> DataFrame:
    """``df`` with the measures, base_failed and kept."""
    df = df.drop(*(c for c in [*_FIELDS, "base_failed", "kept"] if c in df.columns))
    rows = df.withColumn("__m", _measures(F.col(text)))
    for f in _FIELDS:
        rows = rows.withColumn(f, F.col(f"__m.{f}"))
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    good = (100 * F.col("covered_chars") <= covered_percent * F.col("word_chars")) & (F.col("longest_repeat") <= longest_words)
    return rows.drop("__m").withColumn("base_failed", failed).withColumn("kept", ~failed & good)
