"""Byte-level BPE by longest matches and backtracking (operator 4).

A piece (one match of the splitting pattern) is a Latin-1 string, one character a byte.  An
Aho-Corasick automaton over the vocabulary gives the longest token that starts at a byte.
The encoder takes the longest token, and keeps it only if the token before it and it could stand
side by side after all merges; otherwise it tries that token's shorter prefixes, and when none is
left it steps back one token and forbids the byte it came from.  Every byte is forbidden at most
once, so the work is linear.  A sequence whose neighbours are all compatible is the one that the
merges give.

Two tokens are compatible if no merge would have joined bytes across their border before the last
merge inside either of them: the inner merges are undone from the highest rank down, and each pair
of tokens then facing each other across the border is looked up.  Memoised by pair is the answer that
the encoder needs: which of a token and its shorter prefixes is the first that may follow another.

Defined results: null and empty texts give no ids (decoded: empty).  Rows, repeats and other
columns stay as they are.  Unpaired surrogates can't occur in Spark strings.  Texts are encoded
whole; memory is a few times one Arrow batch (its size is a Spark setting).

Both steps are plain pandas functions, which Spark runs one after the other in one Python worker if
``decode`` alone reads the ids (it counts them and hands them on, so that nothing else needs to).
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back

#: Entries kept in a worker: each of the two generations of its table of pieces; the memo of pairs, emptied beyond it.
MEMO_ENTRIES, PAIR_ENTRIES = 100_000, 500_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The lines of a rank file: the token in base64, a space, the rank."""
    return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in data.splitlines() if line)}


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split_text = regex.compile(pattern).findall
        self.split_plain = _plain_pattern(pattern)
        self.token = {r: t for t, r in ranks.items()}
        self.length = {r: len(t) for r, t in self.token.items()}
        # how each token is made: its last merge; single bytes are made of themselves
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for tok, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(tok) == 1:
                self.halves[rank] = (rank, rank)
            else:
                parts = self._merge_below(tok, rank)
                if len(parts) != 2:       # no sequence of merges ever makes it
                    continue
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
            self.automaton.add_word(tok.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.most = max(self.length.values(), default=1)
        self.longest = _Longest(self)
        self.shorter: dict[int, int] = {}
        for rank in self.halves:
            tok, self.shorter[rank] = self.token[rank], -1
            for k in range(len(tok) - 1, 0, -1):
                if (r := ranks.get(tok[:k])) is not None and r in self.halves:
                    self.shorter[rank] = r
                    break
        self.memo: dict[int, dict[int, int]] = {r: {} for r in self.halves}
        self.pairs = 0
        self.pieces = _Pieces(self)

    def _merge_below(self, data: bytes, limit: int) -> list[bytes]:
        """The parts of ``data`` after all merges of a rank below ``limit``, lowest first."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = limit, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], limit)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fitting(self, left: int, tok: int) -> int:
        """The first of ``tok`` and its shorter prefixes that survives all merges beside ``left``; -1 if none does."""
        beside, seen, found = self.memo[left], [], -1
        while tok >= 0:
            if (known := beside.get(tok)) is not None:
                found = known
                break
            seen.append(tok)
            if self._border_holds(left, tok):
                found = tok
                break
            tok = self.shorter[tok]
        if self.pairs + len(seen) > PAIR_ENTRIES:
            self.forget_pairs()
        self.pairs += len(seen)
        for tok in seen:
            beside[tok] = found
        return found

    def forget_pairs(self) -> None:
        self.pairs = 0
        for beside in self.memo.values():
            beside.clear()

    def _border_holds(self, left: int, right: int) -> bool:
        # (rank, side) orders merges in time; of one rank, those further left come first
        bound = (len(self.ranks) + 1, 0)
        while True:
            across = self.ranks.get(self.token[left] + self.token[right])
            if across is not None and (across, 1) < bound:
                return False
            undo_left = (left, 0) if self.length[left] > 1 else (-1, 0)
            undo_right = (right, 2) if self.length[right] > 1 else (-1, 0)
            if undo_left == undo_right:         # both are single bytes
                return True
            if undo_left > undo_right:
                bound, left = undo_left, self.halves[left][1]
            else:
                bound, right = undo_right, self.halves[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        s, n = piece.decode("latin-1"), len(piece)
        path, longest, length, shorter, memo = self.automaton.longest_prefix, self.longest, self.length, self.shorter, self.memo
        most, allowed = self.most, bytearray(b"\1") * (n + 1)
        out: list[int] = []
        pos, tok, beside = 0, -1, None
        while pos < n:
            if tok < 0:                          # the longest token from here that fits the one before
                ahead = s[pos:pos + most]
                tok = longest[ahead[:path(ahead)]]
                if beside is not None:
                    fits = beside.get(tok)
                    tok = fits if fits is not None else self.fitting(out[-1], tok)
            while tok >= 0 and not allowed[pos + length[tok]]:
                tok = shorter[tok]
                if beside is not None and tok >= 0:
                    fits = beside.get(tok)
                    tok = fits if fits is not None else self.fitting(out[-1], tok)
            if tok >= 0:
                out.append(tok)
                pos += length[tok]
                beside, tok = memo[tok], -1
            else:
                allowed[pos] = 0
                tok = out.pop()
                pos -= length[tok]
                beside = memo[out[-1]] if out else None
        return out

    def encode(self, text: str) -> np.ndarray:
        plain = self.split_plain is not None and not _BEYOND_LATIN.search(text)
        pieces = self.split_plain(text) if plain else self.split_text(text)
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, pieces)), dtype=np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class _Longest(dict):
    """The longest token that is a prefix, by path in the automaton's trie."""

    def __init__(self, bpe: ByteBPE):
        super().__init__({bpe.token[r].decode("latin-1"): r for r in bpe.halves})

    def __missing__(self, path: str) -> int:
        k = len(path) - 1
        while path[:k] not in self:
            k -= 1
        self[path] = self[path[:k]]
        return self[path]


class _Pieces(dict):
    """Ids (packed) by piece: pieces repeat, so most look-ups never reach the encoder.  A full table becomes the
    older generation; a piece found there moves back, so frequent pieces are never encoded anew."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.bpe.encode_piece(piece.encode("utf-8"))).tobytes()
        if len(piece) <= 64:
            if len(self) >= MEMO_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_BEYOND_LATIN = re.compile("[^\x00-\u017f]")


def _plain_pattern(pattern: str):
    """The same splitter for texts below U+0180, in the quicker standard engine: its classes are
    written out from the other engine's.  None if the pattern holds another class."""
    if set(regex.findall(r"\\p\{\w+\}|\\\w", pattern)) - {r"\p{L}", r"\p{N}", r"\s", r"\S"} or "[^" in pattern.replace(r"[^\s\p{L}\p{N}]", ""):
        return None
    low = "".join(map(chr, range(0x180)))
    inside = {c: "".join(f"\\u{ord(x):04x}" for x in regex.findall(c, low)) for c in (r"\p{L}", r"\p{N}", r"\s")}
    out = pattern.replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(inside.values()) + "]").replace(r"\S", f"[^{inside[r'\s']}]")
    for c, chars in inside.items():
        out = out.replace(c, f"[{chars}]")
    return re.compile(out).findall


_LOADED: dict = {}


def _once(kind, data: bytes, *args):
    """``kind(parse_ranks(data), *args)``, built once in each worker process; the last of each kind is kept."""
    key = (hashlib.sha256(data).hexdigest(), *args)
    if kind not in _LOADED or _LOADED[kind][0] != key:
        _LOADED[kind] = key, kind(parse_ranks(data), *args)
    return _LOADED[kind][1]


def _token_bytes(ranks: dict[bytes, int]) -> dict[int, bytes]:
    return {r: t for t, r in ranks.items()}


def _shared(spark: SparkSession, path: str):
    """The rank file's bytes, read where the driver is and sent once to each executor (a
    vocabulary file is of fixed size, below 1 MB here, whatever the corpus)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with column ``ids`` (array<int>): the tokens of each whole text."""
    ranks = _shared(df.sparkSession, path)

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        give_back()                  # what the batch before took, in both steps
        bpe = _once(ByteBPE, ranks.value, pattern)
        return pd.Series([bpe.encode(t or "") for t in texts], index=texts.index, dtype=object)

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", digest: str = "ids_sha256", count: str = "n_tokens",
           keep_ids: bool = True) -> DataFrame:
    """``df`` with columns ``decoded`` (binary), the bytes that the tokens stand for, ``digest``, of the ids as
    little-endian unsigned 32-bit integers, and ``count``, their number; without the ids unless ``keep_ids``."""
    ranks = _shared(df.sparkSession, path)

    @F.pandas_udf("decoded binary, digest string, count bigint" + ", ids array<int>" * keep_ids)
    def run(rows: pd.Series) -> pd.DataFrame:
        token = _once(_token_bytes, ranks.value).__getitem__
        arrays = [np.asarray(x if x is not None else [], dtype="<u4") for x in rows]
        out = {"decoded": [b"".join(map(token, x.tolist())) for x in arrays],
               "digest": [hashlib.sha256(x.tobytes()).hexdigest() for x in arrays], "count": [len(x) for x in arrays]}
        if keep_ids:
            out["ids"] = pd.Series([x.view(np.int32) if had is not None else None for x, had in zip(arrays, rows)], dtype=object)
        return pd.DataFrame(out)

    fields = {decoded: "decoded", digest: "digest", count: "count"} | ({ids: "ids"} if keep_ids else {})
    rows = df.withColumn("__decoded", run(F.col(ids))).drop(ids)
    return rows.withColumns({c: F.col(f"__decoded.{f}") for c, f in fields.items()}).drop("__decoded")
