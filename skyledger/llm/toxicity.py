"""Toxicity scores on text restored by a noisy-channel decoder (operator 7).

1. A character trigram model is counted over every document (letters of Latin scripts; anything else
   is a border), so its evidence grows with the corpus while its table stays of fixed size.
2. Words that look disguised (digits or signs for letters, letters spelled out with separators,
   letters repeated three times or more) are lattices: each character stands for itself, for the
   letters it can stand for, or for nothing (a separator, a repeat), at a cost.  Viterbi decoding
   under the trigram model gives the likeliest plain word, and where there are separators also the
   likeliest plain words, with separators read as word borders.  Runs of one character count as
   three; there is no limit of length.
3. Features of a text are its words, plain and restored, and their prefixes of 4 to 7 letters, each
   seen at least once, twice, three times.  From
   at most ``TRAIN_ROWS`` labelled documents (near copies counted once: one document for each least
   shingle hash) those features are kept that toxic documents hold far more often than others, and a
   logistic regression over them and over the text's length class gives their weights.

Only labels of ``train`` rows are learned from; doc_id, lang and source are never looked at.

Defined results: null and empty texts have no feature: their score is that of the intercept and length class 0.  A label
row that is null, or whose document is missing, is not learned from; without labelled rows of both
kinds every score is the base rate (0 without any).  Repeated rows are scored alike; an empty table
gives an empty result.  Texts are read whole; tables sent to the executors are of fixed size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, shingle_set

#: At most about so many labelled documents are learned from, and so many features kept.
TRAIN_ROWS = 16_000
MAX_FEATURES = 4_000
#: Toxic documents that must hold a feature, and how many times the base rate its share must be.
MIN_TOXIC, MIN_LIFT = 4, 3.0
#: Strength of the weight decay, and slots that features are hashed to.
WEIGHT_DECAY, SLOTS = 0.0005, 1 << 16
#: Words whose readings a worker remembers (it starts anew then), and texts whose features it holds at once.
MEMO_ENTRIES, HELD_TEXTS = 30_000, 50
#: The same while scoring, where most words have no known stem and an entry is little more than the word.
SCORED_ENTRIES = 200_000

# fixed values: the letters of the model, and what other characters can stand for
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = frozenset(".-_*~'` /\\,")
SUBSTITUTE_COST, DROP_COST, REPEAT_COST, BORDER_COST = 1.5, 0.4, 0.7, 0.4

_SIZE = 64
_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
_CODES = np.zeros(0x180, dtype=np.int64)
for _c, _i in _INDEX.items():
    _CODES[ord(_c)] = _i
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PLAIN = re.compile(rf"[{LETTERS}]+")
_EDGES = "".join(set("\"'#%&*.,;:?!()[]{}<>|/\\«»“”„…–—-_~`^=+¿¡"))
_RUN = re.compile(r"(.)\1{3,}", re.S)
_TRIPLE = re.compile(rf"([{LETTERS}])\1\1")
_SPELLED = re.compile(rf"(?<![^\s])[{LETTERS}0-9@$](?:[ ._*~-]{{1,2}}[{LETTERS}0-9@$!|+])+[ ._*~-]{{1,2}}[{LETTERS}0-9@$](?![^\s.,;:?!])")


# ---------------------------------------------------------------- the character model

def trigrams_of(text: str) -> np.ndarray:
    """Codes of the letter trigrams of a text (borders count as a letter)."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    code = np.zeros(points.size + 4, dtype=np.int64)
    code[2:-2] = np.where(points < 0x180, _CODES[np.minimum(points, 0x17F)], 0)
    return (code[:-2] * _SIZE + code[1:-1]) * _SIZE + code[2:]


def count_trigrams(df: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts over all texts.  Each task sums up its own rows first; the result has at most
    64**3 entries whatever the corpus."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_SIZE ** 3, dtype=np.int64)
        for batch in batches:
            for t in batch["t"]:
                if t:
                    total += np.bincount(trigrams_of(t), minlength=_SIZE ** 3) if len(t) > 20_000 else 0
                    if len(t) <= 20_000:
                        at, n = np.unique(trigrams_of(t), return_counts=True)
                        total[at] += n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"code": at, "n": total[at]})

    rows = (df.select(F.col(text).alias("t")).mapInPandas(released(part), "code long, n long")
            .groupBy("code").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(_SIZE ** 3, dtype=np.int64)
    for r in rows:
        counts[r["code"]] = r["n"]
    return counts


class Decoder:
    """Viterbi decoding of disguised words under the trigram model."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(_SIZE, _SIZE, _SIZE).astype(np.float64)
        pair, single = c.sum(axis=2), c.sum(axis=(1, 2))
        back = (pair.sum(axis=0) + 0.5) / (pair.sum() + 0.5 * _SIZE)      # how common a letter is
        middle = (pair + 5 * back[None, :]) / (single[:, None] + 5)        # after one letter
        full = (c + 2 * middle[None, :, :]) / (pair[:, :, None] + 2)
        self.cost = (-np.log(full)).astype(np.float32)

    def restore(self, word: str, borders: bool = False) -> str:
        """The likeliest plain word; '' if some character can't be read.  With ``borders``,
        separators can be spaces between words."""
        cost, paths = self.cost, {(0, 0): (0.0, None)}      # the letters as (those before, last)
        last = ""
        for c in word:
            options = []
            if c in _INDEX:
                options.append((c, 0.0))
                if c == last:
                    options.append(("", REPEAT_COST))
            for x in STANDS_FOR.get(c, ""):
                options.append((x, SUBSTITUTE_COST))
            if c in SEPARATORS:
                options.append(("", DROP_COST))
                if borders:
                    options.append((" ", BORDER_COST))
            if c == last and c in STANDS_FOR:
                options.append(("", REPEAT_COST))
            if not options:
                return ""
            ahead: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (so_far, out) in paths.items():
                for x, price in options:
                    i = _INDEX.get(x, 0)
                    state = (b, i) if x else (a, b)
                    value = so_far + price + (float(cost[a, b, i]) if x else 0.0)
                    if state not in ahead or value < ahead[state][0]:
                        ahead[state] = (value, (out, x) if x else out)
            paths, last = ahead, c
        ends = [(v + float(cost[a, b, 0]), out) for (a, b), (v, out) in paths.items()]
        least = min(v for v, _ in ends)
        return min(_letters(out) for v, out in ends if v == least)


def _letters(chain: tuple | None) -> str:
    out = []
    while chain is not None:
        chain, x = chain
        out.append(x)
    return "".join(reversed(out))


#: Numbers of occurrences that are features of their own.
LEVELS = (1, 2, 3)


def stems_of_word(word: str) -> list[str]:
    """The word and its prefixes of 4 to 7 letters."""
    return [word, *("^" + word[:k] for k in (4, 5, 6, 7) if len(word) > k)]


def readings(word: str, decoder: Decoder) -> list[str]:
    """The plain words that a (lower-case) word can be: without the signs around it, and restored."""
    out = []
    bare = word.strip(_EDGES)
    if bare:
        out.append(bare)
    for form in {bare, word.strip("\"'.,;:?«»“”()[]{}#%&*")}:
        form = _RUN.sub(r"\1\1\1", form)
        if len(form) >= 3 and (not _PLAIN.fullmatch(form) or _TRIPLE.search(form)) and any(c in _INDEX for c in form):
            restored = decoder.restore(form)
            if len(restored) >= 3 and restored != bare:
                out.append(restored)
            if restored and any(c in SEPARATORS for c in form):
                out.extend(w for w in decoder.restore(form, borders=True).split() if len(w) >= 3 and w not in out)
    return out


def words_of(text: str | None) -> Counter:
    """The lower-case words of a text and how often each occurs; letters spelled out are one word more."""
    low = (text or "").lower()
    words = Counter(_WORD.findall(low))
    for m in _SPELLED.finditer(low):
        words[m[0]] += 1
    return words


def length_class(words: Counter) -> str:
    return f"length:{words.total().bit_length()}"


# ---------------------------------------------------------------- learning

def train_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most about ``rows`` labelled documents, the same at every run."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    # its size is bounded by the sample just taken, not by the corpus
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.join(F.broadcast(known), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """The model: trigram counts, base rate, and the weights of features."""
    counts = count_trigrams(docs)
    decoder_of = docs.sparkSession.sparkContext.broadcast(counts)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(decoder_of.value)
        memo: dict[str, list[str]] = {}
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                if len(out) >= HELD_TEXTS:
                    yield pd.DataFrame(out, columns=["least", "toxic", "features"])
                    out = []
                found: Counter = Counter()
                words = words_of(text)
                for w, n in words.items():
                    stems = memo.get(w)
                    if stems is None:
                        stems = [f for r in readings(w, decoder) for f in stems_of_word(r)]
                        if len(memo) >= MEMO_ENTRIES:
                            memo.clear()
                        if len(w) <= 64:
                            memo[w] = stems
                    for f in stems:
                        found[f] += n
                shingles = shingle_set((text or "").encode("utf-8"), 3)
                out.append((int(shingles[0].astype(np.int64)) if shingles.size else 0, int(toxic),
                            [length_class(words), *(f"{k}:{f}" for f, n in found.items() for k in LEVELS if n >= k)]))
            yield pd.DataFrame(out, columns=["least", "toxic", "features"])

    sample = (train_rows(docs, labels, rows).mapInPandas(released(gather), "least long, toxic int, features array<string>")
              .dropDuplicates(["least", "toxic"]).checkpoint())
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    base = bad / (bad + good) if bad + good else 0.0
    model = {"counts": counts, "base": base, "weights": {}, "intercept": None}
    if not bad or not good:
        return model
    tally = (sample.select("toxic", F.explode("features").alias("f")).groupBy("f")
             .agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")))
    kept = [r["f"] for r in (tally.where((F.col("bad") >= MIN_TOXIC) & (F.col("bad") > MIN_LIFT * base * F.col("n")))
                             .orderBy(F.desc(F.col("bad") - MIN_LIFT * base * F.col("n")), "f").limit(MAX_FEATURES).collect())]
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(kept))

    def known_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["toxic"].astype(float), "kept": [
                [f for f in features if f in sent.value or f.startswith("length:")] for features in batch["features"]]})

    hashed = HashingTF(inputCol="kept", outputCol="vector", numFeatures=SLOTS, binary=True)
    rows = hashed.transform(sample.mapInPandas(released(known_only), "label double, kept array<string>").coalesce(2)).select("label", "vector").cache()
    fitted = LogisticRegression(featuresCol="vector", labelCol="label", regParam=WEIGHT_DECAY, standardization=False, maxIter=60).fit(rows)
    rows.unpersist()
    weight = fitted.coefficients.toArray()
    model["weights"] = {f: float(weight[hashed.indexOf(f)]) for f in [*kept, *(f"length:{k}" for k in range(40))]}
    model["intercept"] = float(fitted.intercept)
    return model


# ---------------------------------------------------------------- scoring

class _Known(dict):
    """The stems of a word that some known feature has, by word."""

    def __init__(self, model: dict):
        super().__init__()
        self.decoder = Decoder(model["counts"])
        self.weights = model["weights"]
        self.stems: dict[str, list[float]] = {}         # by stem: the weights up to each level
        for f, w in self.weights.items():
            level, stem = f.split(":", 1)
            if level != "length":
                row = self.stems.setdefault(stem, [0.0] * (len(LEVELS) + 1))
                for i in range(LEVELS.index(int(level)) + 1, len(LEVELS) + 1):
                    row[i] += w
        self.intercept = model["intercept"]

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = tuple(f for r in readings(word, self.decoder) for f in stems_of_word(r) if f in self.stems)
        if len(self) >= SCORED_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found

    def evidence(self, text: str | None) -> float:
        seen: Counter = Counter()
        words = words_of(text)
        for w, n in words.items():
            for f in self[w]:
                seen[f] += n
        return (self.intercept + self.weights.get(length_class(words), 0.0)
                + sum(self.stems[f][sum(n >= k for k in LEVELS)] for f, n in sorted(seen.items())))


def score(df: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of each whole text."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    @released
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        if m["intercept"] is None:
            yield from (pd.Series(m["base"], index=batch.index, dtype=float) for batch in batches)
            return
        known = _Known(m)
        for batch in batches:
            x = np.array([known.evidence(t) for t in batch], dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x, -30, 30))), index=batch.index)

    return df.withColumn(out, run(F.col(text)))


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learned from: crc32 of the id's text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
