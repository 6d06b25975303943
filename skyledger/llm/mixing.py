"""Mixing sources to target weights by Sainte-Lague apportionment (operator 9).

1. Targets: the sources share ``share`` times all words by weight; a target stops at ``epochs``
   times its source's size and the excess is reshared by weight (water filling: the level rises to
   where the open sources take what the full ones leave).
2. Blocks: ``target / block_words`` seats in all go to the sources by highest quotients
   target / (2 k + 1); each source's seats go to its shards the same way, by shard size.  These are
   the integer quotas.
3. Selection: a shard's documents, in seeded hash order, are one stream of words, cut into equal
   blocks.  A quota of q over n blocks takes every block ``q div n`` times and ``q mod n`` of them
   once more: those that a seeded permutation puts first.  A document takes what its blocks take.

A shard is a hash bucket of a source, so a hot source is many shards; only the
sums of one source's shards (at most ``BUCKETS`` rows) meet in one task, and no task holds all
sources.  The rows are read twice and shuffled once.

Defined results: null text has size 0 and takes 0; a null source is a source, last in order; a
source of size 0 has target 0; an empty table gives an empty result.  Rows are told apart by a hash
of doc_id and text: repeated rows are each rows of their own (equal rows may swap what they take).
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ids import assign_sequential_ids, first_rows
from .common import WORD_PATTERN, n_words, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 20
#: Hash buckets that shards are made of: a source has this many shards at most.
BUCKETS = 1 << 16
#: Quotients of a party that are listed at once.
QUOTIENTS = 1 << 12


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 k + 1), at most ``most`` each (ties: the first).

    The seats that any divisor a little too large gives are given at once; only the last ones, about
    as many as there are parties, go one by one.
    """
    votes, most = np.asarray(votes, dtype=float), np.asarray(most, dtype=np.int64)
    given = np.zeros(len(votes), dtype=np.int64)
    total = votes.sum()
    sure = seats - len(votes) / 2 - 1
    if total > 0 and sure > 0:
        given = np.minimum(np.floor(votes / (total / sure) + 0.5).astype(np.int64), most)
    heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, given)) if v > 0 and g < most[i]]
    heapq.heapify(heap)
    left = seats - int(given.sum())
    while left > 0 and heap:
        i = heapq.heappop(heap)[1]
        given[i] += 1
        left -= 1
        if given[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size), a row a source, with its number ``place`` in order of source and its target.

    The level that the open sources fill to rises until no more of them reaches its cap; each step is
    one aggregation over whole numbers, so reruns agree and no task holds all sources.
    """
    s = assign_sequential_ids(sizes.withColumn("__last", F.col("source").isNull()), ["__last", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    s = s.select("source", "source_size", "place", weight.alias("weight"), (F.col("source_size") * epochs).alias("cap"))
    budget = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * level
        held, open_ = s.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_:
            target = F.col("cap").cast("double")
            break
        higher = (budget - (held or 0)) / open_
        if higher <= level:
            target = F.least(F.col("cap").cast("double"), F.col("weight") * level)
            break
        level = higher
    return s.select("source", "source_size", "place", target.alias("target"))


def apportion(parties: DataFrame, seats: int) -> DataFrame:
    """``parties`` (unique ``place``, ``votes``, ``most``) with ``seats`` by highest quotients
    votes / (2 k + 1), at most ``most`` each (ties: the least place).

    As ``sainte_lague``, for any number of parties: a divisor a little too large gives most seats in
    one aggregation, one a little too small bounds what a party can still get, and the few quotients
    between them are cut at the last seat without passing a task or the driver.
    """
    can = (F.col("votes") > 0) & (F.col("most") > 0)
    n, total, room = parties.where(can).agg(F.count(F.lit(1)), F.sum("votes"), F.sum("most")).first()
    none = F.lit(0).cast("long")
    if not n or seats <= 0:
        return parties.withColumn("seats", none)
    if seats >= room:
        return parties.withColumn("seats", F.when(can, F.col("most")).otherwise(none))

    def with_divisor(divisor: float) -> Column:
        return F.when(can, F.least("most", F.floor(F.col("votes") / F.lit(divisor) + 0.5))).otherwise(none)

    spare = n / 2 + 1
    sure = with_divisor(total / (seats - spare)) if seats > spare else none
    extra = spare
    while parties.agg(F.sum(with_divisor(total / (seats + extra)))).first()[0] < seats:
        extra *= 2                                   # the caps of others leave more to give
    # a hair lower: no quotient is lost to rounding
    parties = parties.withColumn("__sure", sure).withColumn("__reach", with_divisor(total / (seats + extra) * (1 - 1e-9)))
    left = seats - parties.agg(F.sum("__sure")).first()[0]
    quotients = (parties.where(F.col("__reach") > F.col("__sure"))
                 .withColumn("__from", F.explode(F.sequence("__sure", F.col("__reach") - 1, F.lit(QUOTIENTS))))
                 .withColumn("__k", F.explode(F.sequence("__from", F.least(F.col("__from") + (QUOTIENTS - 1), F.col("__reach") - 1))))
                 .select("place", "__k", (-F.col("votes") / (2 * F.col("__k") + 1)).alias("__falling")))
    won = first_rows(quotients, left, ["__falling", "place", "__k"]).groupBy("place").agg(F.count(F.lit(1)).alias("__won"))
    return (parties.join(won, "place", "left").withColumn("seats", F.col("__sure") + F.coalesce("__won", none))
            .drop("__sure", "__reach", "__won"))


def _shards(source_size: Column, shard_words: int) -> Column:
    """How many shards a source has: a power of two."""
    wanted = F.greatest(source_size / F.lit(shard_words), F.lit(1.0))
    return F.least(F.pow(F.lit(2.0), F.ceil(F.log2(wanted))), F.lit(float(BUCKETS))).cast("long")


def mix(df: DataFrame, seed: int = 7, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
        block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``df`` with size, source_size, target, taken and ``spans_1`` ... ``spans_<epochs>``: the word
    spans [start, end) of the document that the mix takes at least once, twice, ..."""
    added = ["size", "source_size", "target", "taken", *(f"spans_{k}" for k in range(1, epochs + 1))]
    df = df.drop(*(c for c in added if c in df.columns))
    keep = df.columns
    rows = (df.withColumn("size", n_words(text_of()))
            .withColumn("__h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")))
            .withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "__h"), F.lit(BUCKETS))))

    # one pass for all sums: a few numbers a source and bucket
    sums = rows.groupBy("source", "__bucket").agg(F.sum("size").alias("words")).checkpoint()
    per_source = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)

    # exact sums, whatever the order of the rows
    given = per_source.agg(F.sum(F.col("target").cast("decimal(38,6)"))).first()[0] or 0
    total = max(int(math.floor(float(given) / block_words + 0.5)), 1 if given > 0 else 0)
    blocks = F.greatest(F.floor(F.col("source_size") / block_words + 0.5), F.lit(1))
    most = F.when(F.col("source_size") > 0, blocks * epochs).otherwise(0).cast("long")
    per_source = (apportion(per_source.withColumn("votes", F.col("target")).withColumn("most", most), total)
                  .select("source", "source_size", "target", "seats")
                  .withColumn("shards", _shards(F.col("source_size"), shard_words)).checkpoint())

    named = per_source.withColumnRenamed("source", "__named")
    shards = (sums.join(named, sums["source"].eqNullSafe(named["__named"]))
              .select("source", "source_size", "target", "seats", "shards", "words", F.pmod("__bucket", "shards").alias("shard"))
              .groupBy("source", "source_size", "target", "seats", "shards", "shard").agg(F.sum("words").alias("words")))

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", ignore_index=True)
        words = pdf["words"].to_numpy()
        blocks = np.maximum(1, np.floor(words / block_words + 0.5)).astype(np.int64)
        pdf["quota"] = sainte_lague(words, int(pdf["seats"].iloc[0]), epochs * blocks)
        pdf["blocks"] = blocks
        rng = [np.random.default_rng([seed, int(s), int(w)]) for s, w in zip(pdf["shard"], words)]
        pdf["step"] = [next(a for a in iter(lambda: int(r.integers(1, n + 1)), None) if math.gcd(a, n) == 1) for r, n in zip(rng, blocks.tolist())]
        pdf["first"] = [int(r.integers(0, n)) for r, n in zip(rng, blocks.tolist())]
        return pdf.drop(columns=["seats"])

    plan = shards.groupBy("source").applyInPandas(
        quotas, "source string, source_size long, target double, shards long, shard long, words long, quota long, blocks long, step long, first long").checkpoint()

    # only sums by source and shard are joined to the rows: a row a shard
    where = plan.select(F.col("source").alias("__s"), F.col("shard").alias("__shard"), F.col("source_size"), "target",
                        "words", "quota", "blocks", "step", "first")
    sized = per_source.select(F.col("source").alias("__s0"), F.col("shards").alias("__shards"))
    rows = (rows.join(sized, rows["source"].eqNullSafe(sized["__s0"])).withColumn("__k", F.pmod("__bucket", "__shards")))
    stream = Window.partitionBy("source", "__k").orderBy("__h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__off", F.coalesce(F.sum("size").over(stream), F.lit(0).cast("long")))
    rows = rows.join(where, rows["source"].eqNullSafe(where["__s"]) & (rows["__k"] == where["__shard"]))

    end = F.col("__off") + F.col("size")
    border = lambda i: F.expr("0L") + F.floor(i * F.col("words") / F.col("blocks"))
    # the block of word w is the last whose border isn't after it
    block = lambda w: F.least(F.floor(((w + 1) * F.col("blocks") - 1) / F.col("words")), F.col("blocks") - 1)
    times = lambda i: F.expr("quota div blocks") + F.when((i * F.col("step") + F.col("first")) % F.col("blocks") < F.col("quota") % F.col("blocks"), 1).otherwise(0)
    span = lambda i: F.struct(F.greatest(border(i) - F.col("__off"), F.lit(0).cast("long")).alias("start"),
                              F.least(border(i + 1) - F.col("__off"), F.col("size")).alias("end"), times(i).alias("times"))
    cuts = F.when(F.col("size") > 0, F.transform(F.sequence(block(F.col("__off")), block(end - 1)), span))
    rows = rows.withColumn("__cuts", F.filter(cuts, lambda c: (c["times"] > 0) & (c["end"] > c["start"])))
    taken = F.coalesce(F.aggregate("__cuts", F.lit(0).cast("long"), lambda a, c: a + (c["end"] - c["start"]) * c["times"]), F.lit(0).cast("long"))
    # a second parameter of a lambda would be the element's index, so k is bound outside it
    at_least = lambda k: F.filter("__cuts", lambda c: c["times"] >= k)
    spans = [at_least(k).alias(f"spans_{k}") for k in range(1, epochs + 1)]
    return rows.select(*keep, "size", "source_size", "target", taken.alias("taken"), *spans)


def materialise(df: DataFrame, epochs: int = EPOCHS, text: str = "text", **options) -> DataFrame:
    """The mixed table, with ``df``'s columns: for each document and pass a row with the words that
    the mix takes in that pass (the whole text where it takes all; else its runs of words, joined by
    line feeds).  Documents of which nothing is taken give no row."""
    columns = df.columns
    mixed = mix(df, epochs=epochs, **options)
    passes = F.array(*[F.col(f"spans_{k}") for k in range(1, epochs + 1)])
    rows = mixed.withColumn("__spans", F.explode(F.filter(passes, lambda s: F.size(s) > 0)))
    return rows.withColumn(text, _cut(F.col(text), F.col("size"), F.transform("__spans", lambda s: s["start"]),
                                      F.transform("__spans", lambda s: s["end"]))).select(*columns)


_WORD = re.compile(WORD_PATTERN)


def cut(text: str, size: int, starts, ends) -> str:
    """Runs of words [start, end) of a text, joined by line feeds."""
    runs: list[list[int]] = []
    for a, b in zip(starts, ends):
        if runs and runs[-1][1] == a:
            runs[-1][1] = int(b)
        else:
            runs.append([int(a), int(b)])
    if runs == [[0, size]]:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    return "\n".join(text[at[a][0]:at[b - 1][1]] for a, b in runs)


@F.pandas_udf(T.StringType())
def _cut(texts: pd.Series, sizes: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([cut(*x) for x in zip(texts, sizes, starts, ends)], index=texts.index, dtype=object)
