"""Hard-negative mining with an exact matrix product in a residue number system.

Scores are integer inner products.  Blocks of component matrices are reduced modulo several small primes; each
residue product is a float32 matrix product whose sums stay below 2**24, so it is exact; Chinese remaindering
rebuilds the signed score from the residues.  A first pass selects each anchor's positives (its best rows of the
same label), a second the best rows of other labels inside each positive's score window; windows merge the blocks.

Defined results: a row whose id or label is null, whose vector is null or that holds a null or non-finite component
takes no part.  Vectors may differ in length; a missing component is 0.  Rows that share the anchor's id are its own
row.  Otherwise repeated rows are rows of their own.  Ties go to the smaller id.  An anchor without positives, or a
positive without a row in its window, gives no row; as the window of a negative positive score is empty, so does it.
Scores beyond a long are the nearest long.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import blocks

#: Anchors whose scores are held at once, and terms of a float32 product: 1,024 products of residues below 126
#: add up to less than 2**24.
TILE, TERMS = 64, 1024


def primes_below(n: int) -> list[int]:
    """The primes below ``n``, largest first."""
    return [p for p in range(n - 1, 2, -1) if all(p % q for q in range(2, int(p ** 0.5) + 1))]


PRIMES = primes_below(252)


def moduli(bound: int) -> list[int]:
    """As many primes as tell all integers from -bound to bound apart."""
    product, out = 1, []
    for p in PRIMES:
        if product > 2 * bound:
            break
        out.append(p)
        product *= p
    return out


def residues(a: np.ndarray, p: int) -> np.ndarray:
    """Each integer modulo ``p``, nearest to zero, as float32."""
    half = p // 2
    r = a % p
    return np.where(r > half, r - p, r).astype(np.float32)


def reconstruct(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed integers with these residues, by mixed radix digits: 64-bit while the primes' product fits."""
    product = 1
    for p in primes:
        product *= p
    kind = np.int64 if product < 1 << 62 else object
    value, radix = np.zeros(parts[0].shape, dtype=kind), 1
    for r, p in zip(parts, primes):
        digit = ((r - (value % p).astype(np.int64)) * pow(radix, -1, p)) % p
        value = value + digit.astype(kind) * radix
        radix *= p
    return np.where(value > product // 2, value - product, value)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integer matrices, exactly; the narrower one is filled up with zeros."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if width == 0 or a.size == 0 or b.size == 0:
        return np.zeros((a.shape[0], b.shape[0]), dtype=np.int64)
    most = [max(abs(int(x.min())), abs(int(x.max()))) for x in (a, b)]
    primes = moduli(most[0] * most[1] * width) or PRIMES[:1]
    parts = []
    for p in primes:
        left, right = residues(a, p), residues(b, p)
        total = np.zeros((a.shape[0], b.shape[0]), dtype=np.int64)
        for k in range(0, width, TERMS):
            total += (left[:, k:k + TERMS] @ right[:, k:k + TERMS].T).astype(np.int64)
        parts.append(total % p)
    return reconstruct(parts, primes)


def matrix(rows: pd.DataFrame) -> bytes:
    """Rows (``id``, ``label``, ``v``, and for anchors ``key`` and the positives' ``low`` and ``high``) as arrays."""
    width = max((len(v) for v in rows["v"]), default=0)
    m = np.zeros((len(rows), width), dtype=np.int64)
    for i, v in enumerate(rows["v"]):
        m[i, :len(v)] = v
    extra = {c: rows[c].to_numpy() for c in ("key",) if c in rows}
    if "positive_score" in rows:
        scores = rows["positive_score"].tolist()
        extra |= {"counts": np.array([len(s) for s in scores], dtype=np.int64),
                  "positive": np.concatenate([np.asarray(s, dtype=np.int64) for s in scores])}
    return blocks.encode(id=rows["id"].to_numpy(), label=rows["label"].to_numpy(), m=m, **extra)


def scored(anchors: dict, rows: dict, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor index, row indices, scores) of the rows that share the anchor's label, or of those that don't."""
    for label in np.unique(anchors["label"]):
        mine = np.flatnonzero(anchors["label"] == label)
        theirs = np.flatnonzero((rows["label"] == label) == same)
        if theirs.size == 0:
            continue
        m = rows["m"][theirs]
        for low in range(0, mine.size, TILE):
            tile = mine[low:low + TILE]
            for i, s in zip(tile, product(anchors["m"][tile], m)):
                own = rows["id"][theirs] != anchors["id"][i]
                yield (i, theirs, s) if own.all() else (i, theirs[own], s[own])


def positives_of_block(anchors: dict, rows: dict, k: int) -> Iterator[tuple]:
    """(anchor key, row id, score) of the ``k`` best rows of the same label."""
    for i, at, score in scored(anchors, rows, True):
        for j in blocks.first_indices(score, k):
            yield int(anchors["key"][i]), int(rows["id"][at[j]]), blocks.as_long(score[j])


def negatives_of_block(anchors: dict, rows: dict, k: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor key, number of the positive, row id, score) of the ``k`` best rows of other labels whose score is
    between ``low`` and ``high`` per cent of the positive's."""
    first = np.cumsum(anchors["counts"]) - anchors["counts"]
    for i, at, score in scored(anchors, rows, False):
        for n in range(int(anchors["counts"][i])):
            positive = int(anchors["positive"][first[i] + n])
            least, most = -(-low * positive // 100), high * positive // 100
            fit = np.flatnonzero((score >= least) & (score <= most))
            for j in blocks.first_indices(score[fit], k):
                yield int(anchors["key"][i]), n + 1, int(rows["id"][at[fit[j]]]), blocks.as_long(score[fit[j]])


def _over_blocks(pairs: DataFrame, of_block: Callable[[dict, dict], Iterator[tuple]], schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["query"], batch["candidate"]):
                yield pd.DataFrame(of_block(blocks.decode(a), blocks.decode(b)), columns=names)

    return pairs.select("query", "candidate").mapInPandas(score, schema)


def mine(rows: DataFrame, vector: str, label: Column, is_anchor: Column, scale: int, positives: int = 5, negatives: int = 10,
         low_percent: int = 30, high_percent: int = 90, id_col: str = "vec_id") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its
    best ``positives`` rows of the same label, the best ``negatives`` rows of other labels whose score is from
    ``low_percent`` to ``high_percent`` per cent of the positive's."""
    valid = stored(rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                               F.coalesce(is_anchor, F.lit(False)).alias("a"),
                               blocks.integer_components(F.col(vector), scale).alias("v"))
                   .where("id is not null and label is not null and v is not null")
                   .withColumn("key", F.monotonically_increasing_id()), "vectors")
    n = valid.agg(F.count("*").alias("n"), F.count_if("a").alias("q")).first()
    cp, qp = blocks.block_counts(n["n"], n["q"], rows.sparkSession.sparkContext.defaultParallelism)
    candidates = blocks.pack(valid.select("id", "label", "v"), cp, blocks.CANDIDATE_ROWS, "cp", matrix)
    anchors = valid.where("a").select("key", "id", "label", "v")

    best = _over_blocks(blocks.meet(blocks.pack(anchors, qp, blocks.QUERY_ROWS, "qp", matrix), candidates, qp, cp),
                        lambda a, b: positives_of_block(a, b, positives), "key long, positive_id long, positive_score long")
    n_th = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = stored(best.withColumn("n", n_th).where(F.col("n") <= positives), "positives")
    # at most ``positives`` rows an anchor
    with_scores = anchors.join(chosen.groupBy("key").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("n", "positive_score"))), lambda p: p["positive_score"]).alias("positive_score")), "key")

    found = _over_blocks(blocks.meet(blocks.pack(with_scores, qp, blocks.QUERY_ROWS, "qp", matrix), candidates, qp, cp),
                         lambda a, b: negatives_of_block(a, b, negatives, low_percent, high_percent),
                         "key long, n int, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("key", "n").orderBy(F.desc("negative_score"), "negative_id"))
    kept = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return kept.join(chosen, ["key", "n"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
