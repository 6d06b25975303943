"""Exact top-k search by exhaustive term-at-a-time accumulation.

A component number is a term.  Each candidate block is inverted: a term's postings are the rows with a non-zero
component there and their weights.  A query is a sparse row of (term, weight); for each of its terms the postings,
weighted, are scattered into a dense array with a score for every row of the block.  A partition selection leaves
the ``k`` best of the block, a window merges the blocks.  Every query meets every block: nothing is pruned.

Defined results: a row whose id is null, whose vector is null or that holds a null or non-finite component takes no
part.  An empty vector scores 0.  Vectors may differ in length; a missing component is 0.  Rows that share the
query's id are its own row and never returned to it; otherwise repeated rows are rows of their own, and a repeated
query row returns its own list.  Ties go to the smaller id.  Scores beyond a long are the nearest long, ranked by
their exact value within a block.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import blocks

#: Query rows that are scored together against a block.
TILE = 32


def sparse_rows(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of every non-zero component."""
    lengths = np.fromiter((len(v) for v in vectors), dtype=np.int64, count=len(vectors))
    weight = np.concatenate([np.asarray(v, dtype=np.int64) for v in vectors]) if len(vectors) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(vectors)), lengths)
    term = np.arange(weight.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    used = weight != 0
    return row[used], term[used], weight[used]


def by_term(rows: pd.DataFrame) -> bytes:
    """Rows (``id``, ``v``, and for queries ``key``) as postings: for each term that occurs, rows and weights."""
    row, term, weight = sparse_rows(rows["v"].tolist())
    order = np.lexsort((row, term))
    terms, start = np.unique(term[order], return_index=True)
    extra = {"key": rows["key"].to_numpy()} if "key" in rows else {}
    return blocks.encode(id=rows["id"].to_numpy(), term=terms, start=np.append(start, order.size), row=row[order],
                         weight=weight[order], **extra)


class Postings:
    """A decoded block: ``of[term]`` is the slice of its postings."""

    def __init__(self, data: bytes) -> None:
        b = blocks.decode(data)
        self.id, self.key, self.row, self.weight = b["id"], b.get("key"), b["row"], b["weight"]
        self.of = {int(t): slice(int(a), int(z)) for t, a, z in zip(b["term"], b["start"], b["start"][1:])}
        self.most = int(max(abs(int(self.weight.min())), abs(int(self.weight.max())))) if self.weight.size else 0


def accumulate(queries: Postings, candidates: Postings, low: int, high: int) -> np.ndarray:
    """Dense scores of the block's rows for the query rows ``low`` to ``high``, one term after another.  Whole
    numbers of arbitrary size where a sum might leave 63 bits."""
    wide = queries.most * candidates.most * max(1, len(candidates.of)) >= 1 << 62
    kind = object if wide else np.int64
    score = np.zeros((high - low, candidates.id.size), dtype=kind)
    for term, at in queries.of.items():
        postings = candidates.of.get(term)
        if postings is None:
            continue
        row, weight = queries.row[at], queries.weight[at].astype(kind)
        a, z = np.searchsorted(row, (low, high))
        if a == z:
            continue
        found, by = candidates.row[postings], candidates.weight[postings].astype(kind)
        if found.size == candidates.id.size:            # the term is in every row: scatter to all, in place
            for r, w in zip(row[a:z] - low, weight[a:z]):
                score[r] += w * by
        else:
            for r, w in zip(row[a:z] - low, weight[a:z]):
                score[r, found] += w * by
    return score


def best_of_block(queries: Postings, candidates: Postings, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(query key, query id, row id, score) of the ``k`` best rows of the block for every query."""
    for low in range(0, queries.id.size, TILE):
        high = min(low + TILE, queries.id.size)
        score = accumulate(queries, candidates, low, high)
        for i in range(low, high):
            other = np.flatnonzero(candidates.id != queries.id[i])
            mine = score[i - low][other] if other.size < candidates.id.size else score[i - low]
            for j in blocks.first_indices(mine, k):
                yield int(queries.key[i]), int(queries.id[i]), int(candidates.id[other[j]]), blocks.as_long(mine[j])


def search(rows: DataFrame, vector: str, is_query: Column, scale: int, k: int = 10, id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``is_query`` the ``k`` other rows with the highest integer
    inner product of the components floor(scale * x)."""
    valid = stored(rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"),
                               blocks.integer_components(F.col(vector), scale).alias("v"))
                   .where("id is not null and v is not null").withColumn("key", F.monotonically_increasing_id()), "vectors")
    n = valid.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    cp, qp = blocks.block_counts(n["n"], n["q"], cores)
    candidates = blocks.pack(valid.select("id", "v"), cp, blocks.CANDIDATE_ROWS, "cp", by_term)
    queries = blocks.pack(valid.where("q").select("key", "id", "v"), qp, blocks.QUERY_ROWS, "qp", by_term)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, c in zip(batch["query"], batch["candidate"]):
                yield pd.DataFrame(best_of_block(Postings(q), Postings(c), k), columns=["key", "query_id", "vec_id", "score"])

    best = blocks.meet(queries, candidates, qp, cp).select("query", "candidate").mapInPandas(
        score, "key long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
