"""Blocks of vectors: a stated set of query rows against all rows, block by block.

Rows are dealt evenly over partitions (no key, so no hot key), each partition is packed into rows of bounded
size, and query blocks meet candidate blocks by an equi-join on (query partition, candidate partition).
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Rows of a block, and components of a block (a block ends at whichever comes first).
CANDIDATE_ROWS, QUERY_ROWS, BLOCK_COMPONENTS = 16384, 2048, 1 << 20


def integer_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double.  Null for a vector that is null or holds a null, NaN or
    infinite component.  A component beyond the range of a long is the nearest long."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def encode(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{k: shrink(a) for k, a in arrays.items()})
    return out.getvalue()


def decode(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k].astype(np.int64) for k in f.files}


def shrink(a: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest signed type that holds them."""
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    return a.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def block_counts(rows: int, queries: int, cores: int) -> tuple[int, int]:
    """How many partitions to deal candidates and queries over: full blocks, but enough of them for every core."""
    return max(-(-rows // CANDIDATE_ROWS), min(-(-rows // 1024), 2 * cores), 1), max(-(-queries // QUERY_ROWS), 1)


def pack(df: DataFrame, parts: int, most: int, name: str, to_bytes: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """``df`` (with an array column ``v``) dealt over ``parts`` partitions; each becomes blocks (``name``: the
    partition, ``data``: what ``to_bytes`` makes of the rows, sorted by ``id``), stored.  A block holds at most
    ``most`` rows and ``BLOCK_COMPONENTS`` components, counted as if all were as long as its longest."""
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held: list[dict] = []
        width = 0

        def flush() -> pd.DataFrame:
            rows = pd.DataFrame(held).sort_values("id", kind="stable", ignore_index=True)
            held.clear()
            return pd.DataFrame({name: [part], "data": [to_bytes(rows)]})

        for batch in batches:
            for row in batch.to_dict("records"):
                wider = max(width, len(row["v"]))
                if held and (len(held) >= most or (len(held) + 1) * wider > BLOCK_COMPONENTS):
                    yield flush()
                    wider = len(row["v"])
                width = wider
                held.append(row)
        if held:
            yield flush()

    return stored(df.repartition(parts).mapInPandas(blocks, f"{name} int, data binary"), f"blocks-{name}")


def meet(queries: DataFrame, candidates: DataFrame, query_parts: int, candidate_parts: int) -> DataFrame:
    """Every query block (``qp``, ``query``) with every candidate block (``cp``, ``candidate``).  Each side is
    copied once for each partition of the other, so both keys are spread over the cluster."""
    q = queries.select("qp", F.explode(F.sequence(F.lit(0), F.lit(candidate_parts - 1))).alias("cp"), F.col("data").alias("query"))
    c = candidates.select(F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("qp"), "cp", F.col("data").alias("candidate"))
    return q.join(c, ["qp", "cp"])


def first_indices(score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` highest scores (all, if fewer), highest first, ties by smaller index: the k-th score
    by partition selection, then the scores above it and the first that equal it."""
    n = score.size
    if n > k:
        least = np.partition(score, n - k)[n - k]
        above = np.flatnonzero(score > least)
        at = np.concatenate([above, np.flatnonzero(score == least)[:k - above.size]])
    else:
        at = np.arange(n)
    return at[np.lexsort((at, -score[at]))] if score.dtype != object else np.array(sorted(at.tolist(), key=lambda i: (-score[i], i)), dtype=np.int64)


def as_long(score) -> int:
    """A score as a long; beyond its range, the nearest one."""
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))
