"""Exact top-k search by inner product, by MaxScore over shards.

The components of a query are its terms. In a shard, a term's contribution lies
between two bounds, given by the smallest and largest component of the shard; its
postings are the vectors that are off the lower bound. With a threshold in hand,
the terms of smallest spread that cannot lift a vector over it, even together,
are non-essential: candidates come from the postings of the others. Candidates
then probe the non-essential terms, widest spread first, and leave as soon as
the bounds of the terms that remain cannot bring them to the threshold.

Shards of ``shard_rows`` vectors meet blocks of ``block_queries`` queries; a
task holds one shard and one block. Each sends its k best per query, and the
best of all shards are ranked. Scores are exact integers.

Defined results: ids that are null and vectors that are null or hold a null, NaN
or infinite component take no part; vectors of unequal length are compared over
the components both have; equal scores go to the smaller id; rows that repeat an
id and its vector are one row; a query's own id is never its result; fewer than
k candidates are all returned; empty tables give no rows; other columns are not
read. Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 5
SHARD_ROWS = 4_096
BLOCK_QUERIES = 2_048
#: Vectors scored in full to get a first threshold.
FIRST = 256
#: Non-essential terms probed between two checks.
STRIDE = 8


def scaled_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): components times ``scale``, rounded down; unusable rows are left out."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & usable)
    return rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows by id; shorter vectors are filled with zeros."""
    ids = table.column("id").to_numpy()
    vectors = table.column("v").combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(ids), max(sizes, default=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy()
    order = np.lexsort((*out.T[::-1], ids)) if len(ids) else np.zeros(0, np.int64)
    ids, out = ids[order], out[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (out[1:] != out[:-1]).any(axis=1)
    return ids[new], out[new]


def _kth(scores: np.ndarray, k: int) -> float:
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf


def max_score(query: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of all vectors whose score is at least the k-th best; ``low`` and ``high`` bound each component."""
    base = np.minimum(query * low, query * high)
    spread = np.maximum(query * low, query * high) - base
    threshold = _kth(vectors[:FIRST] @ query, k)
    terms = np.argsort(spread, kind="stable")
    reach = base.sum() + np.cumsum(spread[terms])
    split = int(np.searchsorted(reach, threshold, side="left"))
    essential, others = terms[split:], terms[:split][::-1]
    at_low = np.where(query >= 0, low, high)
    posted = vectors[:, essential] != at_low[essential]
    rows = np.flatnonzero(posted.any(axis=1)) if len(others) else np.arange(len(vectors))
    partial = vectors[np.ix_(rows, essential)] @ query[essential]
    for begin in range(0, len(others), STRIDE):
        rest = (base + spread)[others[begin:]].sum()
        alive = partial + rest >= threshold
        rows, partial = rows[alive], partial[alive]
        probed = others[begin : begin + STRIDE]
        partial = partial + vectors[np.ix_(rows, probed)] @ query[probed]
    best = partial >= max(threshold, _kth(partial, k))
    return rows[best], partial[best]


def _search(k: int):
    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        ids, vectors = _matrix(candidates)
        query_ids, asked = _matrix(queries)
        width = min(vectors.shape[1], asked.shape[1])
        vectors, asked = vectors[:, :width], asked[:, :width]
        found: list[tuple] = []
        if len(ids) and len(query_ids):
            top = int(np.abs(vectors).max(initial=0)) * int(np.abs(asked).max(initial=0)) * max(1, width)
            if top >= 1 << 62:
                raise OverflowError("Scores do not fit 64 bits")
            kind = np.float64 if top < 1 << 52 else np.int64
            vectors, asked = np.ascontiguousarray(vectors, kind), asked.astype(kind)
            low, high = vectors.min(axis=0), vectors.max(axis=0)
            for query_id, query in zip(query_ids.tolist(), asked):
                own = int((ids == query_id).sum())
                rows, scores = max_score(query, vectors, low, high, k + own)
                others = ids[rows] != query_id
                best = np.lexsort((ids[rows[others]], -scores[others]))[:k]
                found += [(query_id, int(i), int(s)) for i, s in zip(ids[rows[others]][best], scores[others][best])]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    return search


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of every query."""
    candidates = scaled_vectors(vectors, id_col, vector_col, scale)
    asked = scaled_vectors(queries, id_col, vector_col, scale)
    shards = max(1, -(-candidates.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_queries))
    place = F.xxhash64("id")
    spread = candidates.select("id", "v", F.pmod(place, F.lit(shards)).alias("shard"))
    spread = spread.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = asked.select("id", "v", F.pmod(place, F.lit(blocks)).alias("block"))
    dealt = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    pairs = spread.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block"))
    found = pairs.applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
