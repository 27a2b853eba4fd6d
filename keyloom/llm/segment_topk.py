"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are cut into segments; a segment is summed up by its mean and deviation. With L components,
``d(q, x)^2 >= L * ((mq - mx)^2 + (sq - sx)^2)`` over each segment, and as ``2 q.x = |q|^2 + |x|^2 - d^2``
this bounds the inner product from above by the sum of ``L * (mq * mx + sq * sx)``. Levels of 1, 4 and 16
segments tighten the bound; a candidate whose bound falls below the k-th best score known is dropped at the
coarsest level that shows it, and only survivors get an exact score.

Work is dealt in blocks: candidates in blocks of ``block`` rows, queries in blocks of ``query_block``, and every
query block meets every candidate block through a join on the candidate block's number. A pair of blocks
returns k rows a query at most, and a ranking over query ids finishes the job.

Components are floored after scaling, in double precision, and scores are exact integers. Vectors that are null,
empty, or hold null or non-finite components, and rows without ``vec_id``, take no part; vectors meet those of
their own length only. A row that repeats a ``vec_id`` is a candidate of its own, but not for queries of that id,
and a repeated query id asks with the first of its vectors in order. Ties go to the smaller ``vec_id``. An empty
table gives an empty table; other columns are ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import stored

LEVELS = (1, 4, 16)


def usable(vector: Column) -> Column:
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment sqrt(L) times mean and deviation, so that a dot product of two rows is the bound."""
    parts = x.reshape(len(x), segments, -1)
    root = math.sqrt(parts.shape[2])
    return np.concatenate([parts.mean(2) * root, parts.std(2) * root], axis=1)


def padded(x: np.ndarray) -> np.ndarray:
    """Zeros up to a multiple of the finest level; they change no inner product."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % LEVELS[-1])))


def search(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """For each query its k best candidates of one block: (query id, vector ids, scores)."""
    q, x = padded(q), padded(x)
    exact_in_floats = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2.0 ** 53
    q_stats, x_stats = ([statistics(v, s) for s in LEVELS] for v in (q, x))

    def score(i: int, rows: np.ndarray) -> np.ndarray:
        if exact_in_floats:
            return x[rows] @ q[i]
        wide = [int(v) for v in q[i]]
        return np.array([sum(int(a) * b for a, b in zip(row, wide)) for row in x[rows]], object)

    for i, own in enumerate(q_ids.tolist()):
        coarse = x_stats[0] @ q_stats[0][i]
        mid = x_stats[1] @ q_stats[1][i] if len(x) > 4 * k else coarse
        others = x_ids != own
        # The k candidates that look best give a first k-th best score.
        first = np.argpartition(np.where(others, mid, -np.inf), max(0, len(x) - k))[max(0, len(x) - k):]
        first = first[others[first]]
        least = min(score(i, first)) if len(first) == k else -math.inf
        slack = least - 1e-9 * (1 + abs(float(least))) if least != -math.inf else least
        left = np.flatnonzero(others & (coarse >= slack))
        for level in range(1, len(LEVELS)):
            bound = x_stats[level][left] @ q_stats[level][i]
            left = left[bound >= slack]
        scores = score(i, left)
        if exact_in_floats:
            best = np.lexsort((x_ids[left], -scores))[:k]
        else:
            best = np.array(sorted(range(len(left)), key=lambda j: (-scores[j], x_ids[left[j]]))[:k], int)
        yield own, x_ids[left[best]], [int(s) for s in scores[best]]


def blocks(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """Rows (id, vector) packed into (dim, n, ids, data) of up to ``size`` vectors of one length."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, data = held.pop(dim)
            return pa.RecordBatch.from_pylist([{"dim": dim, "n": len(ids), "ids": np.array(ids, "<i8").tobytes(),
                                                "data": np.stack(data).astype("<f8").tobytes()}], schema=schema)
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vector").to_numpy(zero_copy_only=False)):
                ids, data = held.setdefault(len(v), ([], []))
                ids.append(i)
                data.append(np.floor(scale * np.asarray(v, np.float64)))
                if len(ids) >= size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])
    count = rows.count()
    return rows.repartition(max(1, math.ceil(count / size))).mapInArrow(pack, "dim int, n int, ids binary, data binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id",
          vector_col: str = "embedding", block: int = 4096, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for every query row."""
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    asked = rows.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = asked.groupBy("id").agg(F.min("vector").alias("vector"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    # Stored, as numbers given to blocks must not change when a task runs again.
    x = stored(blocks(rows, block, scale).select(F.monotonically_increasing_id().alias("block"), "*"), "vectors")
    q = blocks(asked, query_block, scale).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    every = stored(q, "queries").join(x.select("dim", "block"), "dim")
    pairs = every.join(x.drop("dim"), "block").select("dim", "q_ids", "q_data", "ids", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, x_ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                found = list(search(q_ids, np.frombuffer(r["q_data"], "<f8").reshape(len(q_ids), -1),
                                    x_ids, np.frombuffer(r["data"], "<f8").reshape(len(x_ids), -1), k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()),
                     pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
                     pa.array([s for f in found for s in f[2]], pa.int64())], names=["query_id", "vec_id", "score"])

    best = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
