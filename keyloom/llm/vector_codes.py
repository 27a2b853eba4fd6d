"""Vector codes by limb-split exact matrix products.

A vector's scaled components are floored to integers and cut into ``parts`` equal consecutive parts; each part is
replaced by the index of the nearest of up to ``entries`` codebook rows of its position. Nearest is exact: integers are
broken into limbs so small that a float64 BLAS product of two limbs stays below 2^53, the products of limb pairs are
recombined in int64, and the first smallest squared distance wins.

Codebooks start as the parts of the smallest ids and are refined for ``rounds`` rounds. A round is one scan: every task
sums its parts per entry, the sums of tasks are added by Spark, and ``parts * entries`` rows of sums (a bound by parameters)
come to the driver for the floored means. Entries without parts stay. A last scan gives codes and errors.

Rows without vector, with an empty one, or with null or non-finite components take no part. So do rows whose length is not a
multiple of ``parts`` or differs from that of the first kept row in order, as they cannot be coded with it, and rows with a
component whose integer lies beyond ``reach`` (2^27 at 64 components), as distances must fit int64. Rows are ordered by
id, nulls last, then vector; rows that repeat an id each count. With fewer rows than ``entries`` the codebook has as
many entries as rows. Null labels are a label of their own. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .segment_topk import usable
from .shared import attach, stored

SCALE, PARTS, ENTRIES, ROUNDS = 256.0, 16, 64, 2
ROWS = 2048
"""Rows per product: with 16 parts of 64 entries, 16 MB of distances."""


def reach(dim: int) -> int:
    """Integers up to this in size have squared distances over ``dim`` components of at most 2^62."""
    return 1 << (60 - max(0, dim - 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 arrays below 2^bits in size; shifted left by 0, ``bits``, 2 ``bits`` ... they add up to ``x``."""
    out = []
    while np.abs(x).max(initial=0) >> bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact int64 inner products of (parts, n, width) with (parts, entries, width)."""
    bits = (53 - x.shape[2].bit_length()) // 2
    out = np.zeros((x.shape[0], x.shape[1], c.shape[1]), np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(c, bits)):
            out += np.matmul(a, b.transpose(0, 2, 1)).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part: (parts, n) both, for integers (n, parts * width)."""
    parts, entries, width = c.shape
    x = np.ascontiguousarray(x.reshape(len(x), parts, width).transpose(1, 0, 2))
    away = products(x, c)
    away *= -2
    away += (x * x).sum(2)[:, :, None] + (c * c).sum(2)[:, None, :]
    entry = away.argmin(2)
    return entry, np.take_along_axis(away, entry[:, :, None], 2)[:, :, 0]


def integers(vectors: pa.ListArray, scale: float) -> np.ndarray:
    """(n, dim) int64 of floored scaled components; all vectors have one length and no nulls."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).astype(np.int64).reshape(len(vectors), -1)


def pieces(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield part, integers(part.column("vector"), scale)


def refined(rows: DataFrame, books: np.ndarray, scale: float) -> np.ndarray:
    """One round: the floored means of the parts nearest to each entry."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        for _, x in pieces(batches, scale):
            entry, _ = nearest(x, books)
            for p in range(parts):
                count[p] += np.bincount(entry[p], minlength=entries)
                np.add.at(total[p], entry[p], x[:, p * width:(p + 1) * width])
        part, own = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(own, pa.int32()), pa.array(count[part, own]),
             *[pa.array(total[part, own, w]) for w in range(width)]], names=names)

    names = ["part", "entry", "n", *[f"s{w}" for w in range(width)]]
    kinds = "part int, entry int, n long" + "".join(f", s{w} long" for w in range(width))
    added = rows.select("vector").mapInArrow(sums, kinds).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])
    out = books.copy()
    for r in added.collect():  # parts * entries rows at most
        out[r.part, r.entry] = [r[f"s{w}"] // r.n for w in range(width)]
    return out


def kept_rows(vectors: DataFrame, scale: float, parts: int, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """vec_id, label, vector of the rows that can be coded: usable, and of one length."""
    vector = F.col(vector_col)
    rows = vectors.where(usable(vector) & (F.size(vector) % parts == 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), vector.cast("array<double>").alias("vector"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).select(F.size("vector").alias("dim")).collect()
    dim = first[0].dim if first else parts
    most = F.lit(float(reach(dim)))
    return rows.where((F.size("vector") == dim) & F.forall("vector", lambda x: F.abs(x * scale) < most))


def encode(vectors: DataFrame, scale: float = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
           id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 per kept row."""
    rows = kept_rows(vectors, scale, parts, id_col, vector_col, F.col(label_col))
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not start:
        return rows.selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    first = integers(pa.array([r.vector for r in start], pa.list_(pa.float64())), scale)
    books = np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = refined(rows, books, scale)
    name = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    digits = 2 if entries <= 256 else 4

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in pieces(batches, scale):
            entry, away = nearest(x, books)
            codes = entry.T.astype(">u1" if digits == 2 else ">u2")
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                 pa.array(away.sum(0), pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = dict(rows.dtypes)["label"]
    coded = stored(rows.mapInArrow(assign, f"vec_id long, label {kind}, code string, error long"), "codes")
    errors = stored(coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")), "labels")
    return attach(coded, errors, "label").select("vec_id", "code", "error", F.col("fact.label_error").alias("label_error"),
                                                 F.lit(name).alias("codebooks_sha256"))


def _assign(n: int) -> str:
    away = " + ".join(f"(c.x[{i}] - b.x[{i}]) * (c.x[{i}] - b.x[{i}])" for i in range(1, 5))
    return f"""
near{n} AS (
  SELECT vec_id, label, p, any_value(x) AS x, min(d) AS d, arg_min(e, d * 64 + e) AS e
  FROM (SELECT c.vec_id, c.label, c.p, c.x, b.e, {away} AS d FROM cut c JOIN book{n} b ON c.p = b.p)
  GROUP BY vec_id, label, p)"""


def _refine(n: int) -> str:
    means = ", ".join(f"CAST(floor(sum(x[{i}])::DOUBLE / count(*)) AS BIGINT)" for i in range(1, 5))
    return f"""
book{n + 1} AS (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{n} b
  LEFT JOIN (SELECT p, e, [{means}] AS x FROM near{n} GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""


ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
cut AS (SELECT vec_id, label, p, v[4 * p + 1 : 4 * p + 4] AS x FROM kept, range(16) t(p)),
book0 AS (
  SELECT p, e, x FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id)
  WHERE e < 64),{_assign(0)},{_refine(0)},{_assign(1)},{_refine(1)},{_assign(2)},
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code,
         CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY vec_id),
named AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, named
"""
