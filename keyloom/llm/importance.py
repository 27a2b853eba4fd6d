"""Importance resampling of documents towards a target, on hashed n-grams found by overlapped regex scanning.

A text is lower-cased (A-Z), its separators are collapsed to single spaces, and one regular expression with
boundary lookarounds runs over it with ``overlapped=True``: every word starts one match, whose groups end the
1-, 2- and 3-gram that begin there. The CRC of an n-gram continues that of the shorter one, and names its bucket.

Documents are scanned once. Their buckets (2 or 4 bytes a feature) are stored; bucket counts of all documents and of the
target are sums over them, ``buckets`` rows each. A bucket's gain is the floored log ratio of its smoothed shares, a
document's weight the sum over its features, its score that plus Gumbel noise keyed by ``doc_id``, and the
``share`` of the eligible documents with the highest scores is drawn. Ranks come from one shuffle by ranges of the
score: every part numbers its own rows, and the sizes of earlier parts are added, one row a part.

Words are runs of digits, letters a-z and everything beyond U+007F. Null texts are empty: no features, weight 0. A null
``doc_id`` draws noise as ``null`` and comes last among equal scores. Rows that repeat a ``doc_id`` each take part; those equal
in all else are told apart by their place in the stored table. Without documents or target texts the counts are 0 and every
formula still holds. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import array
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .shared import keep, slices, stored

BUCKETS = 10_000
MIN_WORDS = 20
SHARE = 5
"""Per cent of the eligible documents that are drawn."""

NGRAMS = rb"(?<![^ ])([^ ]+)(?:( [^ ]+)( [^ ]+)?)?(?![^ ])"
_SPACES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def collapsed(text: bytes) -> bytes:
    # bytes.lower() changes A-Z only; every byte of a longer code point is 0x80 or above.
    return b" ".join(text.lower().translate(_SPACES).split())


def features(text: bytes) -> tuple[int, np.ndarray]:
    """Words of a text, and the CRC of every n-gram."""
    scan = keep("ngrams", lambda: regex.compile(NGRAMS))
    crc, out, words = zlib.crc32, array.array("I"), 0
    add = out.append
    for match in scan.finditer(collapsed(text), overlapped=True):
        one, two, three = match.groups()
        words += 1
        value = crc(one)
        add(value)
        if two is not None:
            value = crc(two, value)
            add(value)
            if three is not None:
                add(crc(three, value))
    return words, np.frombuffer(out, np.uint32)


def scanned(docs: DataFrame, id_col: str | None, text_col: str, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features and the features' buckets, little-endian, per document."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = [features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([n for n, _ in found], pa.int64()),
                     pa.array([len(x) for _, x in found], pa.int64()),
                     pa.array([(x % np.uint32(buckets)).astype(width).tobytes() for _, x in found], pa.binary())],
                    names=["doc_id", "n_words", "n_features", "buckets"])

    doc_id = F.lit(None) if id_col is None else F.col(id_col)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows fall into each bucket: one partial sum a task, ``buckets`` rows in the end."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "buckets"):
                for own in part.column("buckets").to_pylist():
                    held += np.bincount(np.frombuffer(own, width), minlength=buckets)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(held[used], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floored thousandths of the log ratio between its smoothed shares in target and source."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Floored thousandths of a Gumbel draw that depends on the seed and the id alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    width = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "buckets"):
                weight = [int(gain[np.frombuffer(own, width)].sum()) for own in part.column("buckets").to_pylist()]
                yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(weight, pa.int64())], names=[*names, "weight"])

    names = ["doc_id", "n_words", "n_features"]
    return found.select(*names, "buckets").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ordered_parts(scored: DataFrame) -> DataFrame:
    """Rows in ranges of (eligible first, score descending, doc_id), numbered inside their part."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(before, before + n) + 1, pa.int64())],
                names=[*batch.schema.names, "part", "place"])
            before += n

    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "place_in"]
    rows = scored.repartitionByRange(*order).sortWithinPartitions(*order).drop("place_in")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return stored(rows.mapInArrow(number, f"{kinds}, part int, place long"), "ordered")


def resample(docs: DataFrame, target: DataFrame, seed: int = 42, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
             share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank per document; rank is null for those that are not drawn."""
    found = stored(scanned(docs, id_col, text_col, buckets), "features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(scanned(target, None, target_text_col, buckets), buckets))
    scored = weighed(found, gain).select(
        "doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"),
        (F.col("n_words") >= min_words).alias("eligible"), F.monotonically_increasing_id().alias("place_in"))
    numbered = ordered_parts(stored(scored, "scored"))
    # One row per part of the range shuffle.
    parts = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("fit")).selectExpr(
        "part", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base",
        f"sum(fit) OVER () * {share} div 100 AS drawn")
    place = F.col("base") + F.col("place")
    return numbered.join(F.broadcast(parts), "part").select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("eligible") & (place <= F.col("drawn")), place).alias("rank"))
