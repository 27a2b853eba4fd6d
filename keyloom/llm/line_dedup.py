"""Line deduplication with two Bloom filters.

Pass 1 reads every line once. Each task keeps two filters over line-key hashes, *once* for hashes seen
and *twice* for hashes met again in another document. Tasks hand over only their non-zero words,
which are merged per filter block: ``twice = twice | (once & other once)``, ``once = once | other once``.
Pass 2 tests each line against the merged *twice* filter; only the suspected repeats are shuffled,
with their text, to count the documents that hold a key exactly and to find the one that keeps it.
A false positive costs a row of that shuffle and nothing else, a false negative cannot happen.

The filter that is broadcast has ``filter_bits`` bits (16 MB by default), whatever the input. It should
be about 10 bits a distinct long line; when a corpus outgrows it, more lines become suspects and the exact
confirmation, which is an ordinary distributed aggregation, carries them: the result is the same.

A text is split at line feeds; null or empty is one empty line. A key is the line without white space
(U+0020, U+0009 to U+000D) at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code points
that ``min_docs`` documents hold lose all their lines except in the largest ``doc_id`` with that key. Rows
that repeat a ``doc_id`` count as one document; rows with a null ``doc_id`` neither count nor change. An empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import WHITE, attach, column, slices, stored

MIN_CHARS, MIN_DOCS = 20, 3
FILTER_BITS = 1 << 27
BLOCK_WORDS = 1024


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line already in lower case; None if it is too short."""
    key = line.strip(WHITE)
    n = len(key)
    if n < min_chars or n < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def text_keys(text: bytes, min_chars: int = MIN_CHARS) -> set[bytes]:
    # bytes.lower() changes A-Z only.
    keys = {line_key(x, min_chars) for x in text.lower().split(b"\n")}
    keys.discard(None)
    return keys


def hashes(keys: list[bytes]) -> np.ndarray:
    import xxhash
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def place(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's word and its three bits in it; ``words`` is a power of two."""
    one, low = np.uint64(1), np.uint64(63)
    mask = np.zeros_like(h)
    for s in (46, 52, 58):
        mask |= one << (h >> np.uint64(s) & low)
    return (h & np.uint64(words - 1)).astype(np.int64), mask


class Filters:
    """The *once* and *twice* filters of one task."""

    def __init__(self, bits: int):
        self.words = bits // 64
        self.once = np.zeros(self.words, np.uint64)
        self.twice = np.zeros(self.words, np.uint64)

    def add(self, h: np.ndarray) -> None:
        """Hashes of distinct (document, key) pairs."""
        h, n = np.unique(h, return_counts=True)
        word, mask = place(h, self.words)
        again = (n > 1) | (self.once[word] & mask == mask)
        np.bitwise_or.at(self.twice, word[again], mask[again])
        np.bitwise_or.at(self.once, word, mask)

    def blocks(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        once, twice = self.once.reshape(-1, BLOCK_WORDS), self.twice.reshape(-1, BLOCK_WORDS)
        for b in np.flatnonzero(once.any(axis=1)).tolist():
            at = np.flatnonzero(once[b])
            yield b, at.astype("<u2").tobytes(), once[b][at].tobytes(), twice[b][at].tobytes()


def twice_filter(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The merged *twice* filter over (doc_id, text); it has ``bits`` bits."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(bits)
        for batch in batches:
            for part in slices(batch, "text"):
                keys = [k for t in part.column("text").to_pylist() for k in text_keys(t, min_chars)]
                if keys:
                    own.add(hashes(keys))
        for rows in itertools.batched(own.blocks(), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for b, at, once, twice in zip(*(batch.column(n).to_pylist() for n in names)):
                if b not in held:
                    held[b] = np.zeros(BLOCK_WORDS, np.uint64), np.zeros(BLOCK_WORDS, np.uint64)
                all_once, all_twice = held[b]
                i, o = np.frombuffer(at, "<u2"), np.frombuffer(once, np.uint64)
                all_twice[i] |= np.frombuffer(twice, np.uint64) | (all_once[i] & o)
                all_once[i] |= o
        for rows in itertools.batched(((b, t.tobytes()) for b, (_, t) in held.items() if t.any()), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary()))],
                                             names=["block", "twice"])

    names, kinds = ["block", "at", "once", "twice"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    merged = (docs.mapInArrow(build, "block int, at binary, once binary, twice binary").repartition("block")
              .mapInArrow(merge, "block int, twice binary"))
    out = np.zeros((bits // 64 // BLOCK_WORDS, BLOCK_WORDS), np.uint64)
    for b, words in merged.toLocalIterator():  # bits / 8 bytes at most, block by block
        out[b] = np.frombuffer(words, np.uint64)
    return out.ravel()


def repeated_keys(rows: DataFrame, filter_bits: int, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, keys): the keys that a document loses. ``rows`` has doc_id and text as binary."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(twice_filter(rows, filter_bits, min_chars).tobytes())

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, keys = [], []
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    own = text_keys(t, min_chars)
                    ids.extend([i] * len(own))
                    keys.extend(own)
                if not keys:
                    continue
                word, mask = place(hashes(keys), len(twice))
                hit = np.flatnonzero(twice[word] & mask == mask).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in hit], pa.int64()),
                                                  pa.array([keys[i] for i in hit], pa.binary())], names=["doc_id", "key"])

    suspects = stored(rows.mapInArrow(suspect, "doc_id long, key binary"), "suspects")
    shared.unpersist()
    confirmed = stored(suspects.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
                       .where(F.col("n") >= min_docs), "confirmed")
    lost = attach(suspects, confirmed, "key").where(F.col("doc_id") != F.col("fact.keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))  # a document's own lines


def drop_lines(docs: DataFrame, filter_bits: int = FILTER_BITS, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` under ``doc``, then n_lines, n_dropped, kept_sha256 and kept (the text, null if it was)."""
    if filter_bits & (filter_bits - 1) or filter_bits < 64 * BLOCK_WORDS:
        raise ValueError("filter_bits is a power of two, at least 65536")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    with_id = docs.where(F.col(id_col).isNotNull())
    lost = repeated_keys(with_id.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")),
                         filter_bits, min_chars, min_docs)
    rows = docs.select(F.struct(*[column(c) for c in docs.columns if c != text_col]).alias("doc"),
                       F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    joined = rows.join(lost, "doc_id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines, dropped, digest, kept = [], [], [], []
                for t, keys in zip(part.column("text").to_pylist(), part.column("keys").to_pylist()):
                    own = (t or b"").split(b"\n")
                    stay = own
                    if keys:
                        lose = set(keys)
                        stay = [x for x in own if line_key(x.lower(), min_chars) not in lose]
                    out = b"\n".join(stay)
                    lines.append(len(own))
                    dropped.append(len(own) - len(stay))
                    digest.append(hashlib.sha256(out).hexdigest())
                    kept.append(None if t is None else out)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()),
                     pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                    names=["doc", "n_lines", "n_dropped", "kept_sha256", "kept"])

    found = T.StructType.fromDDL("n_lines long, n_dropped long, kept_sha256 string, kept binary")
    out = joined.select("doc", "text", "keys").mapInArrow(cut, T.StructType([joined.schema["doc"], *found]))
    return out.withColumn("kept", F.col("kept").cast("string"))


ORACLE = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
             GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS dropped
           FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
