"""Token ids of a corpus as one concatenated array with Elias-Fano coded document boundaries.

``write_tokens`` encodes every document, appends the end id, and writes segments in ascending
``doc_id`` order with Spark's own writer, so a lost executor only repeats its tasks. A segment holds

* ``ids``: the concatenated ids, little-endian, 2 bytes each when the vocabulary allows it, else 4;
* ``low``, ``high``, ``picks``: the ends of its documents, Elias-Fano coded. Each end is split into
  ``low_bits`` low bits, packed, and a high part in unary in ``high``; ``picks`` counts the ones
  before every 64 bytes of ``high``. ``ends`` answers select queries from these three alone: about
  ``2 + log2(ids / documents)`` bits a document in place of a table of 64-bit offsets;
* ``before``: ids of the same part before this segment. Parts are ranges of ``doc_id``; a part's own
  base is the sum over earlier parts, one row a part.

Null texts are empty (only the end id); null ``doc_id`` comes first; rows that repeat a ``doc_id``
are all kept, ordered by text; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe_automaton import byte_symbols
from .shared import Kept, keep, slices

BLOCK = 64
SEGMENT_IDS = 1 << 18
CACHED = 800_000
JOINED = 1000
SIGNS = ",.;:!?"

SEGMENTS = ("part int, seg int, n_docs int, n_ids long, before long, doc_ids array<bigint>, id_bytes int, "
            "ids binary, low_bits int, low binary, high binary, picks binary")


# ---- Elias-Fano -------------------------------------------------------------------------------

def elias_fano(ends: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Code an ascending array of non-negative integers: (low_bits, low, high, picks)."""
    n = len(ends)
    if not n:
        return 0, b"", b"", b""
    values = ends.astype(np.uint64)
    low_bits = max(0, int(values[-1] + 1).bit_length() - int(n).bit_length())
    low = b""
    if low_bits:
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(at[-1]) + 1, np.uint8)
    unary[at] = 1
    high = np.packbits(unary, bitorder="little")
    ones = np.bitwise_count(np.pad(high, (0, -len(high) % BLOCK))).reshape(-1, BLOCK).sum(1, dtype=np.uint32)
    picks = (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4")
    return low_bits, low, high.tobytes(), picks.tobytes()


def _byte_select() -> np.ndarray:
    """Entry [b, k]: the place of the k-th one in byte b."""
    table = np.zeros((256, 8), np.int64)
    for b in range(256):
        places = [i for i in range(8) if b >> i & 1]
        table[b, :len(places)] = places
    return table


def select(which: np.ndarray, low_bits: int, low: bytes, high: bytes, picks: bytes) -> np.ndarray:
    """The ``which``-th coded values (from 0), each found through the select structure."""
    which = np.asarray(which, np.int64)
    if not len(which):
        return np.zeros(0, np.int64)
    table = keep("byte_select", _byte_select)
    sampled = np.frombuffer(picks, "<u4").astype(np.int64)
    block = np.searchsorted(sampled, which, side="right") - 1
    raw = np.frombuffer(high + bytes(-len(high) % BLOCK), np.uint8).reshape(-1, BLOCK)[block]
    ones = np.cumsum(np.bitwise_count(raw), axis=1, dtype=np.int64)
    rest = which - sampled[block]
    byte = (ones <= rest[:, None]).sum(1)
    row = np.arange(len(which))
    inside = rest - np.where(byte > 0, ones[row, byte - 1], 0)
    place = (block * BLOCK + byte) * 8 + table[raw[row, byte], inside]
    value = (place - which) << low_bits
    if low_bits:
        offset = which * low_bits
        padded = np.frombuffer(low + bytes(8), np.uint8)
        words = padded[(offset >> 3)[:, None] + np.arange(8)].astype(np.uint64)
        word = (words << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64)
        value += ((word >> (offset & 7).astype(np.uint64)) & np.uint64((1 << low_bits) - 1)).astype(np.int64)
    return value


# ---- encoding ---------------------------------------------------------------------------------

_CUT = re.compile(r"(?= \S)")


class Encoder:
    """``tokenizers`` with a bounded table of chunks.

    A byte-level pre-tokenizer without prefix space always starts a new piece at a space that a
    non-space follows, so a text is the chunks between such spaces, one after the other. Chunks that the table lacks
    are encoded by the library many at a time, joined by spaces; in the ids, a chunk begins where a token
    begins with a space. Texts with a special token's string and vocabularies of another kind are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.dtype = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.by_chunk = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                         and not pre.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout") and not any(
                             t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"]
                             for t in spec.get("added_tokens", [])))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        space = byte_symbols()[32]
        self.begins = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        self.begins[[i for t, i in self.tok.get_vocab().items() if t.startswith(space)]] = True
        self.signs = dict(zip(SIGNS, self.whole([*SIGNS])))
        self.chunks = Kept(CACHED, self.chunk)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def chunk(self, chunk: str) -> bytes | None:
        """Ids of a chunk given without its space; None where a space before it is no sure boundary."""
        return None if not chunk or chunk[0].isspace() else self.whole([" " + chunk])[0]

    def learn(self, chunks: list[str]) -> None:
        """Put chunks into the table. Letters before a sign are a piece of their own, so ``word,`` needs ``word`` only; all others are
        encoded ``JOINED`` at a time."""
        table = self.chunks
        signed = [c for c in chunks if c[-1] in SIGNS and c.isascii() and c[:-1].isalpha()]
        apart = set(signed)
        whole = list({*(c for c in chunks if c not in apart), *(c[:-1] for c in signed if c[:-1] not in table)})
        groups = [whole[i:i + JOINED] for i in range(0, len(whole), JOINED)]
        width = np.dtype(self.dtype).itemsize
        for group, ids in zip(groups, self.whole(["".join([" " + c for c in g]) for g in groups])):
            at = np.flatnonzero(self.begins[np.frombuffer(ids, self.dtype)])
            if len(at) == len(group):
                cuts = (np.append(at, len(ids) // width) * width).tolist()
                for chunk, i, j in zip(group, cuts, cuts[1:]):
                    table.put(chunk, ids[i:j])
        for c in signed:
            table.put(c, table[c[:-1]] + self.signs[c[-1]])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        if not self.by_chunk:
            return self.whole(texts)
        parts = [None if any(s in t for s in self.special) else t.split(" ") for t in texts]
        table = self.chunks
        asked = {c for p in parts if p for c in p if c not in table}
        table.recall(asked)
        self.learn([c for c in asked if c and not c[0].isspace() and c not in table])
        out = []
        for text, own in zip(texts, parts):
            if own is None:
                out.append(self.whole([text])[0])
                continue
            try:
                out.append(self.whole([own[0]])[0] + b"".join(map(self.chunks.__getitem__, own[1:])))
            except TypeError:  # a space that white space follows is no boundary: pieces with one inside are encoded apart
                first, *rest = _CUT.split(text)
                odd = [first, *(p for p in rest if " " in p[1:])]
                known = dict(zip(odd, self.whole(odd)))
                out.append(known[first] + b"".join([known[p] if " " in p[1:] else table[p[1:]] for p in rest]))
        return out


def encoder(path: str) -> Encoder:
    return keep(("encoder", path), lambda: Encoder(path))


# ---- writing and reading ----------------------------------------------------------------------

def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Write the segments of ``docs`` to ``path``; one shuffle, by ranges of the document id."""
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, state = encoder(tokenizer), TaskContext.get().partitionId(), {"seg": 0, "before": 0}
        width = np.dtype(enc.dtype).itemsize
        end = np.array([end_id], enc.dtype).tobytes()
        doc_ids: list[int | None] = []
        blobs: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(b) // width for b in blobs], np.int64)
            low_bits, low, high, picks = elias_fano(np.cumsum(lengths))
            n = int(lengths.sum())
            row = {"part": part, "seg": state["seg"], "n_docs": len(blobs), "n_ids": n, "before": state["before"],
                   "doc_ids": list(doc_ids), "id_bytes": width, "ids": b"".join(blobs), "low_bits": low_bits,
                   "low": low, "high": high, "picks": picks}
            state["seg"] += 1
            state["before"] += n
            doc_ids.clear()
            blobs.clear()
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for piece in slices(batch, "text"):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), enc.encode(texts)):
                    doc_ids.append(doc_id)
                    blobs.append(ids + end)
                    held += len(ids) // width + 1
                    if held >= segment_ids:
                        yield flush()
                        held = 0
        if blobs:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Ties in the id are ordered by the text, so that reruns agree.
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(segments, SEGMENTS).write.parquet(path)


_ARROW = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()),
                    ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("id_bytes", pa.int32()),
                    ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()),
                    ("picks", pa.binary())])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32, and on request its ids."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    parts = segments.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("total"))
    # One row per written part: bounded by the number of tasks of the writing stage.
    base = parts.select("part", F.coalesce(F.sum("total").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = segments.join(F.broadcast(base), "part").select(
        (F.col("base") + F.col("before")).alias("base"), "n_docs", "doc_ids", "id_bytes", "ids", "low_bits", "low",
        "high", "picks")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = select(np.arange(r["n_docs"]), r["low_bits"], r["low"], r["high"], r["picks"])
                starts = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(r["ids"], f"<u{r['id_bytes']}").astype("<u4")
                own = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["base"], pa.int64()),
                        pa.array(ends - starts, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if with_ids else "")
    return rows.mapInArrow(documents, out)
