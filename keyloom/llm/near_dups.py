"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets form one node. Nodes meet in banded MinHash buckets, and candidate pairs are
verified in two steps: signature batches of 32 values are compared one after the other, and a pair is dropped as
soon as the posterior probability that it reaches the similarity falls below ``miss``; what survives is
compared on the full shingle sets, rebuilt from the texts. Pairs of a bucket are never listed; three rounds
find all links that matter for the components:

1. every member of a bucket against its hub, the member that is in the most and largest buckets (the
   document that copies were made from is such a one);
2. members outside the hub's component ("strays") against the bucket's members of other components, for each stray the
   most alike pair;
3. strays that are left against all members of other components, with 864 further hashes before the exact test.

After the last round every pair that shares a bucket is verified, or dropped by the posterior bound, or lies within one
component. A pair at the similarity itself shares no bucket with probability 2.5e-7. Strays are dealt in
blocks of 256, so neither a bucket nor a hub is gathered in one task.

A text's words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, its set the distinct shingles of five words (fewer
words: all of them as one; no words: empty, and linked with nothing). Sets hold 64-bit shingle hashes. Two
documents are linked if ``100 * |A and B| >= 75 * |A or B|``. Null texts are empty; rows that repeat a ``doc_id`` with
different texts are one document and share its component; a row with a null ``doc_id`` takes no part: its
component is null and it is kept. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shingles
from .components import components
from .shared import keep, slices, stored

PERCENT = 75
MISS = 1e-4
BLOCK = 256
PAIRS = 1 << 15
"""Pairs that a task holds before it hands them on; one stray's come on top."""


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, on sorted distinct arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) of (doc_id, text); digest and sig are null for empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        perms = keep("permutations", shingles.permutations)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles.shingle_set(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([shingles.signature(s, perms).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "sig"])
    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def bands(nodes: DataFrame) -> DataFrame:
    """(key, band, node): the band keys of every node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(-1, shingles.HASHES)
                node = np.asarray(part.column("node"))
                yield pa.RecordBatch.from_arrays([
                    pa.array(shingles.band_keys(sig).ravel()), pa.array(np.tile(np.arange(shingles.BANDS, dtype=np.int32), len(node))),
                    pa.array(np.repeat(node, shingles.BANDS))], names=["key", "band", "node"])
    return nodes.select("node", "sig").mapInArrow(run, "key long, band int, node long")


def meet(pairs: DataFrame, payload: DataFrame, test: Callable[[], Callable[[bytes], object]],
         agree: Callable[[object, object], bool]) -> DataFrame:
    """The pairs (a, b) whose payloads agree. ``payload`` has node and data.

    The partners of an ``a`` are dealt in groups of about ``BLOCK``, and its payload travels once to each group;
    ``test()`` gives the function that prepares a payload.
    """
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("groups"))
    dealt = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("group"))
    data = payload.select("node", "data")
    own = (dealt.select("a", "group").distinct().join(data.withColumnRenamed("node", "a"), "a")
           .select("a", "group", F.lit(None).cast("long").alias("b"), "data"))
    other = dealt.join(data.withColumnRenamed("node", "b"), "b").select("a", "group", "b", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepare, at, mine = test(), None, None
        for batch in batches:
            found = []
            for a, group, b, blob in zip(*(batch.column(n).to_pylist() for n in ("a", "group", "b", "data"))):
                if b is None:
                    at, mine = (a, group), prepare(blob)
                elif (a, group) == at and agree(mine, prepare(blob)):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    together = own.unionByName(other).repartition("a", "group").sortWithinPartitions("a", "group", F.col("b").asc_nulls_first())
    return together.mapInArrow(run, "a long, b long").distinct()


def as_set() -> Callable[[bytes], np.ndarray]:
    return shingles.shingle_set


def as_signature() -> Callable[[bytes], np.ndarray]:
    return lambda blob: np.frombuffer(blob, "<u2")


def long_signatures(data: DataFrame) -> DataFrame:
    """(node, more): the further hashes of each node's text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = keep("more permutations", lambda: shingles.permutations(shingles.MORE, 7))
        for batch in batches:
            for part in slices(batch, "data"):
                more = [shingles.signature(shingles.shingle_set(t), perms).astype(np.uint8).tobytes() for t in part.column("data").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(more, pa.binary())], names=["node", "more"])
    return data.mapInArrow(run, "node long, more binary")


def strays_against_members(buckets: DataFrame, labels: DataFrame, hubs: DataFrame, nodes: DataFrame, bounds: list[tuple[int, int]],
                           best_only: bool, further: list[tuple[int, int]]) -> DataFrame:
    """Pairs (a, b) of a stray and a member of another component that the posterior bound keeps.

    ``buckets``: key, band, node; ``labels``: node, component; ``hubs``: key, hub; ``nodes``: node, sig, and more, whose
    hashes are compared after those of sig, by the bounds of ``further`` (an empty ``more`` is not compared).
    """
    members = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    major = hubs.join(labels.withColumnRenamed("node", "hub"), "hub", "left").select(
        "key", F.coalesce("component", "hub").alias("major"))
    members = members.join(major, "key").withColumn("stray", F.col("component") != F.col("major"))
    # With two members, the pair is the one that round 1 verified.
    open_keys = (members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stray").cast("long")).alias("strays"))
                 .where((F.col("n") > 2) & (F.col("strays") > 0)).select("key", F.ceil(F.col("strays") / BLOCK).alias("blocks")))
    members = members.join(open_keys, "key").join(nodes.select("node", "sig", "more"), "node")
    asking = members.where("stray").select("key", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), F.lit(0).alias("side"),
                                           "band", "node", "component", "sig", "more")
    asked = members.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"),
                           "band", "node", "component", "sig", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, strays, best = None, [], {}

        def flush(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("key", "block", "side", "band", "node", "component", "sig", "more")]
            rows = list(zip(*cols))
            found: list[tuple[int, int]] = []
            i = 0
            while i < len(rows):
                key = rows[i][:2]
                if key != at:
                    found.extend(best_pair[1:] for best_pair in best.values())
                    at, strays, best = key, [], {}
                j = i
                while j < len(rows) and rows[j][:3] == (*key, rows[i][2]):
                    j += 1
                group = rows[i:j]
                i = j
                if group[0][2] == 0:
                    strays.extend(group)
                    continue
                band = group[0][3]
                sig = np.frombuffer(b"".join(r[6] for r in group), "<u2").reshape(-1, shingles.HASHES)
                more = np.frombuffer(b"".join(r[7] for r in group), np.uint8).reshape(len(group), -1)
                node, comp = np.array([r[4] for r in group]), np.array([r[5] for r in group])
                for s in strays:
                    own = np.frombuffer(s[6], "<u2")
                    left, matches, start = np.flatnonzero(comp != s[5]), 0, 0
                    for m, least in bounds:
                        matches = matches + (sig[left, start:m] == own[start:m]).sum(1)
                        ok = matches >= least
                        left, matches, start = left[ok], matches[ok], m
                    own_more = np.frombuffer(s[7], np.uint8)
                    for m, least in further if len(own_more) else ():
                        matches = matches + (more[left, start - shingles.HASHES:m - shingles.HASHES]
                                             == own_more[start - shingles.HASHES:m - shingles.HASHES]).sum(1)
                        ok = matches >= least
                        left, matches, start = left[ok], matches[ok], m
                    if not len(left):
                        continue
                    # A pair that shares several buckets is taken up in the first of them.
                    shared = (sig[left].reshape(len(left), shingles.BANDS, -1) == own.reshape(shingles.BANDS, -1)).all(2)
                    first = shared.argmax(1) == band
                    for t, m in zip(left[first].tolist(), matches[first].tolist()):
                        pair = (s[4], int(node[t]))
                        if not best_only:
                            found.append(pair)
                        elif m > best.get(s[4], (-1,))[0]:
                            best[s[4]] = (m, *pair)
                    if len(found) >= PAIRS:
                        yield flush(found)
                        found = []
            yield flush(found)
        yield flush([best_pair[1:] for best_pair in best.values()])

    dealt = asking.unionByName(asked).repartition("key", "block").sortWithinPartitions("key", "block", "side")
    pairs = dealt.mapInArrow(run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, miss: float = MISS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept per document."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    bounds = shingles.least_matches(percent / 100, miss)
    sketch = stored(sketches(texts), "sketches")
    nodes = stored(sketch.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("digest")
                   .agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"))
                   .withColumn("node", F.monotonically_increasing_id()), "nodes")

    every = bands(nodes)
    sizes = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    buckets = stored(every.join(sizes, "key"), "buckets")
    score = buckets.groupBy("node").agg(F.sum("n").alias("score"))
    hubs = stored(buckets.join(score, "node").groupBy("key").agg(
        F.max(F.struct("score", (-F.col("node")).alias("low"))).alias("top")).select("key", (-F.col("top.low")).alias("hub")), "hubs")
    buckets = buckets.select("key", "band", "node")

    candidates = buckets.join(hubs, "key").where(F.col("node") != F.col("hub")).select(
        F.col("hub").alias("a"), F.col("node").alias("b")).distinct()

    def likely(x: np.ndarray, y: np.ndarray) -> bool:
        matches, start = 0, 0
        for m, least in bounds:
            matches += int((x[start:m] == y[start:m]).sum())
            if matches < least:
                return False
            start = m
        return True

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        return linked(x, y, percent)

    payload = nodes.select("node", F.col("sig").alias("data"))
    survivors = stored(meet(candidates, payload, as_signature, likely), "survivors")
    # Texts of the nodes that can be in a pair; a document stands for its node only with the text that gave the digest.
    wanted = buckets.select("node").distinct().join(nodes.select("node", "least", "digest"), "node")
    data = stored(node_texts(texts, wanted), "texts")

    # Texts that share a doc_id are one document.
    of_doc = sketch.where(F.col("doc_id").isNotNull()).join(nodes.select("digest", "node"), "digest").groupBy("doc_id").agg(
        F.min("node").alias("u"), F.max("node").alias("v"), F.collect_set("node").alias("all")).where("u < v")
    links = stored(meet(survivors, data, as_set, alike).select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        of_doc.select("u", F.explode("all").alias("v"))), "links")
    done, labels = survivors, stored(components(links), "labels")
    further = shingles.least_matches(percent / 100, miss, shingles.HASHES + 216, 216, shingles.HASHES + shingles.MORE)
    short = nodes.withColumn("more", F.lit(b""))
    for best_only in (True, False):
        signed = short if best_only else nodes.join(long_signatures(data), "node")
        more = strays_against_members(buckets, labels, hubs, signed, bounds, best_only, further)
        known = done.unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = stored(more.join(known, ["a", "b"], "left_anti"), "survivors")
        found = stored(meet(more, data, as_set, alike).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        done = done.unionByName(more)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = stored(components(links), "labels")

    named = nodes.join(labels, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_digest = named.join(least, "component").select("digest", "component_id")
    out = sketch.select("doc_id", "n_shingles", "digest").join(of_digest, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def node_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, data): the text of each wanted node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            for part in slices(batch, "text"):
                same = [xxhash.xxh3_128_digest(shingles.shingle_set(t).tobytes()) == d
                        for t, d in zip(part.column("text").to_pylist(), part.column("digest").to_pylist())]
                part = part.filter(pa.array(same))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("text")], names=["node", "data"])

    rows = texts.join(wanted.withColumnRenamed("least", "doc_id"), "doc_id").select("node", "digest", "text")
    return rows.mapInArrow(run, "node long, data binary")
