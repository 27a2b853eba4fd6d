"""Token counts through a digest cache.

Content is normalised (null becomes empty; nothing else, since the model's own normaliser keeps every
character), and its SHA-256 together with the SHA-256 of the tokenizer file keys a stored count. Digests
that the cache lacks are reduced to one text each before their shuffle, encoded once, and appended to
the cache; then every document's digest is joined to its count. A large group of copies therefore
costs one encoding, and only its digests meet in the last join, which adaptive execution can split.

Null and empty texts count 0 tokens; rows with null or repeated ``doc_id`` are counted each on its own;
an empty table gives an empty table and adds nothing to the cache; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import keep, shared_dir, slices

CACHE = "tokenizer string, digest binary, n_tokens long"


def counter(path: str):
    """A function from texts to their token counts, for a ``.json`` or ``.model`` file."""
    if path.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def known_counts(docs: DataFrame, cache: str, version: str) -> DataFrame:
    """The cache's counts for one tokenizer version, one row per digest; empty if there is no cache yet."""
    spark = docs.sparkSession
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except Exception as error:  # only a cache that was never written
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], CACHE)
    # Runs at the same time may append the same digest twice.
    return rows.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per document; ``cache`` is a folder of Parquet files."""
    cache = cache or f"{shared_dir(docs.sparkSession)}/token_counts"
    version = file_digest(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = keep(("counter", path), lambda: counter(path))
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n = pa.array(count(part.column("text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("digest"), n], names=["digest", "n_tokens"])

    misses = (rows.groupBy("digest").agg(F.first("text").alias("text"))
              .join(known_counts(docs, cache, version), "digest", "left_anti"))
    (misses.mapInArrow(encode, "digest binary, n_tokens long")
     .select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache))
    return (rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
            .join(known_counts(docs, cache, version), "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
