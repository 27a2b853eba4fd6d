"""From ``documents`` to encoded training text: quality rules, line dedup, near-dedup, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's ``docs``; all but the last return the columns of ``documents``. Nulls, empty tables and repeated rows are
treated as each operator states. No SQL states the whole: ``ORACLE_SQL`` is None, and a test compares ``run`` with
a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from keyloom.llm import bpe_automaton, line_dedup, mixing, near_dups, quality_rules
from keyloom.llm.shared import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.judge(docs).where("kept").select("doc.*").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all but one document; ``n_chars`` follows the text."""
    out = line_dedup.drop_lines(docs).select("doc.*", F.col("kept").alias("text")).drop("n_chars")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    lost = near_dups.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.expand(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return bpe_automaton.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dups", near), ("mixing", mix), ("bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
