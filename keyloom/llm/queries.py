"""The dealt operators bound to their whole tables, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (bpe_automaton, importance, line_dedup, mixing, near_dups, page_wrappers, quality_rules, segment_topk, token_counts,
               token_store, toxicity, vector_codes, warc)
from .shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(table(spark, sf_dir, "documents")).select(
        "doc.doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens"
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_tokens(spark, path)


def op3_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op5_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_wrappers.main_texts(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_deduplicated(table(spark, sf_dir, "pages"), shared_dir(spark))
    return warc.read_archive(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_line_dedup, op2_token_store, op3_segment_topk, op4_near_dups, op5_page_wrappers, op6_mixing, op7_toxicity,
        op8_bpe_automaton, op9_quality_rules, op10_token_counts, op11_warc_revisits, op12_vector_codes, op13_importance)}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE, "op3_segment_topk": segment_topk.ORACLE, "op6_mixing": mixing.ORACLE,
    "op11_warc_revisits": warc.ORACLE, "op12_vector_codes": vector_codes.ORACLE}
