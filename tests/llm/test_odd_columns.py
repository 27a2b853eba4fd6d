"""Columns with names that are no identifiers, or that operators use themselves."""

import time

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from llm_cases import edge_texts, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyloom.llm import bpe_automaton, line_dedup, mixing, quality_rules, shared, token_store

NAMES = ["a-b", "my col", "__source", "__size", "__key", "row", "own", "plan", "fact", "repeats", "n_words", "é`x", "1", "text.x"]


@pytest.fixture()
def odd(spark):
    docs = frame(spark)
    quoted = [f"`{n.replace('`', '``')}`" for n in NAMES]
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)]), quoted


def test_operators_carry_them(odd):
    docs, quoted = odd
    plain = docs.select(docs.columns[:13])
    lines = line_dedup.drop_lines(docs)
    assert lines.select("doc.*").columns == [c for c in docs.columns if c != "text"]
    assert lines.select(*[F.col("doc").getField(n) for n in NAMES if "`" not in n]).distinct().count() == 1
    judged = quality_rules.judge(docs)
    assert judged.select("doc.*").columns == docs.columns and judged.count() == docs.count()
    mixed = mixing.expand(docs)
    assert mixed.columns == docs.columns and mixed.count() == mixing.expand(plain).count()


def test_pipeline_stages_take_them(spark, odd):
    docs, _ = odd
    for name, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, "").columns == corpus_pipeline.COLUMNS, name


CODE_POINTS = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]


@pytest.mark.parametrize("name,make", [("word_bpe_49k.json", lambda p: [bpe_automaton.Tokenizer(p).encode, "<u4"]),
                                       ("byte_bpe_50k.json", lambda p: [lambda t, e=token_store.Encoder(p): e.encode([t])[0], "<u2"])])
def test_every_code_point_is_encoded_as_by_the_library(name, make):
    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)
    encode, kind = make(path)
    # Forty code points a text, each inside a word, alone and at both ends of a word.
    for k in range(0, len(CODE_POINTS), 40):
        text = " ".join(f"a{chr(c)}b {chr(c)} {chr(c)}x y{chr(c)}" for c in CODE_POINTS[k:k + 40])
        assert np.frombuffer(encode(text), kind).tolist() == lib.encode(text, add_special_tokens=False).ids, hex(CODE_POINTS[k])


def test_workers_let_go_of_what_no_task_asks_for(monkeypatch):
    now = [100.0]
    monkeypatch.setattr(time, "monotonic", lambda: now[0])
    shared.worker_cache().clear()
    made = []
    make = lambda k: shared.keep(k, lambda: made.append(k) or k)
    make("a"), make("b"), make("a")
    now[0] += shared.IDLE / 2
    make("b")
    now[0] += shared.IDLE / 2 + 1
    make("b")
    assert set(shared.worker_cache()) == {"b"} and made == ["a", "b"]
    now[0] += 10 * shared.IDLE
    make("b")
    assert made == ["a", "b"] and make("a") == "a" and made == ["a", "b", "a"]
    shared.worker_cache().clear()


def test_repeats_never_pass_the_epochs(spark):
    rows = mixing.mix(frame(spark, edge_texts() + [(500 + i, "", "a") for i in range(30)])).collect()
    assert max(r.repeats for r in rows) <= 3
