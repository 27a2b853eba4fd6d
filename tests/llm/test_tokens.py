import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_cases import edge_texts, frame
from tokenizers import Tokenizer

from keyloom.llm import bpe_automaton, token_counts, token_store
from keyloom.llm.shared import Kept, shared_dir


def test_elias_fano_round_trip_and_size():
    r = random.Random(3)
    for n in (1, 2, 63, 64, 65, 1000):
        for most in (0, 1, 5, 3000):
            ends = np.cumsum([r.randint(0, most) for _ in range(n)])
            coded = token_store.elias_fano(ends)
            assert token_store.select(np.arange(n), *coded).tolist() == ends.tolist()
            some = np.array([r.randrange(n) for _ in range(20)])
            assert token_store.select(some, *coded).tolist() == ends[some].tolist()
            if n == 1000 and most == 3000:
                assert 8 * sum(map(len, coded[1:])) < n * (3 + np.log2(most))
    assert token_store.elias_fano(np.zeros(0, np.int64)) == (0, b"", b"", b"")


def test_encoder_equals_library_on_odd_texts():
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(5)
    alphabet = "abcdeABC'sll ÀßIİΣ́<|>019.,;\n\t\x0b\x1c　​漢🙂  \x85"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(2000)]
    texts += ["a<|endoftext|> b", "  ", " a", "a \n b", "I'll  don't", ""]
    for t, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, enc.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files(spark):
    docs, path = frame(spark), f"{shared_dir(spark)}/tokens"
    token_store.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), segment_ids=200)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, t, _ in sorted(edge_texts(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = [tuple(r) for r in token_store.read_tokens(spark, path, with_ids=True).collect()]
    key = lambda x: (x[1], str(x))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert spark.read.parquet(path).count() > 3
    empty = f"{shared_dir(spark)}/tokens"
    token_store.write_tokens(docs.limit(0), empty, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_store.read_tokens(spark, empty).count() == 0


def merge_by_rank(symbols, rank):
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank), default=None)
        if best is None:
            return symbols
        pair = symbols[best[1]], symbols[best[1] + 1]
        out, i = [], 0
        while i < len(symbols):
            if tuple(symbols[i:i + 2]) == pair:
                out.append("".join(pair))
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out


def test_automaton_accepts_exactly_the_bpe_sequences():
    r = random.Random(8)
    for _ in range(60):
        tokens, merges = ["a", "b", "c"], []
        for _ in range(r.randint(0, 12)):
            u, v = r.choice(tokens), r.choice(tokens)
            if u + v not in tokens:
                tokens.append(u + v)
                merges.append((u, v))
        number = {t: i for i, t in enumerate(tokens)}
        auto = bpe_automaton.Automaton([0, 1, 2], [(number[u], number[v], number[u + v]) for u, v in merges])
        rank = {p: i for i, p in enumerate(merges)}
        for _ in range(40):
            word = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
            want = [number[t] for t in merge_by_rank(list(word), rank)]
            paths = [[]]
            done = []
            while paths:  # all token paths of the word that the automaton accepts
                path = paths.pop()
                at = sum(len(tokens[t]) for t in path)
                if at == len(word):
                    done.append(path)
                for t, i in number.items():
                    if i in auto.born and word.startswith(t, at) and (not path or auto.allows(path[-1], i)):
                        paths.append([*path, i])
            assert done == [want], (merges, word)


def test_bpe_encode_decode(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in bpe_automaton.encode_decode(frame(spark), path).collect())
    want = []
    for i, t, _ in edge_texts():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((i is not None, i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe_automaton.encode_decode(frame(spark).limit(0), path, output="ids").count() == 0


def test_token_counts_fill_and_use_the_cache(spark):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), f"{shared_dir(spark)}/counts"
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((i is not None, i or 0, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t, _ in edge_texts()))
    for _ in range(2):
        rows = token_counts.count_tokens(frame(spark), path, cache, limit=100).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
        assert spark.read.parquet(cache).count() == len({t or "" for _, t, _ in edge_texts()})
    token_counts.count_tokens(frame(spark, [(1, "new text", "a"), (2, "", "a")]), path, cache).collect()
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, _ in edge_texts()}) + 1
    assert token_counts.count_tokens(frame(spark).limit(0), path).count() == 0


@pytest.mark.parametrize("size", [1, 3, 100])
def test_kept_is_bounded_and_right(size):
    table = Kept(size, lambda k: k * 2)
    assert [table[i % 7] for i in range(50)] == [i % 7 * 2 for i in range(50)]
    assert len(table) <= size + 1 and len(table.old) <= size + 1
