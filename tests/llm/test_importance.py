import collections
import hashlib
import math
import re
import zlib

import pytest
from llm_cases import edge_texts, frame, prose

from keyloom.llm import importance

SEPARATORS = "[" + "".join(re.escape(chr(c)) for c in range(128) if not (chr(c).isdigit() or chr(c).islower())) + "]+"


def brute_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(SEPARATORS, low) if w]
    return len(words), [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, buckets=10000):
    def count(texts):
        return collections.Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in brute_features(t)[1])
    s, t = count(d[1] for d in docs), count(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, text, *_ in docs:
        n, own = brute_features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[:5 * len(fit) // 100])}
    return sorted(str((*r[:4], rank.get(id(r)))) for r in rows)


def got(docs, target, **options):
    return sorted(str(tuple(r)) for r in importance.resample(docs, target, **options).collect())


def benchmark(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "item_id long, text string, doc_id int, buckets string")


def test_equals_brute_force(spark):
    docs = edge_texts() + [(1000 + i, prose(i, 5 + i % 90), "s") for i in range(400)] + [(500, prose(7, 25), "s")] * 3
    target = [prose(i, 12) for i in range(30)] + [None, "", "é漢字 ONE-two_3", prose(5, 40)]
    want = brute(docs, target)
    assert got(frame(spark, docs).repartition(6), benchmark(spark, target)) == want
    assert sum(not r.endswith("None)") for r in want) >= 15
    assert got(frame(spark, docs[:40]), benchmark(spark, target), buckets=100_000) == brute(docs[:40], target, 100_000)


def test_without_target_or_documents(spark):
    docs = [(i, prose(i, 30), "s") for i in range(45)]
    assert got(frame(spark, docs), benchmark(spark, ["x"]).limit(0)) == brute(docs, [])
    assert importance.resample(frame(spark).limit(0), benchmark(spark, ["x"])).count() == 0


@pytest.mark.parametrize("text", ["", "one", "One  TWO", " a_b-C.d\n\te 9 ", "İ ß ſ K x\x7fy\x80z  w", "x" * 70000, "a " * 5000])
def test_spans_are_all_ngrams(text):
    words, values = importance.features(text.encode())
    n, own = brute_features(text)
    assert words == n and sorted(values.tolist()) == sorted(zlib.crc32(f.encode()) for f in own)
