import collections
import hashlib
import math
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from llm_cases import edge_texts, frame, prose

from keyloom.llm import line_dedup, mixing, near_dups, quality_rules, segment_topk, shingles
from keyloom.llm.components import components

WHITE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_lines(texts):
    """(doc_id, n_lines, n_dropped, kept text) per row."""
    holders = collections.defaultdict(set)
    key = lambda line: lower(line.strip(WHITE))
    for i, t, *_ in texts:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for i, t, *_ in texts:
        own = (t or "").split("\n")
        stay = [x for x in own if i is None or len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        out.append((i, len(own), len(own) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("bits", [1 << 16, 1 << 20])
def test_line_dedup(spark, bits):
    rows = line_dedup.drop_lines(frame(spark), filter_bits=bits).collect()
    got = sorted((str(r.doc.doc_id), r.n_lines, r.n_dropped, r.kept_sha256, r.kept or "") for r in rows)
    want = sorted((str(i), n, d, hashlib.sha256(t.encode()).hexdigest(), t) for i, n, d, t in brute_lines(edge_texts()))
    assert got == want
    assert sum(r.n_dropped for r in rows) > 4
    assert line_dedup.drop_lines(frame(spark).limit(0), filter_bits=bits).count() == 0


def test_filters_know_every_repeat():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 3000, np.uint64)
    own = line_dedup.Filters(1 << 16)
    own.add(h)
    own.add(h[:500])
    word, mask = line_dedup.place(h, own.words)
    hit = own.twice[word] & mask == mask
    assert hit[:500].all() and hit[500:].mean() < 0.6


def brute_mix(texts):
    size = lambda t: len([w for w in re.split(f"[{WHITE}]+", t or "") if w])
    total = collections.Counter()
    for _, t, s in texts:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * total[s] if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if target[s] > 3 * total[s]}
        if not over:
            return size, total, target
        capped |= over


def test_mixing(spark):
    texts = edge_texts() + [(1000 + i, prose(i, 5 + i % 90), "xyz"[i % 3]) for i in range(300)]
    size, total, target = brute_mix(texts)
    rows = mixing.mix(frame(spark, texts)).collect()
    again = mixing.mix(frame(spark, texts[::-1])).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    source = collections.defaultdict(list)
    for i, t, s in texts:
        source[i, size(t)].append(s)
    taken, most = collections.Counter(), collections.Counter()
    for r in rows:
        s = next(s for s in source[r.doc_id, r["size"]] if total[s] == r.source_size)
        assert math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-9) and r.taken <= 3 * r["size"]
        taken[s] += r.taken
        most[s] = max(most[s], r["size"])
    for s in total:
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1
    out = mixing.expand(frame(spark, texts))
    assert out.columns == frame(spark, texts).columns
    assert out.count() == sum(r.repeats for r in rows)
    assert mixing.mix(frame(spark).limit(0)).count() == 0


def test_mixing_equals_its_sql(spark):
    texts = [(i, prose(i, 3 + i % 40), "abcdefg"[i % 7]) for i in range(200)]
    documents = pd.DataFrame(texts, columns=["doc_id", "text", "source"])  # noqa: F841
    want = duckdb.sql(mixing.ORACLE).fetchall()
    got = [(r.doc_id, r["size"], r.source_size, r.target, r.taken, r.repeats) for r in mixing.mix(frame(spark, texts)).collect()]
    assert sorted(got) == sorted(want)


def brute_base(text):
    words = [w for w in re.split(f"[{WHITE}]+", text) if w]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    mark = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            mark |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(mark))


def test_quality_rules(spark):
    texts = edge_texts() + [(1000 + i, prose(i, 60 + i), "s") for i in range(40)]
    texts += [(2000, " | ".join(prose(7, 200).split()), "s"), (2001, "%%% ".join(prose(8, 200).split()), "s"),
              (2002, " a b c" * 40, "s"), (2003, " ".join(prose(9, 80).upper().split()), "s")]
    rows = quality_rules.judge(frame(spark, texts)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted((str(r.doc.doc_id), *(r[n] for n in names)) for r in rows)
    assert got == sorted((str(i), *brute_base(t or "")) for i, t, _ in texts)
    kept = {r.doc.doc_id: r.kept for r in rows if r.doc.doc_id is not None}
    assert all(kept[1000 + i] for i in range(40)) and not any(kept[i] for i in (1, 2, 3, 7, 2000, 2001, 2002, 2003))
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    # Verdicts against distances computed here from the same references.
    again = {str(r.doc): (r.char_distance, r.word_distance) for r in quality_rules.judge(frame(spark, texts[::-1])).collect()}
    assert again == {str(r.doc): (r.char_distance, r.word_distance) for r in rows}
    assert quality_rules.judge(frame(spark).limit(0)).count() == 0


def test_jensen_shannon_distance():
    assert quality_rules.distance(np.array([1, 0]), np.array([0, 1])) == 1.0
    assert quality_rules.distance(np.array([3, 1]), np.array([6, 2])) == 0.0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 24)], 1) for i in range(300)]
    rows += [(400 + i, [0.5] * 24, 2) for i in range(70)] + [(500, None, 0), (520, [None] * 24, 0), (540, [float("nan")] * 24, 0),
             (560, [float("inf")] * 24, 0), (580, [], 0), (None, [0.1] * 24, 0), (600, [0.1, 0.2], 0), (620, [0.3, 0.2], 0),
             (7, rows[7][1], 3), (40, rows[40][1], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS block", "2 AS id", "3 AS score")
    got = sorted(tuple(r) for r in segment_topk.top_k(df, df.vec_id % 20 == 0, block=64, query_block=4).collect())
    use = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows
           if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want, asked = [], set()
    for i, v in use:
        if i % 20 or i in asked:
            continue
        asked.add(i)
        scores = sorted(((-int(v @ w), j) for j, w in use if j != i and len(w) == len(v)))[:20]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert got == sorted(want)
    assert segment_topk.top_k(df.limit(0), df.vec_id % 20 == 0).count() == 0


def test_top_k_beyond_exact_floats():
    big = np.array([[2.0 ** 40, 1.0], [2.0 ** 40, 2.0], [2.0 ** 40, 3.0]])
    [(_, ids, scores)] = segment_topk.search(np.array([9]), np.array([[2.0 ** 20, 1.0]]), np.array([3, 2, 1]), big, 2)
    assert ids.tolist() == [1, 2] and scores == [2 ** 60 + 3, 2 ** 60 + 2]


def brute_components(texts):
    sets = {}
    for i, t, *_ in texts:
        words = [w for w in re.split(f"[{WHITE}]+", lower(t or "")) if w]
        sets.setdefault(i, []).append({tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    least = {i: i for i in sets if i is not None}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    items = [(i, s) for i, all_sets in sets.items() if i is not None for s in all_sets]
    for a, (i, s) in enumerate(items):
        for j, t in items[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                least[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in least}


def near_texts():
    base = prose(50, 120).split()
    out = edge_texts() + [(5, prose(51, 90), "b")]
    for k in range(120):  # copies that drift away from the base; many are linked through others only
        words = list(base)
        for e in range(k // 8):
            words[(k * 31 + e * 17) % 120] = f"edit{k}x{e % 3}"
        out.append((3000 + (k * 37) % 120, " ".join(words), "s"))
    chain = prose(60, 150).split()
    for k in range(12):  # each near the next one only
        out.append((5000 - k, " ".join(chain[k * 5:k * 5 + 90]), "s"))
    return out


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    texts = near_texts()
    sets, want = brute_components(texts)
    rows = near_dups.near_duplicates(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in rows) == collections.Counter(
        (i, len(s)) for i, all_sets in sets.items() for s in all_sets)
    for r in rows:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)


def test_near_duplicates_of_nothing(spark):
    assert near_dups.near_duplicates(frame(spark).limit(0)).count() == 0


def test_bounds_hold_their_miss_probability():
    for m, k in shingles.least_matches(0.75, 1e-5):
        tail = sum(math.comb(m + 1, i) * 0.75 ** i * 0.25 ** (m + 1 - i) for i in range(k))
        assert tail < 1e-5 and k < 0.75 * m


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            least[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in list(least)}
