import collections
import hashlib
import math
import random

import numpy as np
import pytest

from keyloom.llm import vector_codes
from keyloom.llm.shared import attach

KIND = "vec_id long, embedding array<double>, label int, error long, code string, part int, _key int, n int, fact int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "c", 2, 3, 4, 5) for i, v, y in rows], KIND)


def vectors(n, seed=1, size=1.0, dim=64):
    r = random.Random(seed)
    return [(i, [r.uniform(-size, size) for _ in range(dim)], r.choice([0, 1, 2, None])) for i in range(n)]


def brute(rows, entries=64, rounds=2, parts=16, scale=256):
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = [[[math.floor(scale * x) for x in v[p * width:(p + 1) * width]] for p in range(parts)] for _, v, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for c in cut:
                own[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(own[e]) for col in zip(*own[e])] if e in own else b for e, b in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    total = collections.Counter()
    for (_, _, y), f in zip(rows, found):
        total[y] += sum(d for d, _ in f)
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(str((i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), total[y], name)) for (i, _, y), f in zip(rows, found))


def got(df, **options):
    return sorted(str(tuple(r)) for r in vector_codes.encode(df, **options).collect())


def test_equals_brute_force(spark):
    rows = vectors(150)
    rows += [(rows[3][0], rows[9][1], 1), (None, rows[4][1], None), (70, rows[5][1], 2), (71, rows[5][1], 2)]
    bad = [(1000, None, 1), (1001, [], 1), (1002, [None] * 64, 1), (1003, [float("nan")] + [0.0] * 63, 1),
           (-5, [0.0] * 63 + [float("inf")], None), (-6, [0.0] * 63 + [None], 0)]
    assert got(table(spark, rows + bad).repartition(4)) == brute(rows + bad)


def test_large_integers_take_several_limbs(spark):
    rows = vectors(80, 2, 500_000.0)
    assert got(table(spark, rows)) == brute(rows)


def test_few_rows_ties_and_other_lengths(spark):
    same = [(i, [0.25, -0.125] * 16, 1) for i in range(5)]
    other = [(2, [1.0] * 16, 1), (3, [1.0] * 17, 1), (4, [2.0 ** 19] + [0.0] * 31, 1)]
    assert got(table(spark, same + other)) == brute(same)
    assert got(table(spark, vectors(9, 3, dim=32)), entries=4, rounds=3) == brute(vectors(9, 3, dim=32), 4, 3)
    assert vector_codes.encode(table(spark, same).limit(0)).count() == 0


@pytest.mark.parametrize("size", [10, 1 << 25, 1 << 27])
def test_products_are_exact(size):
    r = np.random.default_rng(size)
    x, c = r.integers(-size, size + 1, (3, 50, 4)), r.integers(-size, size + 1, (3, 7, 4))
    want = np.array([[[sum(int(a) * int(b) for a, b in zip(u, v)) for v in cs] for u in xs] for xs, cs in zip(x, c)])
    assert (vector_codes.products(x, c) == want).all()


def test_attach_splits_hot_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 50 if i % 3 == 1 else i) for i in range(6000)], "i long, k long")
    facts = rows.groupBy("k").count().selectExpr("k", "count AS n", "k * 2 AS twice")
    found = attach(rows, facts.where("k IS NULL OR k % 7 <> 0"), "k").collect()
    assert len(found) == 6000
    for r in found:
        assert (r.fact is None) == (r.k is not None and r.k % 7 == 0)
        assert r.fact is None or r.fact.k == r.k and r.fact.twice == (None if r.k is None else 2 * r.k)
