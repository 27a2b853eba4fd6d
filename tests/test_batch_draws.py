"""Batches of distinct positions: any subset of a pool can come up, about equally often."""

import collections
import itertools

import pytest

from keyloom.operators import splits as S


def schedule(spark, n, batch, mode, steps):
    el = spark.createDataFrame([(0, n, 1.0)], "element_id long, n_frames int, weight double")
    frames = spark.createDataFrame([(0, i, i) for i in range(n)], "element_id long, frame int, pos int")
    out = collections.defaultdict(list)
    for r in S.batch_schedule(spark.range(steps).withColumnRenamed("id", "step"), el, frames, batch, mode, 3).collect():
        out[r.step].append(r.frame)
    assert len(out) == steps
    return out


@pytest.mark.parametrize("n, batch", [(8, 3), (7, 4), (5, 5), (1, 3)])
def test_every_subset_comes_up(spark, n, batch):
    k = min(n, batch)
    subsets = list(itertools.combinations(range(n), k))
    got = collections.Counter(tuple(sorted(v)) for v in schedule(spark, n, batch, "random", 40 * len(subsets)).values())
    assert set(got) == set(subsets)
    assert sum((c - 40) ** 2 / 40 for c in got.values()) < 2 * len(subsets)  # chi-square, about as many as subsets by chance


def test_pairs_draw_any_anchors(spark):
    got = {tuple(sorted(v)[::2]) if len(set(v)) == 4 else None for v in schedule(spark, 8, 4, "pairs", 1500).values()}
    anchors = {t for t in itertools.combinations(range(7), 2) if t[1] > t[0] + 1}
    assert got - {None} == anchors


def test_runs_stay_contiguous(spark):
    runs = {tuple(sorted(v)) for v in schedule(spark, 8, 3, "runs", 400).values()}
    assert runs == {(i, i + 1, i + 2) for i in range(6)}
