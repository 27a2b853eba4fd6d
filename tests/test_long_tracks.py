"""Long tracks: greedy walks, partitioned refits, strokes and smoothing at sizes where the plan matters."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.operators import coverage as C
from keyloom.operators import refit as R
from keyloom.operators import simplify as S
from keyloom.operators import tracks as T


def brute_knots(pts, scale, budget, patience=8):
    """The greedy rule itself, on every pair."""
    knots, n = [0], len(pts)
    while knots[-1] < n - 1:
        a, best, misses = knots[-1], knots[-1] + 1, 0
        for b in range(a + 1, n):
            ok = S.chord_error(pts, scale, a, b) <= budget
            best, misses = (b, 0) if ok else (best, misses + 1)
            if misses >= patience:
                break
        knots.append(best)
    return knots


def walked(pts, scale, budget, cuts=(), patience=8):
    walk, at = S.Walk(budget, patience), np.arange(len(pts))
    rows = S.Rows(at, at * 3, pts, scale)
    for lo, hi in zip([0, *cuts], [*cuts, len(pts)]):
        walk = S.Walk.resumed(walk.state())  # as between two rounds
        walk.feed(rows.take(slice(lo, hi)))
    walk.finish()
    assert [f for _, f in walk.found] == [3 * p for p, _ in walk.found]
    return [p for p, _ in walk.found]


def samples():
    rng = np.random.default_rng(4)
    t = np.arange(500)[:, None, None]
    slow = np.concatenate([np.sin(t / 60) * 30, np.cos(t / 45) * 20], axis=2)
    yield "walk", np.cumsum(rng.normal(size=(400, 2, 2)), axis=0), None, 1.5
    yield "slow", slow, None, 0.8
    yield "slow noisy", slow + rng.normal(scale=.2, size=slow.shape), None, 1.0
    yield "still", np.zeros((600, 1, 2)), None, 0.5
    yield "still noisy", rng.normal(scale=.2, size=(600, 1, 2)), None, 1.0
    yield "line", np.concatenate([t * 0.1, t * 0.0], axis=2), None, 0.0
    yield "one axis", np.concatenate([np.cumsum(rng.normal(size=(500, 1, 1)), axis=0), np.zeros((500, 1, 1))], axis=2), None, 2.0
    yield "own tolerances", slow[:300] + rng.normal(scale=.3, size=(300, 1, 2)), rng.uniform(0.3, 3, 300), 1.0
    yield "whole numbers", rng.integers(0, 3, (300, 1, 2)).astype(float), None, 1.0
    yield "zero scale", slow[:200], np.where(np.arange(200) % 3, 1.0, 0.0), 1.0


@pytest.mark.parametrize("name,pts,scale,budget", list(samples()), ids=lambda v: v if isinstance(v, str) else "")
def test_walk_equals_the_rule(name, pts, scale, budget):
    want = brute_knots(pts, scale, budget)
    assert walked(pts, scale, budget) == want
    assert walked(pts, scale, budget, cuts=(1, 2, 50, 51, 199)) == want


def test_a_still_track_keeps_few_rows():
    walk, n = S.Walk(0.5), 60_000
    at = np.arange(n)
    walk.feed(S.Rows(at, at, np.random.default_rng(0).normal(scale=.05, size=(n, 1, 2)), None))
    walk._forget()
    assert len(walk.bounds) < 300 and len(walk.state()) < 100_000
    walk.finish()
    assert [p for p, _ in walk.found] == [0, n - 1]


def test_a_still_track_of_200000_frames(spark):
    df = spark.range(200_000).selectExpr("'still' AS u", "id AS pos", "id AS frame", "array(5D, sin(id) / 10) AS pts")
    moving = spark.range(9000).selectExpr("'steps' AS u", "id AS pos", "id AS frame", "array(floor(id / 1000) * 10D, 0D) AS pts")
    start = time.time()
    got = {}
    for r in S.simplify(df.unionByName(moving), ["u"], 0.5).collect():
        got.setdefault(r.u, []).append(r.pos)
    assert sorted(got["still"]) == [0, 199_999]
    assert sorted(got["steps"]) == [0, *sorted(k for i in range(1, 9) for k in (1000 * i - 1, 1000 * i)), 8999]
    assert time.time() - start < 120


def test_selection_reports_its_tolerances(spark):
    df = spark.createDataFrame([("a", i, i, [float(i % 7), 0.0], 1 / (1 + i % 3)) for i in range(80)] + [("b", 0, 0, [0.0, 0.0], 5.0)],
                               "u string, pos int, frame int, pts array<double>, inv double")
    got = {r.u: r for r in S.selection(df, S.simplify(df, ["u"], 2.0, "inv"), ["u"], tol=2.0, inv_tol="inv").collect()}
    assert (got["a"].tol_min, got["a"].tol_max) == (1.0, 3.0) and (got["b"].tol_min, got["b"].method) == (2.0, "trivial")


def dense(spark, frames, modes, at, y):
    """Key values by lstsq on the basis of unit keys; frames in ``at`` only."""
    cols = []
    for j in range(len(frames)):
        keys = spark.createDataFrame([(f, m, [float(j == i)]) for i, (f, m) in enumerate(zip(frames, modes))], "frame int, interp string, value array<double>")
        cols.append(keys.withColumn("u", F.lit(j)))
    every = cols[0]
    for c in cols[1:]:
        every = every.unionByName(c)
    asked = spark.createDataFrame([(j, int(f)) for j in range(len(frames)) for f in at], "u int, frame int")
    a = np.zeros((len(at), len(frames)))
    place = {int(f): k for k, f in enumerate(at)}
    for r in T.sample_track(every, asked, ["u"]).collect():
        a[place[r.frame], r.u] = r.value[0]
    return a, np.linalg.lstsq(a, y, rcond=1e-9)[0]


@pytest.mark.parametrize("case", ["mixed", "uneven", "deficient", "all catmullrom", "ends full"])
def test_refit_equals_a_dense_solve(spark, case):
    rng = np.random.default_rng(sum(map(ord, case)))
    n = {"ends full": 28}.get(case, 45)
    step = rng.integers(1, 40, n) if case == "uneven" else np.full(n, 3)
    frames = np.cumsum(step).tolist()
    modes = ["catmullrom"] * n if case == "all catmullrom" else rng.choice(["linear", "hold", "catmullrom"], n).tolist()
    at = np.arange(frames[-1] + 5)
    if case == "deficient":  # no frame near some keys, and a long stretch with one frame between keys and none on them
        modes = ["linear"] * n
        keep = np.ones(len(at), bool)
        keep[frames[4]:frames[7] + 3] = False
        keep[[f for f in frames[12:34]]] = False
        keep[[f + 2 for f in frames[12:34]]] = False
        at = at[keep]
    y = rng.normal(size=len(at))
    a, want = dense(spark, frames, modes, at, y)
    if case == "deficient":
        assert np.linalg.matrix_rank(a) < n
    raw = spark.createDataFrame([("t", int(f), float(v)) for f, v in zip(at, y)], "u string, frame int, value double")
    keys = spark.createDataFrame([("t", f, m) for f, m in zip(frames, modes)], "u string, frame int, interp string")
    for chunk in (7, 512):
        got = [r.value for r in R.refit(raw, keys, ["u"], chunk=chunk).orderBy("kidx").collect()]
        assert np.allclose(got, want, atol=1e-7), chunk
        assert case != "mixed" or R.residual(raw, keys, ["u"], R.refit(raw, keys, ["u"], chunk=7)).first().residual < 1e-9


def brute_stroke(pts, width, height, half, ss):
    out = {}
    for sy in range(height * ss):
        for sx in range(width * ss):
            px, py = (sx + .5) / ss, (sy + .5) / ss
            for (x, y), (x2, y2) in zip(pts, pts[1:]):
                dx, dy = x2 - x, y2 - y
                t = min(max(((px - x) * dx + (py - y) * dy) / max(dx * dx + dy * dy, 1e-18), 0), 1)
                if (px - x - t * dx) ** 2 + (py - y - t * dy) ** 2 <= half * half:
                    out[sy // ss, sx // ss] = out.get((sy // ss, sx // ss), 0) + 1 / ss / ss
                    break
    return out


def test_strokes_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    lines = {0: [(2.0, 3.0), (2.0, 9.0)], 1: [(1.0, 5.0), (14.0, 5.0)], 2: [(4.0, 4.0), (4.0, 4.0)], 3: [(-5.0, -5.0), (30.0, 20.0)], 4: [(3.25, 2.25), (9.75, 2.75), (3.0, 3.0)],
             5: [(0.0, 12.0), (16.0, 0.0)], 6: [(8.0, 6.0)], 7: [(50.0, 50.0), (60.0, 60.0)]}
    lines |= {10 + i: [tuple(p) for p in rng.uniform(-4, 20, (6, 2))] for i in range(12)}
    df = spark.createDataFrame([(k, i, float(x), float(y)) for k, line in lines.items() for i, (x, y) in enumerate(line)], "k int, idx int, x double, y double")
    for band, ss in ((1.5, 2), (4.0, 3)):
        got = {}
        for r in C.stroke_coverage(df, ["k"], 16, 12, band, ss).collect():
            got.setdefault(r.k, {})[r.y, r.x] = r["cov"]
        for k, line in lines.items():
            want = brute_stroke(line, 16, 12, band / 2, ss)
            assert set(got.get(k, {})) == set(want) and all(abs(got[k][p] - want[p]) < 1e-12 for p in want), k


def test_a_long_diagonal_makes_few_rows(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 4000.0, 4000.0)], "k int, idx int, x double, y double")
    px = C.stroke_coverage(df, ["k"], 4000, 4000, 1.5, 2)
    assert 4000 < px.count() < 20_000


@pytest.mark.parametrize("kind", ["boxcar", "savgol"])
def test_smoothing_gathers_no_lists(spark, kind):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(30)], "u string, frame int, v double")
    out = T.smooth(df, ["u"], ["v"], 9, kind)
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    if kind == "savgol":
        assert np.allclose([r.v for r in out.orderBy("frame").collect()], range(30))
