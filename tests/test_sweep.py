"""Threshold sweeps against decoding every cell of the grid by hand, for any cut of the tracks."""

import numpy as np
import pytest

from keyloom.operators import pipelines as P

GRID = [(on, off, gap) for on in (0.3, 0.6, 0.9) for off in (0.1, 0.3, 0.6) for gap in (0, 1, 2, 4, 30)]


def brute(tracks, on, off, gap):
    total = dict(cells=0, same=0, fp=0, fn=0, turns=0, truth_turns=0)
    for rows in tracks.values():
        rows = sorted(rows)
        live, state = [], False
        for _, p, _ in rows:
            state = True if p is not None and p > on else False if p is not None and p <= off else state
            live.append(state)
        at = [i for i, x in enumerate(live) if x]
        for i, j in zip(at, at[1:]):
            if gap > 1 and rows[j][0] - rows[i][0] - 1 < gap:
                live[i:j] = [True] * (j - i)
        truth = [t for *_, t in rows]
        total["cells"] += len(rows)
        total["same"] += sum(a == b for a, b in zip(live, truth))
        total["fp"] += sum(a and not b for a, b in zip(live, truth))
        total["fn"] += sum(b and not a for a, b in zip(live, truth))
        total["turns"] += sum(a != b for a, b in zip(live, live[1:]))
        total["truth_turns"] += sum(a != b for a, b in zip(truth, truth[1:]))
    n = total["cells"]
    return total["same"] / n, total["fp"] / n, total["fn"] / n, total["turns"] / max(1, total["truth_turns"])


@pytest.mark.parametrize("size", [1, 3, 10, 65536])
def test_every_cell_of_the_grid(spark, size):
    rng = np.random.default_rng(2)
    tracks = {}
    for u in range(12):
        frames = np.sort(rng.choice(120, rng.integers(1, 80), replace=False)) + (50 if u % 2 else 0)
        p = rng.choice([0.05, 0.1, 0.2, 0.3, 0.5, 0.6, 0.95], len(frames)) if u else np.full(len(frames), 0.2)
        tracks[f"t{u}"] = [(int(f), None if u == 3 and i % 5 == 0 else float(x), bool(t)) for i, (f, x, t) in enumerate(zip(frames, p, rng.random(len(frames)) < .4))]
    df = spark.createDataFrame([(u, *r) for u, rows in tracks.items() for r in rows], "u string, frame int, p double, truth boolean")
    got = {(r.on, r.off, r.gap): r for r in P.sweep(df, ["u"], spark.createDataFrame(GRID, "on double, off double, gap int"), size=size).collect()}
    assert set(got) == {g for g in GRID if g[1] <= g[0]}
    for g, r in got.items():
        assert np.allclose([r.accuracy, r.fp_rate, r.fn_rate, r.transition_ratio], brute(tracks, *g)), (g, size)


def test_the_plan_does_not_grow_with_the_grid(spark):
    df = spark.createDataFrame([("a", 0, 0.5, True)], "u string, frame int, p double, truth boolean")
    wide = [(on / 10, off / 10, gap) for on in range(10) for off in range(10) for gap in range(10)]
    plans = [len(P.sweep(df, ["u"], spark.createDataFrame(g, "on double, off double, gap int"))._jdf.queryExecution().executedPlan().toString())
             for g in (GRID[:2], wide)]
    assert abs(plans[0] - plans[1]) < 2000
    assert P.sweep(df.limit(0), ["u"], spark.createDataFrame(GRID, "on double, off double, gap int")).count() == 0
    assert P.sweep(df, ["u"], spark.createDataFrame([(0.1, 0.5, 1)], "on double, off double, gap int")).count() == 0
