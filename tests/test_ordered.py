"""The chunked primitives give the same answer whatever the chunk size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keyloom.functions.distribution import exact_quantiles, mode_of
from keyloom.functions.ordered import chunk_id, last_known, positions, running_sum, stencil, with_totals
from keyloom.operators import lifespans as L


@pytest.fixture(scope="module")
def track(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame([(u, f, float(np.round(rng.random(), 3)), bool(rng.random() < 0.5))
                        for u in range(4) for f in range(60 if u else 1)], columns=["u", "frame", "p", "live"])
    return pdf, spark.createDataFrame(pdf).repartition(3)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_last_known_and_running_sum_do_not_depend_on_chunks(track):
    _, df = track
    mark = {"m": F.when(F.col("live"), F.col("frame"))}
    for kw in ({}, {"inclusive": False}, {"backward": True}):
        assert rows(last_known(df, ["u"], "frame", mark, 7, **kw), "u", "frame", "m") == \
            rows(last_known(df, ["u"], "frame", mark, 1000, **kw), "u", "frame", "m")
    small = running_sum(df, ["u"], ["frame"], chunk_id("frame", 7), {"s": F.lit(1)}, totals=True)
    assert all(r["s"] == r["frame"] + 1 and r["s_total"] == (60 if r["u"] else 1) for r in small.collect())


def test_positions_and_totals(track):
    _, df = track
    out = positions(df, ["u"], ["frame"], F.floor(F.col("frame") / 5), "pos")
    assert all(r["pos"] == r["frame"] for r in out.collect())
    tot = with_totals(df, ["u"], {"n": ("count", F.lit(1)), "hi": ("max", F.col("frame"))}, F.col("frame") % 3)
    assert all(r["n"] == r["hi"] + 1 for r in tot.collect())


def test_stencil_matches_plain_window(track):
    _, df = track
    e = {"a": lambda w: F.lag("p", 2).over(w), "b": lambda w: F.lead("p", 3).over(w)}
    assert rows(stencil(df, ["u"], "frame", e, 3, 5).na.fill(-1.0), "u", "frame", "a", "b") == \
        rows(stencil(df, ["u"], "frame", e, 3, 10**6).na.fill(-1.0), "u", "frame", "a", "b")


@pytest.mark.parametrize("on,off,want", [(.5, .2, [1, 1, 1, 1, 1]), (.5, .5, [1, 1, 0, 1, 1])])
def test_hysteresis_examples(spark, on, off, want):
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate([.9, .9, .3, .9, .9])], "u int, frame int, p double")
    got = L.hysteresis(df, ["u"], "p", on, off, size=2).orderBy("frame").collect()
    assert [int(r["live"]) for r in got] == want


def test_hysteresis_refuses_and_holds(spark, track):
    pdf, df = track
    with pytest.raises(ValueError):
        L.hysteresis(df, ["u"], "p", 0.2, 0.5)
    got = {(r["u"], r["frame"]): r["state"] for r in L.hysteresis(df, ["u"], "p", .7, .4, name="state", size=9).collect()}
    for u, g in pdf.sort_values("frame").groupby("u"):
        state = False
        for f, p in zip(g.frame, g.p):
            state = True if p > .7 else False if p <= .4 else state
            assert got[(u, f)] == state


def test_close_gaps_islands_keys_against_loops(track):
    pdf, df = track
    closed = {(r["u"], r["frame"]): r["closed"] for r in L.close_gaps(df, ["u"], 3, size=8).collect()}
    runs = {}
    for u, g in pdf.sort_values("frame").groupby("u"):
        live = g.live.tolist()
        want, i = list(live), 0
        while i < len(live):
            j = i
            while j < len(live) and live[j] == live[i]:
                j += 1
            if live[i]:
                runs.setdefault(u, []).append((i, j - 1))
            elif i > 0 and j < len(live) and j - i < 3:
                want[i:j] = [True] * (j - i)
            i = j
        assert [closed[(u, f)] for f in range(len(live))] == want
    got = {}
    for r in L.islands(df, ["u"], size=8).collect():
        got.setdefault(r["u"], []).append((r["start"], r["end"]))
    assert {u: sorted(v) for u, v in got.items()} == runs


def test_mask_to_keys_special_cases(spark):
    rows_ = [("on", f, True) for f in range(4)] + [("off", f, False) for f in range(4)] + \
        [("late", f, f >= 2) for f in range(4)] + [("early", f, f < 2) for f in range(4)]
    df = spark.createDataFrame(rows_, "u string, frame int, live boolean")
    keys = {}
    for r in L.mask_to_keys(df, ["u"], size=2).collect():
        keys.setdefault(r["u"], []).append((r["frame"], r["value"]))
    assert {k: sorted(v) for k, v in keys.items()} == {
        "off": [(0, 0.0)], "late": [(0, 0.0), (2, 100.0)], "early": [(0, 100.0), (2, 0.0)]}


def test_noise_is_exact_capped_and_one_sided(track):
    pdf, df = track
    out = L.noisy_mask(df, ["u"], 0.1, "fp", 3, ["u", "frame"]).collect()
    for u, g in pdf.groupby("u"):
        flipped = [r for r in out if r["u"] == u and r["live"] != r["noisy"]]
        assert len(flipped) == min(round(0.1 * len(g)), int((~g.live).sum()))
        assert all(r["noisy"] for r in flipped)


def test_exact_quantiles_and_mode(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 700), "v": np.round(rng.exponential(5, 700), 1)})
    q = {"q05": .05, "q50": .5, "q95": .95}
    got = {r["g"]: r for r in exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", q, buckets=16).collect()}
    for g, v in pdf.groupby("g").v:
        for n, p in q.items():
            assert abs(got[g][n] - np.percentile(v, p * 100)) < 1e-9
    modes = {r["g"]: r["mode"] for r in mode_of(spark.createDataFrame(pdf), ["g"], "v").collect()}
    assert modes == {g: v.mode().min() for g, v in pdf.groupby("g").v}
