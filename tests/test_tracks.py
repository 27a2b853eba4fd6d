"""Golden values, planted knots and brute-force twins for the track operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.operators import events as E
from keyloom.operators import simplify as S
from keyloom.operators import tracks as T


def sampled(spark, tracks, frames, **kw):
    """``tracks`` maps a name to (frame, interp, value) keys; returns {name: {frame: value}}."""
    k = spark.createDataFrame([(n, f, i, [float(v)]) for n, keys in tracks.items() for f, i, v in keys],
                              "u string, frame int, interp string, value array<double>")
    f = spark.createDataFrame([(n, f) for n in tracks for f in frames], "u string, frame int")
    out = {}
    for r in T.sample_track(k, f, ["u"], **kw).collect():
        out.setdefault(r["u"], {})[r["frame"]] = r["value"][0]
    return out


def test_sampling_golden_values(spark):
    ramp, asym = [(0, 0), (10, 10), (20, 0), (30, 10)], [(0, 0), (10, 10), (20, 12), (30, 40)]
    with_mode = lambda keys, m: [(f, m, v) for f, v in keys]
    got = sampled(spark, {
        "lin": with_mode(ramp, "linear"), "hold": with_mode(ramp, "hold"), "cr": with_mode(ramp, "catmullrom"),
        "asym": with_mode(asym, "catmullrom"), "asym_lin": with_mode(asym, "linear"),
        "mix": [(0, "hold", 0), (10, "linear", 10), (20, "linear", 20)], "one": [(4, "linear", 7)]},
        [-50, 0, 5, 9, 10, 15, 20, 25, 999], size=8)
    pick = lambda n, *fs: [got[n][f] for f in fs]
    assert pick("lin", -50, 5, 10, 999) == [0.0, 5.0, 10.0, 10.0]
    assert pick("hold", 9, 10) == [0.0, 10.0]
    assert pick("cr", 5, 25) == [5.625, 4.375]
    assert pick("asym", 15, 20) == [9.875, 12.0] and pick("asym_lin", 15) == [11.0]
    assert pick("mix", 5, 15) == [0.0, 15.0]
    assert pick("one", 0, 9) == [7.0, 7.0]


@pytest.mark.parametrize("kind", ["boxcar", "savgol"])
def test_smoothing_against_numpy(spark, kind):
    rng = np.random.default_rng(3)
    v = {n: rng.normal(size=n) for n in (2, 5, 6, 40)}
    df = spark.createDataFrame([(n, i, float(x)) for n, xs in v.items() for i, x in enumerate(xs)], "u int, frame int, v double")
    out = {}
    for r in T.smooth(df, ["u"], ["v"], 9, kind, size=16).collect():
        out.setdefault(r["u"], {})[r["frame"]] = r["v"]
    for n, xs in v.items():
        w = min(9, n if n % 2 else n - 1)
        got = np.array([out[n][i] for i in range(n)])
        if n < 3:
            want = xs
        elif kind == "boxcar":
            pad = np.r_[[xs[0]] * (w // 2), xs, [xs[-1]] * (w // 2)]
            want = np.convolve(pad, np.ones(w) / w, "valid")
        else:
            want = np.array([np.polyval(np.polyfit(np.arange(w), xs[s:s + w], min(2, w - 1)), i - s)
                             for i in range(n) for s in [min(max(i - w // 2, 0), n - w)]])
        assert np.allclose(got, want, atol=1e-9)


def tracks_df(spark, tracks):
    return spark.createDataFrame(
        [(n, i, i, [float(c) for c in p.ravel()]) for n, t in tracks.items() for i, p in enumerate(t)],
        "u string, pos int, frame int, pts array<double>")


def planted(knots, t, seed=0, points=12):
    rng = np.random.default_rng(seed)
    at = rng.normal(scale=40, size=(len(knots), points, 2))
    return np.stack([[[np.interp(f, knots, at[:, p, c]) for c in (0, 1)] for p in range(points)] for f in range(t)])


def chosen(df, by="u"):
    out = {}
    for r in df.collect():
        out.setdefault(r[by], []).append(r["frame"])
    return {k: sorted(v) for k, v in out.items()}


def test_planted_knots_come_back(spark):
    want = {"a": ([0, 17, 40, 41, 88, 119], 120), "b": ([0, 30, 60], 61), "c": ([0, 5, 6, 7, 50], 51)}
    df = tracks_df(spark, {n: planted(k, t) for n, (k, t) in want.items()})
    got = S.simplify(df, ["u"], 0.5)
    assert chosen(got) == {n: k for n, (k, _) in want.items()}
    assert {r["u"]: r["method"] for r in got.collect()} == {"a": "greedy", "b": "dp", "c": "dp"}


def test_static_and_monotone(spark):
    rng = np.random.default_rng(5)
    df = tracks_df(spark, {"s": np.ones((50, 2, 2)), "n": rng.normal(scale=.4, size=(50, 3, 2))})
    counts = []
    for tol in (.5, 1, 2, 4):
        got = chosen(S.simplify(df, ["u"], tol))
        assert got["s"] == [0, 49]
        counts.append(len(got["n"]))
    assert counts == sorted(counts, reverse=True)


def test_long_track_path_equals_single_group(spark):
    rng = np.random.default_rng(6)
    walk = np.cumsum(rng.normal(size=(400, 1, 2)), axis=0)
    flat = np.concatenate([np.zeros((150, 1, 2)), walk[:100], np.repeat(walk[99:100], 80, axis=0)])
    df = tracks_df(spark, {"w": walk, "f": flat})
    whole = chosen(S.simplify(df, ["u"], 1.5))
    assert chosen(S.simplify(df, ["u"], 1.5, chunk=32, limit=64)) == whole
    sel = {r["u"]: r for r in S.selection(df, S.simplify(df, ["u"], 1.5), ["u"], size=64).collect()}
    for n, t in (("w", walk), ("f", flat)):
        ks = whole[n]
        worst = max(S.chord_error(t, None, a, b) for a, b in zip(ks, ks[1:]))
        assert abs(sel[n]["max_error"] - worst) < 1e-9 and worst <= 1.5


def test_refit_against_dense_least_squares(spark):
    rng = np.random.default_rng(7)
    y = rng.normal(size=90)
    frames, modes = [3, 10, 11, 30, 55, 80], ["linear", "catmullrom", "hold", "catmullrom", "linear", "linear"]
    raw = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(y)], "u string, frame int, value double")
    keys = spark.createDataFrame([("t", f, m) for f, m in zip(frames, modes)], "u string, frame int, interp string")
    units = {str(j): [(f, m, float(i == j)) for i, (f, m) in enumerate(zip(frames, modes))] for j in range(len(frames))}
    basis = sampled(spark, units, range(90))
    cols = [[basis[str(j)][f] for f in range(90)] for j in range(len(frames))]
    want = np.linalg.lstsq(np.array(cols).T, y, rcond=None)[0]
    got = [r["value"] for r in S.refit(raw, keys, ["u"]).orderBy("kidx").collect()]
    assert np.allclose(got, want, atol=1e-9)


def test_refit_chunks_agree(spark):
    rng = np.random.default_rng(8)
    raw = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(rng.normal(size=600))], "u string, frame int, value double")
    keys = spark.createDataFrame([("t", f, "linear") for f in range(0, 600, 4)], "u string, frame int, interp string")
    one = [r["value"] for r in S.refit(raw, keys, ["u"]).orderBy("kidx").collect()]
    many = [r["value"] for r in S.refit(raw, keys, ["u"], chunk=20).orderBy("kidx").collect()]
    assert np.allclose(one, many, atol=1e-9)


def brute_f1(p, t, tol):
    pairs = sorted((abs(a - b), i, j) for i, a in enumerate(p) for j, b in enumerate(t) if abs(a - b) <= tol)
    ps, ts = set(), set()
    for _, i, j in pairs:
        if i not in ps and j not in ts:
            ps.add(i)
            ts.add(j)
    return len(ps)


@pytest.mark.parametrize("tol", [0, 1, 2, 3])
def test_matching_against_brute_force(spark, tol):
    rng = np.random.default_rng(tol)
    sets = {u: (sorted(rng.choice(60, rng.integers(0, 40), replace=False).tolist()),
                sorted(rng.choice(60, rng.integers(0, 40), replace=False).tolist())) for u in range(25)}
    mk = lambda k: spark.createDataFrame([(u, int(f)) for u, s in sets.items() for f in s[k]], "u int, frame int").repartition(5)
    got = {r["u"]: r["hits"] for r in E.match_events(mk(0), mk(1), ["u"], tol, size=16).collect()}
    assert got == {u: brute_f1(p, t, tol) for u, (p, t) in sets.items() if p or t}


def test_matching_conventions(spark):
    tracks = spark.createDataFrame([("none",), ("only_p",), ("only_t",), ("two",)], "u string")
    p = spark.createDataFrame([("only_p", 1), ("two", 10), ("two", 11)], "u string, frame int")
    t = spark.createDataFrame([("only_t", 1), ("two", 10)], "u string, frame int")
    got = {r["u"]: (r["precision"], r["recall"], r["f1"]) for r in E.match_events(p, t, ["u"], 1, tracks).collect()}
    assert got["none"] == (1, 1, 1) and got["only_p"] == (0, 1, 0) and got["only_t"] == (1, 0, 0)
    assert got["two"][:2] == (0.5, 1.0)


def test_random_keys_have_the_asked_size(spark):
    live = spark.createDataFrame([(u, f, True) for u in range(3) for f in range(50)], "u int, frame int, live boolean")
    n = spark.createDataFrame([(0, 5), (1, 50), (2, 99)], "u int, n int")
    got = {r["u"]: r["count"] for r in E.random_keys(live, n, ["u"], 7).groupBy("u").count().collect()}
    assert got == {0: 5, 1: 50, 2: 50}


def test_context_window_refuses_gaps(spark):
    ok = spark.createDataFrame([("a", i, float(i)) for i in range(4)], "u string, frame int, v double")
    got = T.context_window(ok, ["u"], "v", 3).orderBy("frame").collect()
    assert [tuple(r)[2:] for r in got] == [(0, 0, 1), (0, 1, 2), (1, 2, 3), (2, 3, 3)]
    bad = spark.createDataFrame([("a", 0, 0.0), ("a", 2, 1.0)], "u string, frame int, v double")
    with pytest.raises(Exception, match="not contiguous"):
        T.context_window(bad, ["u"], "v", 3).collect()
