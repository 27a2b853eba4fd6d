"""Roll-ups, splits, coverage, geometry and gates on small hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.operators import coverage as C
from keyloom.operators import geometry as G
from keyloom.operators import quality as Q
from keyloom.operators import scoring as SC
from keyloom.operators import splits as S

ROW = "run string, element_id string, frames int, mean_soft_iou double, min_soft_iou double, mean_iou double, worst_frame int, frames_below_095 int, frames_below_090 int, in_train boolean"


def test_training_blocks(spark):
    rows = spark.createDataFrame([("r", "a", 10, .96, .9, .9, 1, 0, 0, True), ("r", "b", 10, .94, .8, .9, 2, 0, 0, True),
                                  ("r", "c", 10, .21, .1, .2, 3, 9, 9, False), ("q", "a", 5, .5, .4, .5, 1, 5, 5, True)], ROW)
    got = {(r["run"], r["block"]): r for r in SC.by_training_status(rows).collect()}
    assert set(got) == {("r", "trained"), ("r", "held"), ("r", "all"), ("q", "trained")}
    assert abs(got["r", "trained"]["mean_soft_iou"] - .95) < 1e-12 and got["r", "trained"]["headline"]
    assert abs(got["r", "held"]["mean_soft_iou"] - .21) < 1e-12 and got["r", "all"]["worst_element"] == "c"
    nothing = rows.where("element_id = 'c'")
    assert {r["block"]: r["headline"] for r in SC.by_training_status(nothing).collect()} == {"all": True, "held": False}


def test_spread_needs_three_for_sd(spark):
    mk = lambda n: spark.createDataFrame([(f"s{i}", 1.0 + i, None) for i in range(n)], "run string, m double, absent double")
    two, three = (SC.spread(mk(n), ["m", "absent"]).collect() for n in (2, 3))
    assert len(two) == 1 and two[0]["sd"] is None and two[0]["range"] == 1.0
    assert three[0]["sd"] == 1.0


@pytest.mark.parametrize("n,every", [(40, 7), (2, 7), (3, 2), (15, 1), (9, 3)])
def test_frame_split_rule(spark, n, every):
    df = spark.createDataFrame([("a", i) for i in range(n)], "u string, frame int")
    got = [r["frame"] for r in S.frame_split(df, ["u"], every).where("held").orderBy("frame").collect()]
    want = [i for i in range(n) if every > 1 and n > 2 and i % every == every // 2 and 0 < i < n - 1]
    assert got == want
    el = spark.createDataFrame([("a", "s", n)], "element_id string, shot string, n_frames int")
    assert S.build_splits(el, every=every).first()["frames_held"] == len(want)


def test_held_shot_and_unknown(spark):
    el = spark.createDataFrame([("a__x", "a", 9), ("b__y", "b", 9), ("b__z", "b", 9)], "element_id string, shot string, n_frames int")
    got = {r["element_id"]: r["in_train"] for r in S.build_splits(el, ["b"]).collect()}
    assert got == {"a__x": True, "b__y": False, "b__z": False}
    with pytest.raises(ValueError, match="nope"):
        S.build_splits(el, ["nope"])


def test_positive_weight_pins(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (0.5,), (0.2,)], "rate double")
    assert [round(r["pos_weight"], 9) for r in S.positive_weight(df).collect()] == [1, 1, 1, 4]


@pytest.mark.parametrize("mode", S.SAMPLING_MODES)
def test_batch_schedule(spark, mode):
    frames = spark.createDataFrame([(e, f, p) for e in range(3) for p, f in enumerate(f for f in range(30) if f % 7 != 3)],
                                   "element_id long, frame int, pos long")
    el = S.element_weight(frames.groupBy("element_id").agg(F.expr("count(1) AS n_frames"), F.expr("1L AS n_shapes")), "frames")
    steps = spark.range(1, 61).select(F.col("id").alias("step"))
    out = S.batch_schedule(steps, el, frames, 6, mode, 1).collect()
    by = {}
    for r in out:
        by.setdefault((r["step"], r["element_id"]), []).append(r["frame"])
    assert len(by) == 60 and len({s for s, _ in by}) == 60
    pool = {f for f in range(30) if f % 7 != 3}
    for got in by.values():
        assert set(got) <= pool and len(got) == 6
        if mode == "random":
            assert len(set(got)) == 6
        if mode == "pairs":
            assert all(f - 1 in got or f + 1 in got for f in got)
    with pytest.raises(ValueError):
        S.batch_schedule(steps, el, frames, 6, "other", 1)


def test_narrow_slot_bank_is_refused(spark):
    el = spark.createDataFrame([(1, 9)], "element_id int, n_shapes int")
    with pytest.raises(ValueError, match="widest"):
        S.training_rows(None, None, el, 8)


def test_empty_frames_score_one(spark):
    px = "frame int, y int, x int, cov double"
    a = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, .5)], px)
    b = spark.createDataFrame([(0, 0, 0, .5), (1, 0, 0, .2)], px)
    frames = spark.createDataFrame([(0,), (1,), (2,)], "frame int")
    got = {r["frame"]: r["soft_iou"] for r in C.soft_iou(a, b, frames, ["frame"]).collect()}
    assert got == {0: .5 / 1.5, 1: 0.0, 2: 1.0}


def test_accumulate_is_order_sensitive_and_chunk_free(spark):
    rng = np.random.default_rng(4)
    pile = [(0, 0, 0, i, "Subtract" if rng.random() < .5 else "Add", float(np.round(rng.random(), 2))) for i in range(50)]
    df = spark.createDataFrame(pile, "frame int, y int, x int, ord int, blend string, cov double").repartition(4)
    acc = 0.0
    for *_, blend, cov in pile:
        acc = min(max(acc + (-cov if blend == "Subtract" else cov), 0.0), 1.0)
    for size in (3, 1000):
        got = C.accumulate_cov(df, ["frame"], size=size).collect()
        assert abs((got[0]["cov"] if got else 0.0) - acc) < 1e-9


def test_crop_round_trip_and_curve(spark):
    rng = np.random.default_rng(9)
    m = np.eye(4).ravel() + rng.normal(scale=.05, size=16) * np.array([1, 1, 0, 1] * 2 + [0] * 4 + [1, 1, 0, 1])
    df = spark.createDataFrame([(i, float(x), float(y), [float(v) for v in m]) for i, (x, y) in enumerate(rng.normal(size=(50, 2)))],
                               "i int, x double, y double, matrix array<double>").selectExpr(
        "*", "2880 AS width", "1978 AS height", "812D AS x0", "433D AS y0", "0.788D AS scale", "256 AS out_px")
    back = G.crop_to_local(G.local_to_crop(df)).collect()
    assert max(abs(r["x"] - r["lx"]) + abs(r["y"] - r["ly"]) for r in back) < 1e-10
    square = spark.createDataFrame([("s", i, 4, True, x, y) for i, (x, y) in enumerate([(0., 0.), (1., 0.), (1., 1.), (0., 1.)])],
                                   "u string, idx int, n int, closed boolean, x double, y double")
    assert G.curve_points(square, ["u"], 8).count() == 32
    for n, closed, rule, segs in ((10, True, "triplicate", 10), (10, False, "triplicate", 11), (10, False, "duplicate", 9)):
        p = spark.createDataFrame([("s", i, n, closed, float(i), 0.0) for i in range(n)], square.schema)
        assert G.curve_points(p, ["u"], 4, rule).count() == segs * 4 + (0 if closed else 1)
    for rule in ("duplicate", "reflect"):
        line = spark.createDataFrame([("s", i, 5, False, float(i), 2.0 * i) for i in range(5)], square.schema)
        assert all(abs(r["y"] - 2 * r["x"]) < 1e-12 for r in G.curve_points(line, ["u"], 4, rule).collect())


def test_vanishing_m33_is_an_error(spark):
    df = spark.createDataFrame([([0.0] * 16,)], "matrix array<double>")
    with pytest.raises(Exception, match="m33"):
        G.proj_encode(df).collect()


def test_claims(spark):
    p = spark.createDataFrame([("s", "a", "c1", .90, 5, "gold", None), ("s", "b", "c1", .60, 5, "gold", None),
                               ("t", "a", "c1", .90, 5, "gold", None), ("t", "b", "c1", .88, 5, "gold", None)],
                              "shot string, element_id string, channel string, score double, evidence long, grade string, reason string")
    ch = spark.createDataFrame([("s", "c1"), ("s", "c2"), ("t", "c1")], "shot string, channel string")
    final, findings = Q.resolve_claims(p, ch)
    got = {(r["shot"], r["element_id"]): (r["channel"], r["grade"]) for r in final.collect()}
    assert got == {("s", "a"): ("c1", "gold"), ("s", "b"): (None, "silver"), ("t", "a"): ("c1", "silver"), ("t", "b"): (None, "silver")}
    kinds = sorted((r["shot"], r["kind"]) for r in findings.collect())
    assert kinds == [("s", "collision"), ("s", "orphan"), ("s", "unmatched"), ("t", "ambiguous"), ("t", "unmatched"), ("t", "unmatched")]
    kept, skipped = Q.apply_gate(final, findings)
    assert {r["shot"] for r in kept.collect()} == {"s"} and {r["shot"] for r in skipped.collect()} == {"t"}


def test_quotability_and_environment(spark, monkeypatch):
    runs = spark.createDataFrame([("r1", "staging"), ("r2", None)], "run string, environment string")
    assert {r["environment"] for r in Q.check_quotable(runs).collect()} == {"staging", "unstamped"}
    bad = runs.unionByName(spark.createDataFrame([("r3", "local")], runs.schema))
    with pytest.raises(ValueError, match="r3"):
        Q.check_quotable(bad)
    assert Q.check_quotable(bad, allow_local=True).count() == 3
    monkeypatch.delenv(Q.ENV_VAR, raising=False)
    assert Q.environment() == "local" and Q.environment("staging") == "staging"
    with pytest.raises(ValueError):
        Q.environment("prod")


def test_fingerprint_and_equality(spark):
    a = spark.createDataFrame([(i, f"v{i}", None if i % 3 else 1.5) for i in range(200)], "k int, s string, d double")
    b = a.orderBy(F.desc("k")).repartition(7).select("d", "k", "s")
    fp = lambda df: Q.fingerprint(df).first()["fingerprint"]
    assert fp(a) == fp(b) and len(fp(a)) == 16
    assert fp(a.where("k > 0")) != fp(a) and fp(a.where("false")) is None
    assert Q.tables_equal(a, b.select(a.columns)) and not Q.tables_equal(a, a.unionByName(a.limit(1)))


def test_ledger(spark):
    good = Q.check_enum(spark.createDataFrame([("hold",)], "interp string"), "interp", ["hold", "linear"])
    bad = Q.check_enum(spark.createDataFrame([("cubic",)], "interp string"), "interp", ["hold", "linear"])
    Q.assert_green(good)
    with pytest.raises(ValueError, match="interp"):
        Q.assert_green(Q.build_ledger([good, bad]))
    assert Q.ledger_summary(Q.build_ledger([good, bad])).first()["red"] == 1


def test_configs_resolve_to_the_end_of_a_long_chain(spark):
    base = spark.createDataFrame([("k", "base"), ("z", "base")], "key string, value string")
    rows = [("r0", None, "k", "root")] + [(f"r{i}", f"r{i - 1}", "z" if i == 20 else None, "mid" if i == 20 else None) for i in range(1, 40)]
    table = "rung string, parent string, key string, value string"
    got = {(r["rung"], r["key"]): r["value"] for r in Q.resolve_configs(base, spark.createDataFrame(rows, table)).collect()}
    assert got["r39", "k"] == "root" and got["r39", "z"] == "mid" and got["r19", "z"] == "base"
    loop = spark.createDataFrame([("a", "b", None, None), ("b", "c", None, None), ("c", "b", None, None)], table)
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        Q.resolve_configs(base, loop)


def test_sweep_takes_its_reach_from_the_grid(spark):
    from keyloom.operators import pipelines
    rows = [(1, f, 0.0 if 10 <= f < 30 else 1.0, True) for f in range(40)]
    cells = spark.createDataFrame(rows, "user_id int, frame int, p double, truth boolean")
    grid = spark.createDataFrame([(0.5, 0.5, 30), (0.5, 0.5, 20), (0.5, 0.5, 21), (0.4, 0.6, 1)], "on double, off double, gap int")
    got = {r["gap"]: (r["cells"], r["accuracy"], r["transition_ratio"]) for r in pipelines.sweep(cells, ["user_id"], grid).collect()}
    assert got == {30: (40, 1.0, 0.0), 21: (40, 1.0, 0.0), 20: (40, 0.5, 2.0)}
