"""Python on whole groups in blocks: what it gives, and that no query calls Python once per track."""

import numpy as np
import pyarrow as pa
import pytest

from keyloom.functions.groups import by_group, numbers
from keyloom.operators import coverage as C
from keyloom.operators import pipelines as P
from keyloom.operators import refit as R
from keyloom.operators import simplify as S


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_groups_over_batches(spark, batch):
    def sums(table, bounds):
        v, n = numbers(table["v"]), len(bounds) - 1
        return range(n), {"blocks": pa.array(np.full(n, n), pa.int64()), "s": pa.array([float(v[a:b].sum()) for a, b in zip(bounds, bounds[1:])])}

    rng = np.random.default_rng(1)
    rows = [(None if k == 5 else f"k{k}", i, float(rng.integers(9))) for k in range(60) for i in range(int(rng.integers(1, 20)))]
    want = {}
    for k, _, v in rows:
        want[k] = want.get(k, 0) + v
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = by_group(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "i", sums, "blocks long, s double").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.k: r.s for r in got} == want and len(got) == len(want)
    if batch == 10000:
        assert max(r.blocks for r in got) > 10


def tracks(spark):
    return spark.range(2000).selectExpr("id % 100 AS u", "id div 100 AS frame", "id div 100 AS pos", "array(CAST(id * id % 97 AS DOUBLE), 0D) AS pts",
                                        "CAST(id % 7 AS DOUBLE) / 7 AS p", "id % 3 = 0 AS truth", "CAST(id * id % 97 AS DOUBLE) AS value")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_simplify_calls_python_by_block(spark):
    assert "FlatMapGroupsIn" not in plan(S.simplify(tracks(spark), ["u"], 5.0))


def test_sweep_calls_python_by_block(spark, monkeypatch):
    monkeypatch.setattr(P, "cut", lambda df: df, raising=False)
    grid = spark.createDataFrame([(0.6, 0.4, 2)], "on double, off double, gap int")
    assert "FlatMapGroupsIn" not in plan(P.sweep(tracks(spark), ["u"], grid))


def test_refit_calls_python_by_block(spark, monkeypatch):
    monkeypatch.setattr(R, "cut", lambda df: df)
    t = tracks(spark)
    keys = t.where("frame % 4 = 0").selectExpr("u", "frame", "'hold' AS interp")
    fitted = R.refit(t, keys, ["u"])
    assert "FlatMapGroupsIn" not in plan(fitted)
    means = t.groupBy("u", (t.frame - t.frame % 4).alias("frame")).avg("value").collect()
    want = {(r.u, r.frame): r["avg(value)"] for r in means}
    assert {(r.u, r.frame): pytest.approx(want[r.u, r.frame]) for r in fitted.collect()} == want


def test_pixels_are_dealt_by_their_number(spark, monkeypatch):
    """The pixels of a table are combined in as many tasks as they need, not in those that their bytes need."""
    import keyloom.functions.ordered as ordered
    monkeypatch.setattr(ordered, "TASK_ROWS", 50, raising=False)
    px = spark.range(1000).selectExpr("id % 10 AS f", "id div 100 AS y", "id div 10 % 10 AS x", "0.5D AS cov")
    assert C.shift_cov(px, ["f"], "0.5D", "0D", 10, 10).rdd.getNumPartitions() >= 80
    corner = spark.createDataFrame([(v, i, 3, x, y) for v in range(40) for i, (x, y) in enumerate([(1.0, 1.0), (8.0, 1.0), (4.0, 7.0)])],
                                   "v int, idx int, cnt int, x double, y double")
    for drawn in (C.fill_coverage(corner, ["v"], 10, 10), C.stroke_coverage(corner, ["v"], 10, 10, 1.5)):
        assert drawn.rdd.getNumPartitions() >= 20
