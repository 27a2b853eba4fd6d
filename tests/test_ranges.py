"""Chunks by ranges of any key, quantiles on uneven values, and what is ordered by names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions.distribution import quantile_table
from keyloom.functions.ordered import range_chunks, running_sum
from keyloom.operators import scoring, splits


def sizes(df, ranges):
    return [r["count"] for r in range_chunks(df, ["k"], "c", ranges).groupBy("c").count().collect()]


def test_one_outlier_leaves_even_ranges(spark):
    rng = np.random.default_rng(1)
    values = [*np.exp(rng.normal(size=20000) * 3).tolist(), 1e12, -1e12]
    got = sizes(spark.createDataFrame([(v,) for v in values], "k double").repartition(4), 64)
    assert len(got) == 64 and max(got) <= 2 * len(values) / 64


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,3)", "timestamp"])
def test_chunks_follow_the_order(spark, kind):
    key = {"string": "concat('s', id * 7919 % 1000, '__é')", "date": "date_add(DATE'2020-01-01', CAST(id * 7919 % 1000 AS INT))",
           "decimal(20,3)": "CAST(id * 7919 % 1000 / 8 AS DECIMAL(20,3))", "timestamp": "timestamp_seconds(id * 7919 % 1000 * 1000)"}[kind]
    df = spark.range(1000).selectExpr(f"CASE WHEN id = 5 THEN NULL ELSE {key} END AS k")
    rows = range_chunks(df, ["k"], "c", 40).orderBy("k").collect()
    chunks = [r.c for r in rows]
    assert rows[0].k is None and chunks == sorted(chunks) and len(set(chunks)) == 40


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([("b",), ("a",)], "k string")
    assert [r.k for r in range_chunks(df, ["k"], "c").orderBy("c", "k").collect()] == ["a", "b"]
    assert range_chunks(df.limit(0), ["k"], "c").count() == 0


def test_offsets_by_name(spark):
    names = [f"shot{i * 37 % 101}__layer é{i}" for i in range(300)]
    df = spark.createDataFrame([(n, i % 5 + 1, i % 3) for i, n in enumerate(names)], "element_id string, n_shapes int, n_groups int").repartition(5)
    got = {r.element_id: (r.shape_base, r.group_base) for r in splits.block_offsets(df).collect()}
    shapes = groups = 0
    for n, i in sorted((n, i) for i, n in enumerate(names)):
        assert got[n] == (shapes, groups)
        shapes, groups = shapes + i % 5 + 1, groups + i % 3


def test_pick_ranges_meet(spark):
    df = spark.createDataFrame([(f"e{i}", i + 1, 2 if i else 0) for i in range(500)], "element_id string, n_frames int, n_shapes int")
    rows = splits.cumulative_weights(splits.element_weight(df, "sqrt")).orderBy("lo").collect()
    assert len(rows) == 499 and rows[0].lo == 0 and abs(rows[-1].hi - splits.TICKS) < 1000
    assert all(a.hi == b.lo and a.element_id < b.element_id for a, b in zip(rows, rows[1:]))


def test_picks_follow_the_weights(spark):
    lanes = spark.createDataFrame([("a", 0), ("b", splits.TICKS // 2), ("c", splits.TICKS * 3 // 4)], "name string, lo long")
    got = splits.weighted_picks(spark.range(4000).withColumnRenamed("id", "step"), lanes.select("lo", "name"), 5)
    n = {r["name"]: r["count"] for r in got.groupBy("own.name").count().collect()}
    assert sum(n.values()) == 4000 and abs(n["a"] - 2000) < 200 and abs(n["b"] - 1000) < 150


def test_several_measures_in_one_pass(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(a), None if b < 0 else float(b)) for g, a, b in zip(rng.integers(0, 4, 900), rng.exponential(9, 900).round(1), rng.normal(size=900).round(2))]
    rows += [(9, 1.0, None)]
    q = {"a": {"a05": .05, "a50": .5}, "b * 2": {"b95": .95}}
    got = {r.g: r for r in quantile_table(spark.createDataFrame(rows, "g int, a double, b double"), ["g"], q, ranges=32).collect()}
    for g in range(4):
        a, b = [r[1] for r in rows if r[0] == g], [2 * r[2] for r in rows if r[0] == g and r[2] is not None]
        assert np.allclose([got[g].a05, got[g].a50, got[g].b95], [*np.percentile(a, [5, 50]), np.percentile(b, 95)])
    assert got[9].a50 == 1.0 and got[9].b95 is None


def test_running_sum_over_ranges(spark):
    df = spark.createDataFrame([(f"n{i:03d}", 1) for i in range(200)], "k string, v int").withColumn("g", F.lit(0)).repartition(3)
    out = running_sum(range_chunks(df, ["k"], "c", 16), ["g"], ["k"], F.col("c"), {"s": F.col("v")})
    assert [r.s for r in out.orderBy("k").collect()] == list(range(1, 201))


def test_element_summary_keeps_elements_without_a_measure(spark):
    rows = spark.createDataFrame([("r", 1, 0, 0.5, None, 0.5, 1.0)], "run string, element_id int, frame int, soft_iou double, point_err double, iou double, coverage double")
    assert scoring.element_summary(rows).first().p05_soft_iou == 0.5


TARGETS = [(0, "e", 3), (0, "e", 5), (1, "f", 3)]


def targets(spark, n_slots=0, width=0):
    sched = spark.createDataFrame(TARGETS, "step int, element_id string, frame int")
    cells = spark.createDataFrame([("e", 3, 0, True, True), ("e", 3, 1, False, False), ("e", 5, 0, True, False), ("f", 3, 0, True, False)],
                                  "element_id string, frame int, slot int, live boolean, is_key boolean")
    points = spark.createDataFrame([("e", 3, 0, 1, 3.0, 4.0), ("e", 3, 0, 0, 1.0, 2.0), ("e", 5, 0, 0, 9.0, 8.0), ("f", 3, 0, 0, 7.0, 7.0)],
                                   "element_id string, frame int, slot int, point_idx int, x double, y double")
    shapes = spark.createDataFrame([("e", 0, 2, [0.5]), ("e", 1, 1, [0.25]), ("f", 0, 1, [1.0])], "element_id string, slot int, point_count int, descriptor array<double>")
    elements = spark.createDataFrame([("e", 2, 0), ("f", 1, 2)], "element_id string, n_shapes int, shape_base long")
    rows = splits.training_targets(sched, cells, points, shapes, elements, n_slots, width).collect()
    return {(r.step, r.frame, r.slot): r for r in rows}


def test_targets_with_own_queries(spark):
    got = targets(spark)
    assert set(got) == {(0, 3, 0), (0, 3, 1), (0, 5, 0), (0, 5, 1), (1, 3, 0)}
    assert [got[k].query for k in sorted(got)] == [0, 1, 0, 1, 2]
    assert got[0, 3, 0].outline == [1.0, 2.0, 3.0, 4.0] and got[0, 3, 0].point_mask == [True, True] and got[0, 3, 0].is_key
    assert got[0, 5, 1].outline == [] and not got[0, 5, 1].live and got[0, 5, 1].descriptor == [0.25]


def test_targets_in_a_slot_bank(spark):
    got = targets(spark, 3, 4)
    assert len(got) == 9 and all(r.query == r.slot for r in got.values())
    pad = got[1, 3, 2]
    assert not pad.exists and not pad.live and pad.outline is None and pad.descriptor is None
    assert got[1, 3, 0].outline == [7.0, 7.0] + [0.0] * 6 and got[1, 3, 0].point_mask == [True, False, False, False]
    with pytest.raises(Exception, match="below the shapes of e"):
        targets(spark, 1)
    with pytest.raises(Exception, match="below the points"):
        targets(spark, 3, 1)
