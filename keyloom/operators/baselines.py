"""Trivial predictors and ablations: what a number is worth before anything is learned."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.distribution import value_counts
from ..functions.expr import seeded, seeded_chunk
from ..functions.ordered import positions, spread, stencil, with_totals


def mode_baseline(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Accuracy and mean absolute error of the global mode and of each group's mode.

    Works on value counts, so the input is reduced before any join; ties take the smallest value.
    """
    counts = value_counts(df, by, value)
    total = counts.groupBy("_value").agg(F.sum("_n").alias("_n"))
    g = total.groupBy().agg(F.expr("min_by(_value, struct(-_n, _value)) AS _gm"))
    local = counts.groupBy(*by).agg(F.expr("min_by(_value, struct(-_n, _value)) AS _lm"))
    scored = counts.join(local, list(by)).crossJoin(F.broadcast(g))
    return scored.groupBy().agg(
        F.expr("sum(_n) AS rows"), F.expr("count(DISTINCT _value) AS distinct_values"),
        F.expr("min(_value) AS min"), F.expr("max(_value) AS max"), F.expr("max(_gm) AS global_mode"),
        F.expr("sum(CASE WHEN _value = _gm THEN _n ELSE 0 END) / sum(_n) AS global_accuracy"),
        F.expr("sum(abs(_value - _gm) * _n) / sum(_n) AS global_mae"),
        F.expr("sum(CASE WHEN _value = _lm THEN _n ELSE 0 END) / sum(_n) AS group_accuracy"),
        F.expr("sum(abs(_value - _lm) * _n) / sum(_n) AS group_mae"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.col(value).alias("value")).agg(F.expr("count(1) AS n"))


def always_true_baseline(cells: DataFrame, by: Sequence[str], flag: str) -> DataFrame:
    """Predict 'live' everywhere: precision is the rate, recall 1."""
    return cells.groupBy(*by).agg(
        F.expr("count(1) AS cells"), F.expr(f"count_if({flag}) AS live_cells"),
        F.expr(f"count_if({flag}) / count(1) AS accuracy"),
        F.expr(f"count_if({flag}) / count(1) AS precision"), F.expr("1D AS recall"),
        F.expr(f"2D * (count_if({flag}) / count(1)) / greatest(1e-9, count_if({flag}) / count(1) + 1D) AS f1"))


def lifespan_variants(cells: DataFrame, noise: Sequence[float] = (), seed: int = 0) -> tuple[DataFrame, list[str]]:
    """One boolean column per ablation of ``live``: always, coverage rule, dilate, erode, noise.

    All noise rates share one hash rank inside the (element, live) pool, so more rates cost a
    comparison each, not another ranking.
    """
    track = ["element_id", "shape_id"]
    out = with_totals(cells, ["element_id", "frame"], {"coverage_alive": ("max", F.col("live"))},
                      F.pmod(F.xxhash64("shape_id"), F.lit(16)))
    out = stencil(out, track, "frame", {
        "_prev": lambda w: F.lag("live").over(w), "_next": lambda w: F.lead("live").over(w)}, 1)
    names = ["exact", "always_alive", "coverage_alive", "dilate", "erode"]
    made = ["live AS exact", "true AS always_alive", "coverage_alive",
            "live OR coalesce(_prev, false) OR coalesce(_next, false) AS dilate",
            "live AND coalesce(_prev, true) AND coalesce(_next, true) AS erode"]
    out = out.selectExpr(*cells.columns, *made)
    if not noise:
        return out, names
    key = [*track, "frame"]
    out = with_totals(out, ["element_id"], {"_cells": ("count", F.lit(1))}, spread(*key))
    out = out.withColumn("_h", seeded(seed, *key))
    out = positions(out, ["element_id", "live"], ["_h", *key], seeded_chunk("_h"), "_rank")
    flips = []
    for rate in noise:
        hit = f"_rank < bround({rate}D * _cells)"
        pct = round(rate * 100)
        flips += [f"live OR {hit} AS fp_{pct}pct", f"live AND NOT {hit} AS fn_{pct}pct"]
        names += [f"fp_{pct}pct", f"fn_{pct}pct"]
    return out.selectExpr(*cells.columns, *names[:5], *flips), names


def ablate(cells: DataFrame, pixels: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Soft IoU per (variant, element, frame) of re-drawing with each variant's lifespans.

    Variants are columns, not copies of the rows: one join of cells with their pixels and one
    aggregation per pixel price every variant at once.
    """
    drawn = pixels.join(cells.select("element_id", "shape_id", "frame", *variants),
                        ["element_id", "shape_id", "frame"])
    px = drawn.groupBy("element_id", "frame", "y", "x").agg(*[
        F.expr(f"coalesce(max(CASE WHEN {v} THEN cov END), 0D) AS {v}") for v in variants])
    scored = px.groupBy("element_id", "frame").agg(*[
        F.expr(f"coalesce(try_divide(sum(least({v}, exact)), sum(greatest({v}, exact))), 1D) AS {v}")
        for v in variants], F.expr("max(exact) > 0 AS on_screen"))
    pairs = ", ".join(f"'{v}', {v}" for v in variants)
    return scored.selectExpr("element_id", "frame", "on_screen", f"stack({len(variants)}, {pairs}) AS (variant, soft_iou)")


def ablation_totals(scores: DataFrame) -> DataFrame:
    """Per variant: frame-weighted means over all and on-screen frames, worst element, cost."""
    el = scores.groupBy("variant", "element_id").agg(
        F.expr("count(1) AS frames"), F.expr("avg(soft_iou) AS mean"),
        F.expr("avg(CASE WHEN on_screen THEN soft_iou END) AS mean_on"),
        F.expr("count_if(soft_iou < 0.90) AS below"))
    el = el.withColumn("mean_on", F.expr("coalesce(mean_on, mean)"))
    v = el.groupBy("variant").agg(
        F.expr("sum(mean * frames) / sum(frames) AS mean"), F.expr("sum(mean_on * frames) / sum(frames) AS mean_onscreen"),
        F.expr("min_by(element_id, struct(mean_on, element_id)) AS worst_element"),
        F.expr("min(mean_on) AS worst_element_onscreen"), F.expr("sum(below) AS frames_below_090"))
    base = v.where("variant = 'exact'").select(F.col("mean_onscreen").alias("_base"))
    return v.crossJoin(F.broadcast(base)).withColumn(
        "cost_vs_exact_onscreen", F.expr("_base - mean_onscreen")).drop("_base")


def trace_totals(scores: DataFrame, by: Sequence[str] = ("variant", "in_train")) -> DataFrame:
    """Outline-trace rows ``(variant, element_id, in_train, frames, mean_onscreen, shapes_used)``."""
    return scores.groupBy(*by).agg(
        F.expr("sum(mean_onscreen * frames) / sum(frames) AS mean_onscreen"),
        F.expr("min(mean_onscreen) AS worst_onscreen"),
        F.expr("min_by(element_id, struct(mean_onscreen, element_id)) AS worst_element"),
        F.expr("sum(shapes_used * frames) / sum(frames) AS shapes_used"), F.expr("count(1) AS elements"))
