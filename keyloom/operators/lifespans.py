"""On/off state tracks: thresholds, repairs, intervals, transitions, confusion and noise.

Input rows are one cell per track position: the ``by`` columns name the track, ``frame`` is a
dense integer axis. Bounded look-around uses ``stencil``; unbounded state uses ``last_known``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import clip, half_even, ratio, seeded, seeded_chunk
from ..functions.ordered import (CHUNK, last_known, positions, running_sum, spread, stencil,
                                 with_totals)


def live_cells(cells: DataFrame, opacity: str = "opacity", path_lo: str = "path_lo",
               path_hi: str = "path_hi") -> DataFrame:
    """Opacity (stored 0-100) to the two live flags; no track means live over the key range.

    ``live_any`` is ``opacity > 0`` (the stored arrays' rule), ``live_half`` is ``> 0.5`` (the
    loader's rule). Both are kept because both are in use.
    """
    keyed = F.col(opacity).isNotNull()
    alpha = F.when(keyed, clip(F.col(opacity) / 100.0, 0.0, 1.0)).otherwise(F.lit(1.0))
    inside = F.col("frame").between(F.col(path_lo), F.col(path_hi))
    return cells.select("*", alpha.alias("alpha"),
                        F.when(keyed, alpha > 0.0).otherwise(inside).alias("live_any"),
                        (alpha > 0.5).alias("live_half"))


def hysteresis(df: DataFrame, by: Sequence[str], prob: str, on: float, off: float,
               order: str = "frame", name: str = "live", size: int = CHUNK,
               keep: Sequence[str] | None = None) -> DataFrame:
    """On above ``on``, off at or below ``off``, otherwise hold; off before the first decision."""
    if on < off:
        raise ValueError(f"on threshold {on} is below off threshold {off}")
    p = F.col(prob)
    mark = F.when(p > on, F.lit(True)).when(p <= off, F.lit(False))
    keep = list(df.columns if keep is None else keep)
    return last_known(df, by, order, {"_state": mark}, size, keep=keep).select(
        *keep, F.coalesce("_state", F.lit(False)).alias(name))


def close_gaps(df: DataFrame, by: Sequence[str], min_gap: int, flag: str = "live",
               order: str = "frame", name: str = "closed", size: int = CHUNK) -> DataFrame:
    """Turn interior dead runs shorter than ``min_gap`` live. Runs touching an end stay dead."""
    if min_gap <= 1:
        return df.withColumn(name, F.col(flag))
    live_at = F.when(F.col(flag), F.col(order))
    out = stencil(df, by, order, {
        "_prev": lambda w: F.max(live_at).over(w.rangeBetween(-min_gap, 0)),
        "_next": lambda w: F.min(live_at).over(w.rangeBetween(0, min_gap)),
    }, min_gap, size)
    short = (F.col("_next") - F.col("_prev") - 1) < min_gap
    return out.select(*df.columns,
                      (F.col(flag) | F.coalesce(short, F.lit(False))).alias(name))


def transitions(df: DataFrame, by: Sequence[str], flag: str = "live", order: str = "frame",
                size: int = CHUNK) -> DataFrame:
    """Interior state changes: the frame where the new state starts and which side is live."""
    out = stencil(df, by, order, {"_was": lambda w: F.lag(flag).over(w)}, 1, size)
    return out.where(F.col("_was").isNotNull() & (F.col("_was") != F.col(flag))).select(
        *by, F.col(order).alias("frame"),
        F.when(F.col(flag), F.lit("on")).otherwise(F.lit("off")).alias("change"),
        F.when(F.col(flag), F.col(order)).otherwise(F.col(order) - 1).alias("live_side"))


def islands(df: DataFrame, by: Sequence[str], flag: str = "live", order: str = "frame",
            size: int = CHUNK) -> DataFrame:
    """Maximal live runs as inclusive ``[start, end]``.

    Only the boundary rows survive the first stage; each end then looks back to its start.
    """
    edge = stencil(df.select(*by, order, flag), by, order, {
        "_prev": lambda w: F.lag(flag, 1, False).over(w),
        "_next": lambda w: F.lead(flag, 1, False).over(w)}, 1, size)
    edge = edge.where(F.col(flag) & (~F.col("_prev") | ~F.col("_next")))
    paired = last_known(edge, by, order, {"_start": F.when(~F.col("_prev"), F.col(order))}, size,
                        keep=[*by, order, "_next"])
    return paired.where(~F.col("_next")).select(
        *by, F.col("_start").alias("start"), F.col(order).alias("end"))


def mask_to_keys(df: DataFrame, by: Sequence[str], flag: str = "live", order: str = "frame",
                 size: int = CHUNK) -> DataFrame:
    """Hold keys (0/100) at state changes.

    Always-on tracks have no keys, never-on tracks a single 0 at the axis start, and a leading 0
    is written when the first change comes later than the axis start.
    """
    axis = df.groupBy(*by).agg(F.min(order).alias("_lo"), F.bool_and(flag).alias("_always"),
                               F.bool_or(flag).alias("_ever"))
    edge = stencil(df.select(*by, order, flag), by, order,
                   {"_prev": lambda w: F.lag(flag, 1, False).over(w)}, 1, size)
    changes = edge.where(F.col(flag) != F.col("_prev"))
    # An always-on track shows one change, at its first frame, and no other.
    changes = changes.join(axis.where("_always").select(*by), list(by), "left_anti")
    body = changes.select(*by, F.col(order).alias("frame"),
                          F.when(F.col(flag), 100.0).otherwise(0.0).alias("value"))
    starts = edge.groupBy(*by).agg(
        F.min(order).alias("_lo"), F.min(F.when(F.col(flag), F.col(order))).alias("_first"))
    lead = starts.where(F.col("_first").isNull() | (F.col("_first") > F.col("_lo"))).select(
        *by, F.col("_lo").alias("frame"), F.lit(0.0).alias("value"))
    return body.unionByName(lead).withColumn("interp", F.lit("hold"))


def confusion(df: DataFrame, by: Sequence[str], pred: str = "pred", truth: str = "truth",
              order: str = "frame", size: int = CHUNK, track: Sequence[str] | None = None
              ) -> DataFrame:
    """Cells, accuracy, false rates over **all** cells, live rates and transition counts.

    ``track`` names the state tracks inside a ``by`` group (default: the group is one track).
    """
    track = list(track or by)
    p, t = F.col(pred), F.col(truth)
    out = stencil(df, track, order, {"_pp": lambda w: F.lag(pred).over(w),
                                     "_pt": lambda w: F.lag(truth).over(w)}, 1, size)
    n = F.count(F.lit(1))
    return out.groupBy(*by).agg(
        n.alias("cells"),
        ratio(F.count_if(p == t), n).alias("accuracy"),
        ratio(F.count_if(p & ~t), n).alias("fp_rate"),
        ratio(F.count_if(~p & t), n).alias("fn_rate"),
        ratio(F.count_if(p), n).alias("live_rate_pred"),
        ratio(F.count_if(t), n).alias("live_rate_true"),
        F.count_if(p != F.col("_pp")).alias("transitions_pred"),
        F.count_if(t != F.col("_pt")).alias("transitions_true"))


def outer_cells(pred: DataFrame, truth: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full join of two sparse live-cell tables; a missing row is a dead cell."""
    a = pred.select(*on, F.lit(True).alias("pred"))
    b = truth.select(*on, F.lit(True).alias("truth"))
    return a.join(b, list(on), "full").na.fill({"pred": False, "truth": False})


def shift_mask(df: DataFrame, by: Sequence[str], mode: str, flag: str = "live",
               order: str = "frame", name: str = "shifted", size: int = CHUNK) -> DataFrame:
    """Move every boundary by one frame: ``dilate`` (or) / ``erode`` (and) with neighbours."""
    if mode not in ("dilate", "erode"):
        raise ValueError(f"unknown mode {mode!r}")
    pad = mode == "erode"
    out = stencil(df, by, order, {"_prev": lambda w: F.lag(flag, 1, pad).over(w),
                                  "_next": lambda w: F.lead(flag, 1, pad).over(w)}, 1, size)
    a, b, c = F.col("_prev"), F.col(flag), F.col("_next")
    return out.select(*df.columns, ((a & b & c) if pad else (a | b | c)).alias(name))


def noisy_mask(df: DataFrame, by: Sequence[str], rate: float, direction: str, seed: int,
               key: Sequence[str], flag: str = "live", name: str = "noisy") -> DataFrame:
    """Flip ``round(rate * cells)`` cells one way, chosen by hash rank, capped at the pool.

    The same cells are chosen whatever the partitioning: the rank is over a hash of the key.
    """
    if direction not in ("fp", "fn"):
        raise ValueError(f"unknown direction {direction!r}")
    eligible = ~F.col(flag) if direction == "fp" else F.col(flag)
    sized = with_totals(df, by, {"_cells": ("count", F.lit(1))}, spread(*key))
    sized = sized.withColumn("_h", seeded(seed, *key))
    pool = positions(sized.withColumn("_pool", eligible), [*by, "_pool"], ["_h", *key],
                     seeded_chunk("_h"), "_rank")
    flip = F.col("_pool") & (F.col("_rank") < half_even(F.lit(rate) * F.col("_cells")))
    return pool.select(*df.columns,
                       F.when(flip, ~F.col(flag)).otherwise(F.col(flag)).alias(name))


def any_live(df: DataFrame, by: Sequence[str], flag: str = "live",
             name: str = "any_live") -> DataFrame:
    """A group is live when any member is: partial aggregation, then one row per group."""
    return df.groupBy(*by).agg(F.bool_or(flag).alias(name))


def coverage_rule(df: DataFrame, element: Sequence[str], frame: str = "frame",
                  flag: str = "live") -> DataFrame:
    """Per element: how often 'alive exactly when the element is' agrees with the truth."""
    per_frame = df.groupBy(*element, frame).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(flag)).alias("_live"))
    rule_on = F.col("_live") > 0
    agree = F.when(rule_on, F.col("_live")).otherwise(F.col("_n"))
    return per_frame.groupBy(*element).agg(
        F.sum("_n").alias("cells"), F.sum("_live").alias("live_cells"),
        ratio(F.sum(agree), F.sum("_n")).alias("agreement"))
