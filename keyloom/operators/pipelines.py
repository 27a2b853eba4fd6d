"""Composite stages: dense targets, rebuilt tracks, program decode and threshold sweeps."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.groups import by_group, list_array, numbers, whole
from ..functions.lineage import cut
from ..functions.ordered import chunk_id, positions
from . import geometry, lifespans, tracks
from .simplify import refit, simplify


def dense_points(cells: DataFrame, path_keys: DataFrame, opacity_keys: DataFrame, matrices: DataFrame,
                 crops: DataFrame) -> DataFrame:
    """One long row per (element, frame, shape, point): local point, crop point, live and key flags.

    ``cells`` are the (element_id, shape_id, frame, path_lo, path_hi) rows to fill; padding is
    simply absence.
    """
    by = ["element_id", "shape_id"]
    want = cells.select(*by, "frame")
    pts = tracks.sample_track(path_keys, want, by).withColumnRenamed("value", "pts")
    op = tracks.sample_track(opacity_keys, want, by).selectExpr(*by, "frame", "value[0] AS opacity")
    flags = lifespans.live_cells(cells.join(op, [*by, "frame"], "left"))
    flags = tracks.key_mask(path_keys, flags, by)
    wide = pts.join(flags.select(*by, "frame", "live_half", "is_key"), [*by, "frame"]).join(
        matrices, [*by, "frame"]).join(crops, ["element_id", "frame"])
    long = wide.select(*[c for c in wide.columns if c != "pts"], F.posexplode(F.expr(
        "transform(sequence(0, size(pts) div 2 - 1), i -> named_struct('x', pts[2 * i], 'y', pts[2 * i + 1]))"))
        .alias("point_idx", "_p")).select("*", "_p.x", "_p.y").drop("_p")
    return geometry.local_to_crop(long).select(
        *by, "frame", "point_idx", "x", "y", "cx", "cy", F.col("live_half").alias("live"), "is_key")


def rebuild(points: DataFrame, artist_keys: DataFrame, by: Sequence[str], tol: float, window: int = 0,
            kind: str = "boxcar", px_per_norm: float = 1.0, refit_values: bool = False) -> DataFrame:
    """Sparse keys from dense live points ``(by, frame, x, y)``, one point per track.

    Timing is chosen on the smoothed track, values come from it too unless ``refit_values``.
    Interpolation is the artist's at that frame, else linear. One live frame gives one key.
    """
    by = list(by)
    live = positions(points.select(*by, "frame", "x", "y"), by, ["frame"], chunk_id("frame"), "pos")
    smooth = tracks.smooth(live, by, ["x", "y"], window, kind, position="pos") if window > 1 else live
    t = smooth.withColumn("pts", F.expr(f"array(x * {px_per_norm}D, y * {px_per_norm}D)"))
    knots = simplify(t, by, tol).select(*by, "frame")
    interp = artist_keys.groupBy(*by, "frame").agg(F.min("interp").alias("interp"))
    timed = knots.join(interp, [*by, "frame"], "left").na.fill("linear", ["interp"])
    if not refit_values:
        return timed.join(smooth.select(*by, "frame", "x", "y"), [*by, "frame"])
    xs = refit(live, timed, by, "x").select(*by, "frame", F.col("value").alias("x"))
    ys = refit(live, timed, by, "y").select(*by, "frame", F.col("value").alias("y"))
    return timed.join(xs, [*by, "frame"]).join(ys, [*by, "frame"])


# The counting function travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAD_FRAME = -32768


def assemble_program(shapes: DataFrame, template_keys: DataFrame, pred_keys: DataFrame, pred_live: DataFrame
                     ) -> DataFrame:
    """Predicted keys and lifespans in the template's structure, as ``(element, shape, track, frame, ...)``.

    Slots holding the pad frame are skipped, interpolation comes from the template's key of the
    same rank, and a shape-count mismatch is an error.
    """
    by = ["element_id", "shape_id"]
    n_t = shapes.groupBy("element_id").agg(F.expr("count(1) AS _nt"))
    n_p = pred_live.select(*by).distinct().groupBy("element_id").agg(F.expr("count(1) AS _np"))
    ok = n_t.join(n_p, "element_id", "full").select("element_id", F.expr(
        "CASE WHEN _nt <=> _np THEN true ELSE raise_error(concat('shape count differs for element ', element_id)) END AS _ok"))
    rank = lambda df: positions(df, by, ["frame"], chunk_id("frame"), "_rank")
    modes = rank(template_keys.select(*by, "frame", "interp")).select(*by, "_rank", "interp")
    keys = rank(pred_keys.where(F.col("frame") != PAD_FRAME).select(*by, "frame", "value"))
    path = keys.join(modes, [*by, "_rank"], "left").select(
        *by, F.lit("path").alias("track"), "frame", F.coalesce("interp", F.lit("linear")).alias("interp"), "value")
    life = lifespans.mask_to_keys(pred_live, by).select(
        *by, F.lit("opacity").alias("track"), "frame", "interp", F.array("value").alias("value"))
    return path.unionByName(life).join(ok.where("_ok"), "element_id").drop("_ok")


def _chunk_counts(pairs: list[tuple[float, float]], widest: int):
    """What chunks of tracks contribute to each threshold pair, for both states they may be entered in; many chunks at once."""
    def count(table: pa.Table, bounds: np.ndarray):
        frame, p = table["frame"].to_numpy(), numbers(table["p"])
        truth = whole(table["truth"]).cast(pa.bool_()).fill_null(False).to_numpy(zero_copy_only=False)
        rows, start, end, n = table.num_rows, bounds[:-1], bounds[1:], np.diff(bounds)
        place, group, every = np.arange(rows), np.repeat(np.arange(len(n)), n), np.arange(len(n))
        seen = np.concatenate([[0], np.cumsum(truth)])
        inner = group[1:] == group[:-1]
        per = lambda on, of: np.bincount(of, weights=on, minlength=len(n)).astype(np.int64)
        truth_turns = per((truth[1:] != truth[:-1]) & inner, group[1:])
        parts: list[dict[str, np.ndarray]] = []
        for k, (on, off) in enumerate(pairs):
            up = p > on
            told = np.maximum.accumulate(np.where(up | (p <= off), place, -1))
            of_own = told >= start[group]
            state = up[told] & of_own
            for entry in (False, True):
                live = np.where(of_own, state, entry)
                at = np.flatnonzero(live)
                first, last = np.full(len(n), -1), np.full(len(n), -1)
                first[group[at][::-1]], last[group[at]] = at[::-1], at
                lo, hi = at[:-1], at[1:]
                wide = (group[lo] == group[hi]) & (hi - lo > 1) & (frame[hi] - frame[lo] - 1 < widest)
                lo, hi = lo[wide], hi[wide]
                parts.append({
                    "pair": np.full(len(n), k, np.int32), "entry": np.full(len(n), entry), "known": state[end - 1], "told": of_own[end - 1], "n": n,
                    "tp": per(live & truth, group), "fp": per(live & ~truth, group), "truth": seen[end] - seen[start],
                    "turns": per((live[1:] != live[:-1]) & inner, group[1:]), "truth_turns": truth_turns,
                    "enters": live[start], "leaves": live[end - 1], "truth_enters": truth[start], "truth_leaves": truth[end - 1],
                    "any": first >= 0, "first_live": frame[first], "lead": np.stack([first - start, seen[first] - seen[start]], 1),
                    "last_live": frame[last], "trail": np.stack([end - 1 - last, seen[end] - seen[last + 1]], 1),
                    "gaps": per(np.ones(len(lo)), group[lo]), "len": frame[hi] - frame[lo] - 1, "rows": hi - lo - 1, "hits": seen[hi] - seen[lo + 1]})
        all_of = {c: np.concatenate([part[c] for part in parts]) for c in parts[0]}
        none = ~all_of["any"]
        out = {c: pa.array(all_of[c]) for c in ("pair", "entry", "n", "tp", "fp", "truth", "turns", "truth_turns", "enters", "leaves",
                                                "truth_enters", "truth_leaves")}
        out |= {"known": pa.array(all_of["known"], mask=~all_of["told"])}
        out |= {c: pa.array(all_of[c], mask=none) for c in ("first_live", "last_live")}
        out |= {c: list_array(pa.array(all_of[c][~none].ravel()), np.where(none, 0, 2), none) for c in ("lead", "trail")}
        gaps = pa.StructArray.from_arrays([pa.array(all_of[c]) for c in ("len", "rows", "hits")], names=["len", "rows", "hits"])
        out["gaps"] = list_array(gaps, all_of["gaps"])
        return np.tile(every, len(parts)), out
    return count


COUNTS = ("pair int, entry boolean, known boolean, n long, tp long, fp long, truth long, turns long, truth_turns long, enters boolean, leaves boolean, "
          "truth_enters boolean, truth_leaves boolean, first_live long, lead array<long>, last_live long, trail array<long>, "
          "gaps array<struct<len: long, rows: long, hits: long>>")


def sweep(cells: DataFrame, by: Sequence[str], grid: DataFrame, prob: str = "p", truth: str = "truth",
          size: int = 65536) -> DataFrame:
    """Decode the same probabilities under every (on, off, gap) and score each cell of the grid.

    ``grid`` is the small parameter table; off above on is not a cell. Rows are shuffled once. Every chunk of a track counts hits,
    turns and gaps for each pair of thresholds; chunks are joined by what they were entered and left in, and all
    gap lengths are answered from the counts of gaps by length. So the plan does not depend on the grid, and a row is looked at
    once per pair. Gaps are measured to the live frames on both sides, however far those are.
    """
    by = list(by)
    spark = cells.sparkSession
    points = sorted({(float(r[0]), float(r[1]), int(r[2])) for r in grid.where("off <= on").select("on", "off", "gap").collect()})
    if not points:
        return spark.createDataFrame([], "on double, off double, gap int, cells long, accuracy double, fp_rate double, "
                                         "fn_rate double, transition_ratio double")
    pairs = sorted({p[:2] for p in points})
    asked = spark.createDataFrame([(*p, pairs.index(p[:2])) for p in points], "on double, off double, gap int, pair int")
    rows = cells.select(*by, F.col("frame").cast("long").alias("frame"), F.col(prob).cast("double").alias("p"), F.col(truth).alias("truth"),
                        chunk_id("frame", size).alias("_chunk"))
    counts = cut(by_group(rows, [*by, "_chunk"], "frame", _chunk_counts(pairs, max(p[2] for p in points)), COUNTS))  # read twice
    track = Window.partitionBy(*by, "pair").orderBy("_chunk")
    before = track.rowsBetween(Window.unboundedPreceding, -1)
    # Both variants of a chunk tell the same ``known``, so the state it is entered in is that of the chunks before.
    earlier = Window.partitionBy(*by, "pair").orderBy("_chunk").rangeBetween(Window.unboundedPreceding, -1)
    told = counts.withColumn("_in", F.coalesce(F.last("known", ignorenulls=True).over(earlier), F.lit(False))).where("entry = _in")
    seen = told.withColumns({"_n": F.coalesce(F.sum("n").over(before), F.lit(0)), "_t": F.coalesce(F.sum("truth").over(before), F.lit(0))})
    left = F.when(F.col("last_live").isNotNull(), F.struct(
        F.col("last_live").alias("frame"), (F.col("_n") + F.col("n") - F.col("trail")[0]).alias("n"), (F.col("_t") + F.col("truth") - F.col("trail")[1]).alias("t")))
    seen = seen.withColumn("_left", left).withColumn("_before", F.last("_left", ignorenulls=True).over(before))
    seen = seen.withColumns({c: F.lag(v).over(track) for c, v in (("_was", "leaves"), ("_truth_was", "truth_leaves"))})
    gap = F.when(F.col("first_live").isNotNull() & F.col("_before").isNotNull(), F.array(F.struct(
        (F.col("first_live") - F.col("_before.frame") - 1).alias("len"), (F.col("_n") + F.col("lead")[0] - F.col("_before.n")).alias("rows"),
        (F.col("_t") + F.col("lead")[1] - F.col("_before.t")).alias("hits"))))
    seen = seen.withColumn("gaps", F.concat("gaps", F.coalesce(gap, F.slice("gaps", 1, 0))))
    base = seen.groupBy("pair").agg(
        F.expr("sum(n) AS cells"), F.expr("sum(tp) AS tp"), F.expr("sum(fp) AS fp"), F.expr("sum(truth) AS truth"),
        F.expr("sum(turns + IF(_was <> enters, 1, 0)) AS turns"), F.expr("sum(truth_turns + IF(_truth_was <> truth_enters, 1, 0)) AS truth_turns"))
    lengths = seen.select("pair", F.explode("gaps").alias("g")).where("g.rows > 0").groupBy("pair", "g.len").agg(
        F.expr("count(1) AS closed"), F.expr("sum(g.rows) AS rows"), F.expr("sum(g.hits) AS hits"))
    # Both sides have at most one row per cell of the grid and gap length below its widest.
    filled = asked.join(lengths, "pair").where("gap > 1 AND len < gap").groupBy("on", "off", "gap").agg(
        *[F.sum(c).alias(c) for c in ("closed", "rows", "hits")])
    out = asked.join(base, "pair").join(filled, ["on", "off", "gap"], "left").na.fill(0, ["closed", "rows", "hits"])
    return out.select("on", "off", "gap", "cells", F.expr("(cells - truth - fp + tp + 2 * hits - rows) / cells AS accuracy"),
                      F.expr("(fp + rows - hits) / cells AS fp_rate"), F.expr("(truth - tp - hits) / cells AS fn_rate"),
                      F.expr("(turns - 2 * closed) / greatest(1, truth_turns) AS transition_ratio"))
