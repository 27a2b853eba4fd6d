"""Element statistics, descriptive tags, catalogues and canonical order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.distribution import exact_quantiles, mode_of
from ..functions.ordered import positions, ranked, spread, with_totals

INTERP_MODES = ("linear", "hold", "catmullrom")
EPHEMERAL_MAX_FRAMES = 2


def shape_facts(keys: DataFrame) -> DataFrame:
    """Key counts per shape: path keys, opacity keys and path keys by interpolation."""
    path = "track = 'path'"
    return keys.groupBy("shape_id").agg(
        F.expr(f"count_if({path}) AS path_keys"),
        F.expr("count_if(track = 'opacity') AS opacity_keys"),
        *[F.expr(f"count_if({path} AND interp = '{m}') AS interp_{m}") for m in INTERP_MODES])


def shape_class(shapes: DataFrame) -> DataFrame:
    """``{persistent|ephemeral}_{fill|stroke}`` from opacity keys, live frames and closedness."""
    return shapes.select(
        "*", F.expr(f"opacity_keys > 1 AND live_frames <= {EPHEMERAL_MAX_FRAMES}").alias("ephemeral")
    ).withColumn("shape_class", F.expr(
        "concat(CASE WHEN ephemeral THEN 'ephemeral' ELSE 'persistent' END, '_', "
        "CASE WHEN closed THEN 'fill' ELSE 'stroke' END)"))


def element_stats(shapes: DataFrame, nodes: DataFrame, shape_types: Sequence[str]) -> DataFrame:
    """One row per element. ``shapes`` carries ``shape_facts`` and ``shape_class`` columns.

    ``nodes`` are layers ``(element_id, node_id, transform_keys, trs_keys)``; a layer is tracked
    when it has any transform key and animated when either track has more than one.
    """
    s = shapes.groupBy("element_id").agg(
        F.expr("count(1) AS shapes"), F.expr("sum(n_points) AS points"),
        F.expr("sum(path_keys) AS keys"), F.expr("count_if(NOT closed) AS open_strokes"),
        F.expr("count_if(opacity_keys > 1) AS with_lifespan"),
        F.expr("count_if(ephemeral) AS ephemeral"), F.expr("sum(live_frames) AS live_frames"),
        *[F.expr(f"count_if(shape_type = '{t}') AS type_{t}") for t in shape_types],
        *[F.expr(f"sum(interp_{m}) AS interp_{m}") for m in INTERP_MODES])
    n = nodes.groupBy("element_id").agg(
        F.expr("count(1) AS layers"),
        F.expr("count_if(transform_keys > 0 OR trs_keys > 0) AS tracked_layers"),
        F.expr("count_if(transform_keys > 1 OR trs_keys > 1) AS animated_transforms"))
    counts = [c for c in n.columns if c != "element_id"]
    return s.join(n, "element_id", "left").na.fill(0, counts)


def element_tags(stats: DataFrame) -> DataFrame:
    """Descriptive tags. A tag describes an element; it never filters it."""
    return stats.select(
        "element_id", "shapes",
        F.expr("coalesce(bround(try_divide(open_strokes, shapes), 4), 0D) AS open_fraction"),
        F.expr("coalesce(bround(try_divide(ephemeral, shapes), 4), 0D) AS ephemeral_fraction"),
        F.expr("coalesce(bround(try_divide(keys, live_frames), 4), 0D) AS keys_per_live_frame"),
        F.expr("coalesce(bround(try_divide(points, shapes), 2), 0D) AS points_per_shape"),
        F.expr("tracked_layers > 0 AS tracked"), F.expr("animated_transforms > 0 AS animated_transform"),
        F.expr("shapes <= 1 AS trivial"),
        F.expr("coalesce(try_divide(open_strokes, shapes) > 0.9, false) AS paint_pass"),
        F.expr("coalesce(try_divide(keys, live_frames) > 0.75, false) AS over_keyed"))


def element_order(nodes: DataFrame) -> DataFrame:
    """Layers of usable shots in document order with their index inside the shot."""
    return ranked(nodes, ["shot"], F.col("ordinal"), ["ordinal"], "layer_index")


def subset(shots: DataFrame, catalogue: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """Tag shots from the fixed catalogue ``(shot, tier, reason)`` and keep the wanted tiers.

    Excluded and deferred shots stay visible with their reason; ``selected`` says which are in.
    """
    wanted = F.col("tier").isin(*tiers)
    return shots.join(catalogue, "shot", "left").select(
        *shots.columns, F.coalesce("tier", F.lit("unlisted")).alias("tier"), "reason",
        F.coalesce(wanted, F.lit(False)).alias("selected"))


def dataset_counts(elements: DataFrame, frames: DataFrame) -> DataFrame:
    """One row of corpus counts. Element and frame tables are aggregated apart, then joined."""
    e = elements.groupBy().agg(
        F.expr("count(DISTINCT shot) AS shots"), F.expr("count(1) AS elements"),
        F.expr("count_if(grade = 'gold') AS gold"),
        F.expr("count_if(grade IS NULL OR grade <> 'gold') AS silver"),
        F.expr("sum(shapes) AS shapes"), F.expr("count_if(in_train) AS trained_elements"))
    f = frames.groupBy().agg(F.expr("count(1) AS frames"), F.expr("count_if(held) AS frames_held"))
    return e.crossJoin(F.broadcast(f))


def profile(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """min / median / p90 / max / mean / distinct / mode of a column per group."""
    by = list(by)
    q = exact_quantiles(df, by, value, {"median": 0.5, "p90": 0.9})
    m = mode_of(df, by, value)
    basic = df.groupBy(*by).agg(
        F.expr(f"min({value}) AS min"), F.expr(f"max({value}) AS max"),
        F.expr(f"avg({value}) AS mean"), F.expr(f"count(DISTINCT {value}) AS distinct_values"))
    return basic.join(q, by).join(m, by) if by else basic.crossJoin(q).crossJoin(m)


def shape_desc(shapes: DataFrame, give_point_count: bool = True) -> DataFrame:
    """``(P / Pmax, closed, C / Cmax)`` with the maxima taken inside the element."""
    wide = with_totals(shapes, ["element_id"], {"_p": ("max", F.col("n_points")),
                                                "_c": ("max", F.col("n_coords"))}, spread("shape_id"))
    cols = [F.expr("CAST(closed AS DOUBLE) AS desc_closed"), F.expr("n_coords / _c AS desc_coords")]
    if give_point_count:
        cols.insert(0, F.expr("n_points / _p AS desc_points"))
    return wide.select("element_id", "shape_id", *cols)


def padded_size(shapes: DataFrame, frames: DataFrame) -> DataFrame:
    """Floats a padded ``keys x shapes x points x coords x 2`` block would need per element."""
    s = shapes.groupBy("element_id").agg(
        F.expr("count(1) AS n_shapes"), F.expr("max(path_keys) AS max_keys"),
        F.expr("max(n_points) AS max_points"), F.expr("max(n_coords) AS max_coords"),
        F.expr("sum(path_keys * n_points * n_coords * 2) AS real_floats"))
    return s.withColumn("padded_floats",
                        F.expr("n_shapes * max_keys * max_points * max_coords * 2"))


def canonical_order(cells: DataFrame, points: DataFrame, shapes: DataFrame) -> DataFrame:
    """Slot of each shape: by group, then centroid (y, x) on its reference frame, then index.

    ``cells`` (element_id, shape_id, frame, live), ``points`` (element_id, shape_id, frame, x, y),
    ``shapes`` (element_id, shape_id, group_id). The reference frame is the element's busiest
    (earliest on a tie); a shape absent there uses its own first live frame, else frame 0.
    """
    per_frame = cells.groupBy("element_id", "frame").agg(F.expr("count_if(live) AS n"))
    ref = per_frame.groupBy("element_id").agg(
        F.expr("CASE WHEN max(n) > 0 THEN min_by(frame, struct(-n, frame)) ELSE 0 END AS ref"))
    # Liveness on the reference frame and the first live frame, one row per shape.
    first = cells.where("live").groupBy("element_id", "shape_id").agg(F.expr("min(frame) AS first_live"))
    at_ref = cells.where("live").join(ref, [cells.element_id == ref.element_id,
                                            cells.frame == ref.ref], "left_semi").select(
        "element_id", "shape_id", F.col("frame").alias("at_ref"))
    pick = (shapes.join(first, ["element_id", "shape_id"], "left")
            .join(at_ref, ["element_id", "shape_id"], "left")
            .withColumn("frame", F.expr("coalesce(at_ref, first_live, 0)")))
    centre = (pick.select("element_id", "shape_id", "frame")
              .join(points, ["element_id", "shape_id", "frame"])
              .groupBy("element_id", "shape_id").agg(F.expr("round(avg(x), 9) AS cx"),
                                                     F.expr("round(avg(y), 9) AS cy")))
    placed = pick.join(centre, ["element_id", "shape_id"], "left").na.fill(0.0, ["cx", "cy"])
    return ranked(placed.select("element_id", "shape_id", "group_id", "cx", "cy"), ["element_id"],
                  F.col("group_id"), ["group_id", "cy", "cx", "shape_id"], "slot")


def apply_order(df: DataFrame, order: DataFrame, to_slots: bool = True) -> DataFrame:
    """Move per-shape rows between document order (``shape_id``) and slot order (``slot``)."""
    have = "shape_id" if to_slots else "slot"
    want = "slot" if to_slots else "shape_id"
    key = order.select("element_id", have, want)
    return df.join(key, ["element_id", have]).drop(have)
