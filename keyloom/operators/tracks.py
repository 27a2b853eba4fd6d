"""Sparse keyed tracks: sampling, smoothing, windows, fills and temporal metrics.

Keys are rows ``(by, frame, interp, value ARRAY<DOUBLE>)``; dense tracks are rows with an integer
``frame``. A key's interpolation mode describes the segment that starts at it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expr import ratio
from ..functions.ordered import CHUNK, chunk_id, last_known, positions, stencil, with_totals

BEFORE_ALL = -2147483647
"""A frame earlier than any real one."""

# Uniform Catmull-Rom and linear rules over the segment's own end values p1, p2.
_CATMULL = ("zip_with(zip_with(p0, p1, (a, b) -> struct(a, b)), zip_with(p2, p3, (c, d) -> struct(c, d)), "
            "(l, r) -> 0.5D * (2 * l.b + (r.c - l.a) * _u + (2 * l.a - 5 * l.b + 4 * r.c - r.d) * _u * _u "
            "+ (-l.a + 3 * l.b - 3 * r.c + r.d) * _u * _u * _u))")
_LINEAR = "zip_with(p1, p2, (a, b) -> a * (1 - _u) + b * _u)"


def with_key_index(keys: DataFrame, by: Sequence[str], size: int = CHUNK) -> DataFrame:
    """Dense position ``kidx`` of each key inside its track."""
    return positions(keys, by, ["frame"], chunk_id("frame", size), "kidx")


def segments(keys: DataFrame, by: Sequence[str], size: int = CHUNK) -> DataFrame:
    """One row per key with the neighbours its segment needs: ``f0, f1, p0..p3, interp``.

    A missing outer neighbour is the segment's own end value. ``f1`` is null on the last key.
    """
    idx = with_key_index(keys, by, size)
    st = stencil(idx, by, "kidx", {
        "_a": lambda w: F.lag("value").over(w), "_n": lambda w: F.lead("value").over(w),
        "_b": lambda w: F.lead("value", 2).over(w), "f1": lambda w: F.lead("frame").over(w)}, 2, size)
    return st.select(*by, "kidx", F.col("frame").alias("f0"), "f1", "interp",
                     F.coalesce("_a", "value").alias("p0"), F.col("value").alias("p1"),
                     F.coalesce("_n", "value").alias("p2"),
                     F.coalesce("_b", "_n", "value").alias("p3"))


def _value(mode: str | None) -> str:
    """SQL for the sampled value; ``mode`` overrides the keys' own interpolation."""
    m = "interp" if mode is None else f"'{mode}'"
    flat = "f1 IS NULL OR frame <= f0 OR f1 = f0"
    same = "size(p0) = size(p1) AND size(p1) = size(p2) AND size(p2) = size(p3)"
    return (f"CASE WHEN {flat} OR {m} = 'hold' THEN p1 "
            f"WHEN {m} = 'catmullrom' AND {same} THEN {_CATMULL} ELSE {_LINEAR} END")


def sample_track(keys: DataFrame, frames: DataFrame, by: Sequence[str], mode: str | None = None,
                 size: int = CHUNK) -> DataFrame:
    """Value of each track at each requested frame, held flat outside the keyed range.

    No range join: keys and requested frames are merged on the frame axis and every request
    looks back for its segment, so cost is linear in rows and gaps between keys cost nothing.
    """
    if mode not in (None, "hold", "linear", "catmullrom"):
        raise ValueError(f"unknown interpolation {mode!r}")
    seg = segments(keys, by, size)
    # The first segment is also planted before every frame, so early requests find it too.
    packed = seg.select(*by, F.explode(F.expr(
        f"CASE WHEN kidx = 0 THEN array({BEFORE_ALL}, f0) ELSE array(f0) END")).alias("frame"),
                        F.struct("f0", "f1", "interp", "p0", "p1", "p2", "p3").alias("seg"),
                        F.lit(False).alias("_ask"))
    asked = frames.select(*by, "frame", F.lit(None).cast(packed.schema["seg"].dataType).alias("seg"),
                          F.lit(True).alias("_ask"))
    both = packed.unionByName(asked).groupBy(*by, "frame").agg(
        F.first("seg", ignorenulls=True).alias("seg"), F.bool_or("_ask").alias("_ask"))
    found = last_known(both, by, "frame", {"_seg": F.col("seg")}, size, keep=[*by, "frame", "_ask"])
    out = found.where("_ask AND _seg IS NOT NULL")
    u = "(frame - f0) / CAST(f1 - f0 AS DOUBLE)"
    flat = out.select(*by, "frame", "_seg.*")
    flat = flat.withColumn("_u", F.expr(f"CASE WHEN f1 > f0 THEN {u} ELSE 0D END"))
    return flat.select(*by, "frame", F.expr(_value(mode)).alias("value"))


def dense_axis(spans: DataFrame, by: Sequence[str], lo: str = "lo", hi: str = "hi",
               step: int = 1) -> DataFrame:
    """Every frame of ``[lo, hi]`` on a stride; one narrow explode."""
    return spans.select(*by, F.explode(F.sequence(F.col(lo), F.col(hi), F.lit(step))).alias("frame"))


def key_axis(keys: DataFrame, rendered: DataFrame, by: Sequence[str]) -> DataFrame:
    """Dense span covering the rendered frames and every key outside them."""
    k = keys.groupBy(*by).agg(F.min("frame").alias("_klo"), F.max("frame").alias("_khi"))
    r = rendered.groupBy(*by).agg(F.min("frame").alias("_rlo"), F.max("frame").alias("_rhi"))
    return k.join(r, list(by), "full").select(
        *by, F.least("_klo", "_rlo").alias("lo"), F.greatest("_khi", "_rhi").alias("hi"))


def key_mask(keys: DataFrame, frames: DataFrame, by: Sequence[str]) -> DataFrame:
    """Is this cell a key; keys outside the rendered frames simply find no cell."""
    k = keys.select(*by, "frame").distinct().withColumn("_k", F.lit(True))
    return frames.join(k, [*by, "frame"], "left").select(
        *frames.columns, F.coalesce("_k", F.lit(False)).alias("is_key"))


def _fit(window: int) -> str:
    """Largest odd window that fits in ``_t`` positions, or 1."""
    odd = "(CASE WHEN _t % 2 = 1 THEN _t ELSE _t - 1 END)"
    w = f"least({window}, {odd})"
    return f"greatest(1, {w} - CASE WHEN {w} % 2 = 0 THEN 1 ELSE 0 END)"


def savgol_fit(window: int, order: int) -> np.ndarray:
    """Rows of weights: coefficient k of the least-squares polynomial over one window, around its centre."""
    half = window // 2
    return np.linalg.pinv(np.vander(np.arange(-half, half + 1, dtype=float), min(order, window - 1) + 1, increasing=True))


def savgol_weights(window: int, order: int) -> list[tuple[int, int, float]]:
    """``(out_offset, in_offset, weight)``: least-squares polynomial fit over one window."""
    half = window // 2
    x = np.arange(-half, half + 1, dtype=float)
    basis = np.vander(x, min(order, window - 1) + 1, increasing=True)
    fit = basis @ np.linalg.pinv(basis)
    return [(int(o - half), int(i - half), float(fit[o, i]))
            for o in range(window) for i in range(window)]


def smooth(df: DataFrame, by: Sequence[str], values: Sequence[str], window: int,
           kind: str = "boxcar", order: int = 2, position: str = "frame",
           size: int = CHUNK) -> DataFrame:
    """Smooth along a dense 0-based position. Tracks under 3 positions pass through unchanged.

    boxcar: centred mean with the end values repeated. savgol: centred least-squares kernel; the
    first and last half-window come from the polynomial fitted to the first / last full window.
    """
    if kind not in ("boxcar", "savgol"):
        raise ValueError(f"unknown smoothing kind {kind!r}")
    if window <= 1:
        return df
    sized = with_totals(df, by, {"_t": ("count", F.lit(1))}, chunk_id(position, size))
    sized = sized.withColumn("_w", F.expr(f"CASE WHEN _t < 3 THEN 1 ELSE {_fit(window)} END"))
    stages = _boxcar_stages(values, window, position) if kind == "boxcar" else _savgol_stages(values, window, order, position)
    wide = stencil(sized, by, position, stages, window, size)
    outs = [F.when(F.col("_w") <= 1, F.col(v)).otherwise(F.col(f"_o_{v}")).alias(v) for v in values]
    return wide.select(*[c for c in df.columns if c not in values], *outs)


def _widths(window: int) -> list[int]:
    """The widths in use: a track shorter than the window has its own, the largest odd one."""
    return list(range(window if window % 2 else window - 1, 1, -2))


def _boxcar_stages(values: Sequence[str], window: int, position: str) -> list[dict]:
    """The rows in reach, summed by a frame of constant width; what lies past an end counts as the end value."""
    def mean(w, v: str):
        out = F.lit(None).cast("double")
        for width in _widths(window):
            half = width // 2
            near = w.rangeBetween(-half, half)
            before = F.greatest(F.lit(half) - F.col(position), F.lit(0)) * F.first(v).over(near)
            after = F.greatest(F.col(position) + half - (F.col("_t") - 1), F.lit(0)) * F.last(v).over(near)
            out = F.when(F.col("_w") == width, (F.sum(v).over(near) + before + after) / width).otherwise(out)
        return out
    return [{f"_o_{v}": lambda w, v=v: mean(w, v) for v in values}]


def _savgol_stages(values: Sequence[str], window: int, order: int, position: str) -> list[dict]:
    """Polynomial coefficients of each row's own window as constant-weight sums of its neighbours; rows near an end
    read those of the first or last full window."""
    top, terms = _widths(window)[0] // 2, min(order, window - 1) + 1
    near = {f"_v_{v}_{d}": (lambda w, v=v, d=d: F.lag(v, -d).over(w)) for v in values for d in range(-top, top + 1)}

    def coefficient(v: str, k: int):
        out = F.lit(None).cast("double")
        for width in _widths(window):
            fit = savgol_fit(width, order)
            if k < len(fit):
                own = sum((F.lit(float(c)) * F.col(f"_v_{v}_{d}") for d, c in zip(range(-(width // 2), width // 2 + 1), fit[k])), F.lit(0.0))
                out = F.when(F.col("_w") == width, own).otherwise(out)
        return out
    own = {f"_c_{v}_{k}": (lambda w, v=v, k=k: coefficient(v, k)) for v in values for k in range(terms)}
    half = F.floor(F.col("_w") / 2)
    first, last = F.col(position) == half, F.col(position) == F.col("_t") - 1 - half
    ends = {f"_{side}_{v}_{k}": (lambda w, v=v, k=k, here=here, frame=frame: F.max(F.when(here, F.col(f"_c_{v}_{k}"))).over(w.rangeBetween(*frame)))
            for side, here, frame in (("f", first, (0, top)), ("l", last, (-top, 0))) for v in values for k in range(terms)}

    def value(v: str):
        def at(side: str, away):
            return sum((F.coalesce(F.col(f"_{side}_{v}_{k}"), F.lit(0.0)) * F.pow(away.cast("double"), F.lit(k)) for k in range(1, terms)), F.col(f"_{side}_{v}_0"))
        return (F.when(F.col(position) < half, at("f", F.col(position) - half))
                .when(F.col(position) > F.col("_t") - 1 - half, at("l", F.col(position) - (F.col("_t") - 1 - half))).otherwise(F.col(f"_c_{v}_0")))
    return [near, own, ends, {f"_o_{v}": lambda w, v=v: value(v) for v in values}]


def context_window(df: DataFrame, by: Sequence[str], value: str, n: int, order: str = "frame",
                   size: int = CHUNK) -> DataFrame:
    """``n`` columns of neighbours at offsets ``-(n//2) .. n - n//2 - 1``, clamped at track ends.

    A gap inside a track is an error, raised when the row is evaluated.
    """
    half = n // 2
    cols = {f"{value}_{k}": (lambda w, k=k: F.lag(value, half - k).over(w) if k <= half
                             else F.lead(value, k - half).over(w)) for k in range(n)}
    edges = {"_prev": lambda w: F.lag(order).over(w),
             "_first": lambda w: F.first(value).over(w.rowsBetween(-half, 0)),
             "_last": lambda w: F.last(value).over(w.rowsBetween(0, max(half, 1)))}
    wide = stencil(df, by, order, {**cols, **edges}, n + 1, size)
    # ``_first``/``_last`` reach the track's end exactly where a neighbour is missing.
    checked = F.when(F.col("_prev").isNotNull() & (F.col("_prev") != F.col(order) - 1),
                     F.raise_error(F.lit("frames are not contiguous")).cast(dict(df.dtypes)[value]))
    outs = [F.coalesce(checked, F.col(f"{value}_{k}"), F.col("_first") if k <= half else F.col("_last"))
            .alias(f"{value}_{k}") for k in range(n)]
    return wide.select(*by, order, *outs)


def track_jitter(df: DataFrame, by: Sequence[str], point: Sequence[str], out_px: float,
                 size: int = CHUNK) -> DataFrame:
    """Mean change of the error vector between adjacent frames live at both, in pixels.

    Rows: ``(by, point, frame, px, py, tx, ty, live)``; groups with nothing to compare give 0.
    """
    e = df.selectExpr(*by, *point, "frame", "live", "px - tx AS ex", "py - ty AS ey")
    st = stencil(e, [*by, *point], "frame", {
        "lx": lambda w: F.lag("ex").over(w), "ly": lambda w: F.lag("ey").over(w),
        "ll": lambda w: F.lag("live").over(w)}, 1, size)
    step = F.expr(f"CASE WHEN live AND ll THEN sqrt(power(ex - lx, 2) + power(ey - ly, 2)) * {out_px}D END")
    return st.groupBy(*by).agg(F.coalesce(F.avg(step), F.lit(0.0)).alias("jitter_px"))


def temporal_error(df: DataFrame, by: Sequence[str], point: Sequence[str],
                   coords: Sequence[tuple[str, str]], size: int = CHUNK) -> DataFrame:
    """Masked L1 of the predicted against the true step, over frames exactly one apart."""
    diffs = {f"_d{i}": f"{p} - {t}" for i, (p, t) in enumerate(coords)}
    e = df.selectExpr(*by, *point, "frame", "live", *[f"{x} AS {n}" for n, x in diffs.items()])
    lags = {f"{n}_p": (lambda w, n=n: F.lag(n).over(w)) for n in diffs}
    st = stencil(e, [*by, *point], "frame", {
        **lags, "_lf": lambda w: F.lag("frame").over(w), "_ll": lambda w: F.lag("live").over(w)}, 1, size)
    use = "live AND _ll AND frame - _lf = 1"
    total = " + ".join(f"abs({n} - {n}_p)" for n in diffs)
    return st.groupBy(*by).agg(
        F.expr(f"coalesce(try_divide(sum(CASE WHEN {use} THEN {total} END), "
               f"count_if({use}) * {len(diffs)}), 0D) AS temporal_error"))


def fill_track(df: DataFrame, by: Sequence[str], values: Sequence[str], order: str = "frame",
               size: int = CHUNK) -> DataFrame:
    """Carry the last known value forward; leading blanks take the first known value."""
    keep = [c for c in df.columns if c not in values]
    ahead = last_known(df, by, order, {f"_f_{v}": F.col(v) for v in values}, size)
    # Looking forward, the next known value of a leading blank is the first known one.
    both = last_known(ahead, by, order, {f"_b_{v}": F.col(v) for v in values}, size, backward=True,
                      keep=[*keep, *[f"_f_{v}" for v in values]])
    return both.select(*keep, *[F.coalesce(f"_f_{v}", f"_b_{v}").alias(v) for v in values])


def segment_cost(df: DataFrame, by: Sequence[str], coords: Sequence[str], max_span: int,
                 order: str = "frame", inv_tol: str | None = None, size: int = CHUNK) -> DataFrame:
    """Worst chord error of every segment ``(a, b)`` with ``b - a <= max_span``.

    Each start carries its next ``max_span`` positions (a bounded array), so no self-join is
    needed and the work per row is the span cap, whatever the track's length.
    """
    ahead = F.struct(F.col(order).alias("f"), *coords, *([inv_tol] if inv_tol else []))
    st = stencil(df, by, order, {
        "_win": lambda w: F.collect_list(ahead).over(w.rowsBetween(0, max_span))}, max_span, size)
    seg = st.select(*by, F.col(order).alias("a"), "_win",
                    F.explode(F.expr("sequence(1, size(_win) - 1)")).alias("_n")).where("size(_win) > 1")
    miss = " + ".join(
        f"power(e.{c} - (_win[0].{c} * (1 - (e.f - a) / CAST(_n AS DOUBLE)) + _win[_n].{c} * ((e.f - a) / CAST(_n AS DOUBLE))), 2)"
        for c in coords)
    scale = f" * e.{inv_tol}" if inv_tol else ""
    cost = (f"coalesce(array_max(transform(slice(_win, 2, _n - 1), e -> sqrt({miss}){scale})), 0D)")
    return seg.selectExpr(*by, "a", "a + _n AS b", f"{cost} AS cost")


def local_tol(df: DataFrame, tol: float, bias: float, slack: float, prob: str = "p") -> DataFrame:
    """Per-frame tolerance from a key probability, clipped to 0.2x .. 4x."""
    if not (bias or slack):
        return df.withColumn("tol", F.lit(float(tol)))
    p = f"least(greatest({prob}, 0D), 1D)"
    scale = f"1D - {bias}D * {p} + {slack}D * (1D - {p})"
    return df.withColumn("tol", F.expr(
        f"CASE WHEN {prob} IS NULL THEN {tol}D ELSE {tol}D * least(greatest({scale}, 0.2D), 4.0D) END"))
