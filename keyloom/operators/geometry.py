"""Points, matrices, curves and crop windows.

Matrices are row-major ``ARRAY<DOUBLE>`` of length 16 acting on row vectors ``[x, y, 0, 1]``, so
translation sits in the last row and composition runs leaf first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import identity4, matmul4
from ..functions.ordered import (CHUNK, chunk_id, ranked, running_sum, spread, stencil, with_totals)
from .tracks import fill_track, smooth

# The eight varying entries of a planar homography, in order (the ninth, m33, is 1).
PROJ_INDEX = (0, 1, 3, 4, 5, 7, 12, 13)
AFFINE_INDEX = (0, 1, 4, 5, 12, 13)


def _nonzero(w: str, eps: str) -> str:
    return f"CASE WHEN abs({w}) < {eps} THEN 1D ELSE {w} END"


def local_to_crop(df: DataFrame, matrix: str = "matrix", out: tuple[str, str] = ("cx", "cy")) -> DataFrame:
    """Local normalised point to [0, 1] across the crop window.

    Reads ``x, y, matrix, width, height, x0, y0, scale, out_px`` from the row.
    """
    m = [f"{matrix}[{i}]" for i in range(16)]
    w = _nonzero(f"(x * {m[3]} + y * {m[7]} + {m[15]})", "1e-12")
    nx = f"((x * {m[0]} + y * {m[4]} + {m[12]}) / ({w}))"
    ny = f"((x * {m[1]} + y * {m[5]} + {m[13]}) / ({w}))"
    return df.select(
        "*", F.expr(f"({nx} * height + width / 2D - x0) * scale / out_px").alias(out[0]),
        F.expr(f"({ny} * height + height / 2D - y0) * scale / out_px").alias(out[1]))


def crop_to_local(df: DataFrame, matrix: str = "matrix", cx: str = "cx", cy: str = "cy",
                  out: tuple[str, str] = ("lx", "ly")) -> DataFrame:
    """Exact inverse of ``local_to_crop`` by the 3x3 adjugate (row and column 2 are constant)."""
    m = [f"{matrix}[{i}]" for i in range(16)]
    a, b, c, d, e, f, g, h, i = (m[k] for k in (0, 1, 3, 4, 5, 7, 12, 13, 15))
    nx = f"(({cx} * out_px / scale + x0 - width / 2D) / height)"
    ny = f"(({cy} * out_px / scale + y0 - height / 2D) / height)"
    # [nx, ny, 1] times the adjugate of [[a b c], [d e f], [g h i]]; the determinant cancels.
    u = f"({nx} * ({e} * {i} - {f} * {h}) + {ny} * ({f} * {g} - {d} * {i}) + ({d} * {h} - {e} * {g}))"
    v = f"({nx} * ({c} * {h} - {b} * {i}) + {ny} * ({a} * {i} - {c} * {g}) + ({b} * {g} - {a} * {h}))"
    w = f"({nx} * ({b} * {f} - {c} * {e}) + {ny} * ({c} * {d} - {a} * {f}) + ({a} * {e} - {b} * {d}))"
    return df.select("*", F.expr(f"{u} / ({_nonzero(w, '1e-300')})").alias(out[0]),
                     F.expr(f"{v} / ({_nonzero(w, '1e-300')})").alias(out[1]))


def crop_matrix(df: DataFrame, name: str = "crop_matrix") -> DataFrame:
    """Per-row matrix of the window map, so that local to crop is one product ``M @ C``."""
    s = "height * scale / out_px"
    return df.withColumn(name, F.expr(
        f"array({s}, 0D, 0D, 0D, 0D, {s}, 0D, 0D, 0D, 0D, 1D, 0D, (width / 2D - x0) * scale / out_px, "
        "(height / 2D - y0) * scale / out_px, 0D, 1D)"))


def matmul(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return df.withColumn(name, matmul4(F.col(a), F.col(b)))


def trs_matrix(df: DataFrame, name: str = "trs") -> DataFrame:
    """``T(-anchor) S R T(anchor + position)`` in closed form; null when everything is identity.

    Reads ``ax, ay, px, py, sx, sy, rot`` (degrees).
    """
    c, s = "cos(radians(rot))", "sin(radians(rot))"
    body = (f"array(sx * {c}, sx * {s}, 0D, 0D, -sy * {s}, sy * {c}, 0D, 0D, 0D, 0D, 1D, 0D, "
            f"-ax * sx * {c} + ay * sy * {s} + ax + px, -ax * sx * {s} - ay * sy * {c} + ay + py, 0D, 1D)")
    same = "ax = 0 AND ay = 0 AND px = 0 AND py = 0 AND sx = 1 AND sy = 1 AND rot = 0"
    return df.withColumn(name, F.expr(f"CASE WHEN {same} THEN NULL ELSE {body} END"))


def layer_matrix(df: DataFrame, trs: str = "trs", baked: str = "baked", name: str = "matrix") -> DataFrame:
    """TRS first, then the baked matrix; null when neither exists."""
    both = F.col(trs).isNotNull() & F.col(baked).isNotNull()
    return df.withColumn(name, F.when(both, matmul4(F.col(trs), F.col(baked)))
                         .otherwise(F.coalesce(trs, baked)))


def compose(chain: DataFrame, by: Sequence[str], depth: str = "depth", matrix: str = "matrix") -> DataFrame:
    """Multiply a node's ancestor matrices leaf first. Group size is the tree depth."""
    ordered = F.array_sort(F.collect_list(F.when(
        F.col(matrix).isNotNull(), F.struct((-F.col(depth)).alias("d"), F.col(matrix).alias("m")))))
    return chain.groupBy(*by).agg(ordered.alias("_ms")).select(
        *by, F.aggregate("_ms", identity4(), lambda acc, e: matmul4(acc, e["m"])).alias("matrix"))


def group_tracks(tracks: DataFrame, element: Sequence[str], owner: str = "shape_id",
                 order: str = "frame", value: str = "matrix", size: int = CHUNK) -> DataFrame:
    """Owners whose whole tracks are equal share a group id, numbered by first owner.

    Tracks are hashed chunk by chunk and the chunk hashes hashed again, so no track is gathered
    whole.
    """
    el = list(element)
    part = tracks.groupBy(*el, owner, chunk_id(order, size).alias("_c")).agg(F.sha2(F.to_json(
        F.array_sort(F.collect_list(F.struct(order, value)))), 256).alias("_h"))
    whole = part.groupBy(*el, owner).agg(F.sha2(F.to_json(
        F.array_sort(F.collect_list(F.struct("_c", "_h")))), 256).alias("_sig"))
    firsts = whole.groupBy(*el, "_sig").agg(F.min(owner).alias("_first"))
    ids = ranked(firsts, el, F.col("_first"), ["_first"], "group_id")
    return whole.join(ids.select(*el, "_sig", "group_id"), [*el, "_sig"]).drop("_sig")


def proj_encode(df: DataFrame, matrix: str = "matrix", name: str = "proj") -> DataFrame:
    """Eight numbers after dividing by ``m33``; a vanishing ``m33`` is an error."""
    entries = ", ".join(f"{matrix}[{i}] / {matrix}[15]" for i in PROJ_INDEX)
    return df.withColumn(name, F.expr(
        f"CASE WHEN abs({matrix}[15]) <= 1e-9 THEN raise_error('m33 is zero') ELSE array({entries}) END"))


def _decode(index: Sequence[int], src: str) -> str:
    cells = {k: f"{src}[{n}]" for n, k in enumerate(index)}
    cells.setdefault(10, "1D")
    cells.setdefault(15, "1D")
    return "array(" + ", ".join(cells.get(i, "0D") for i in range(16)) + ")"


def proj_decode(df: DataFrame, proj: str = "proj", name: str = "decoded") -> DataFrame:
    return df.withColumn(name, F.expr(_decode(PROJ_INDEX, proj)))


def affine_encode(df: DataFrame, matrix: str = "matrix", name: str = "affine") -> DataFrame:
    """Six numbers. Drops the perspective column; kept as the lossy control."""
    return df.withColumn(name, F.expr("array(" + ", ".join(f"{matrix}[{i}]" for i in AFFINE_INDEX) + ")"))


def affine_decode(df: DataFrame, affine: str = "affine", name: str = "decoded") -> DataFrame:
    return df.withColumn(name, F.expr(_decode(AFFINE_INDEX, affine)))


def group_probes(points: DataFrame, by: Sequence[str], live: str = "true") -> DataFrame:
    """Corners and centre of the bounding box of every live point of a group."""
    box = points.where(live).groupBy(*by).agg(
        F.expr("min(x) AS x0"), F.expr("max(x) AS x1"), F.expr("min(y) AS y0"), F.expr("max(y) AS y1"))
    corners = (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("(x0 + x1) / 2", "(y0 + y1) / 2"))
    probes = "array(" + ", ".join(f"named_struct('px', {x}, 'py', {y})" for x, y in corners) + ")"
    return box.select(*by, F.posexplode(F.expr(probes)).alias("probe", "_p")).select(
        *by, "probe", "_p.px", "_p.py")


def _projected(a: str) -> tuple[str, str]:
    w = f"(px * {a}[2] + py * {a}[5] + 1D)"
    w = f"(CASE WHEN abs({w}) < 1e-6 THEN 1e-6 ELSE {w} END)"
    return (f"((px * {a}[0] + py * {a}[3] + {a}[6]) / {w})", f"((px * {a}[1] + py * {a}[4] + {a}[7]) / {w})")


def probe_error(df: DataFrame, by: Sequence[str], out_px: float = 1.0, live: str = "true") -> DataFrame:
    """Mean absolute displacement of probes under predicted against true 8-number maps.

    Rows carry ``px, py, pred, truth``; ``live`` masks groups with nothing on screen.
    """
    (ux, uy), (tx, ty) = _projected("pred"), _projected("truth")
    return df.groupBy(*by).agg(F.expr(
        f"coalesce(try_divide(sum(CASE WHEN {live} THEN abs({ux} - {tx}) + abs({uy} - {ty}) END), "
        f"2 * count_if({live})), 0D) * {out_px}D AS probe_error"))


def probe_temporal_error(df: DataFrame, by: Sequence[str], track: Sequence[str], out_px: float = 1.0,
                         size: int = CHUNK) -> DataFrame:
    """The probe error of the frame-to-frame motion, for frames one apart and live at both."""
    (ux, uy), (tx, ty) = _projected("pred"), _projected("truth")
    e = df.select(*by, *[c for c in track if c not in by], "frame", "live",
                  F.expr(f"{ux} - {tx}").alias("ex"), F.expr(f"{uy} - {ty}").alias("ey"))
    st = stencil(e, track, "frame", {
        "_x": lambda w: F.lag("ex").over(w), "_y": lambda w: F.lag("ey").over(w),
        "_l": lambda w: F.lag("live").over(w), "_f": lambda w: F.lag("frame").over(w)}, 1, size)
    ok = "live AND _l AND frame - _f = 1"
    return st.groupBy(*by).agg(F.expr(
        f"coalesce(try_divide(sum(CASE WHEN {ok} THEN abs(ex - _x) + abs(ey - _y) END), 2 * count_if({ok})), 0D)"
        f" * {out_px}D AS probe_temporal_error"))


OPEN_RULES = ("triplicate", "duplicate", "reflect", "interior")


def _control_rows(rule: str) -> str:
    """SQL array of ``struct(q, w)``: slots of the extended polygon a control point feeds."""
    s = "struct({} AS q, CAST({} AS DOUBLE) AS w)"
    closed = ("filter(array(" + s.format("idx + 1", 1) + ", " + s.format("CASE WHEN idx = n - 1 THEN 0 END", 1)
              + ", " + s.format("CASE WHEN idx = 0 THEN n + 1 END", 1) + ", "
              + s.format("CASE WHEN idx = 1 % n THEN n + 2 END", 1) + "), e -> e.q IS NOT NULL)")
    if rule == "triplicate":
        ext = [("idx + 2", 1), ("CASE WHEN idx = 0 THEN 0 END", 1), ("CASE WHEN idx = 0 THEN 1 END", 1),
               ("CASE WHEN idx = n - 1 THEN n + 2 END", 1), ("CASE WHEN idx = n - 1 THEN n + 3 END", 1)]
    elif rule == "duplicate":
        ext = [("idx + 1", 1), ("CASE WHEN idx = 0 THEN 0 END", 1), ("CASE WHEN idx = n - 1 THEN n + 1 END", 1)]
    elif rule == "reflect":
        ext = [("idx + 1", 1), ("CASE WHEN idx = 0 THEN 0 END", "CASE WHEN n < 2 THEN 1 ELSE 2 END"),
               ("CASE WHEN idx = 1 THEN 0 END", -1),
               ("CASE WHEN idx = n - 1 THEN n + 1 END", "CASE WHEN n < 2 THEN 1 ELSE 2 END"),
               ("CASE WHEN idx = n - 2 THEN n + 1 END", -1)]
    else:
        ext = [("idx", 1)]
    opened = "filter(array(" + ", ".join(s.format(q, w) for q, w in ext) + "), e -> e.q IS NOT NULL)"
    return f"CASE WHEN closed THEN {closed} ELSE {opened} END"


_EXTRA = {"triplicate": 1, "duplicate": -1, "reflect": -1, "interior": -3}
_BASIS = ("power(1 - t, 3) / 6", "(3 * power(t, 3) - 6 * t * t + 4) / 6",
          "(-3 * power(t, 3) + 3 * t * t + 3 * t + 1) / 6", "power(t, 3) / 6")


def curve_points(points: DataFrame, by: Sequence[str], samples: int = 12, rule: str = "triplicate"
                 ) -> DataFrame:
    """Uniform cubic B-spline samples from long control points ``(by, idx, n, closed, x, y)``.

    Each control point adds its basis weight to the samples it reaches, so a curve is one
    partial aggregation keyed on (curve, sample). Too few points for a segment returns the points.
    """
    if rule not in OPEN_RULES:
        raise ValueError(f"unknown open end rule {rule!r}, want one of {OPEN_RULES}")
    p = points.withColumn("_segs", F.expr(f"CASE WHEN closed THEN n ELSE n + {_EXTRA[rule]} END"))
    curve = p.where("_segs >= 1").select(*by, "closed", "_segs", "x", "y",
                                         F.explode(F.expr(_control_rows(rule))).alias("_e"))
    spans = curve.select(*by, "closed", "_segs", "x", "y", F.col("_e.q").alias("q"), F.col("_e.w").alias("w"),
                         F.explode(F.array(*[F.lit(j) for j in range(4)])).alias("j"))
    spans = spans.withColumn("seg", F.expr("q - j")).where("seg >= 0 AND seg < _segs")
    spans = spans.select("*", F.explode(F.expr(
        f"CASE WHEN NOT closed AND seg = _segs - 1 THEN sequence(0, {samples}) ELSE sequence(0, {samples - 1}) END"
    )).alias("k")).withColumn("t", F.expr(f"k / {samples}D"))
    basis = "CASE j " + " ".join(f"WHEN {j} THEN {b}" for j, b in enumerate(_BASIS)) + " END"
    drawn = spans.select(*by, F.expr(f"CAST(seg * {samples} + k AS INT)").alias("sample"),
                         F.expr(f"w * ({basis})").alias("b"), "x", "y").groupBy(*by, "sample").agg(
        F.expr("sum(b * x) AS x"), F.expr("sum(b * y) AS y"))
    short = p.where("_segs < 1").select(*by, F.col("idx").cast("int").alias("sample"), "x", "y")
    return drawn.unionByName(short)


def bezier_points(points: DataFrame, by: Sequence[str], samples: int = 12) -> DataFrame:
    """Point / in-handle / out-handle curves: ``(by, idx, n, closed, x, y, ix, iy, ox, oy)``.

    A point feeds the segment it starts (anchor, out-handle) and the one it ends (in-handle,
    anchor).
    """
    starts = "named_struct('seg', idx, 'ax', x, 'ay', y, 'hx', ox, 'hy', oy, 'a', 0, 'h', 1)"
    ends = "named_struct('seg', pmod(idx - 1, n), 'ax', x, 'ay', y, 'hx', ix, 'hy', iy, 'a', 3, 'h', 2)"
    rows = points.select(*by, "closed", F.expr("CASE WHEN closed THEN n ELSE n - 1 END").alias("_segs"),
                         F.explode(F.expr(f"array({starts}, {ends})")).alias("_e"))
    rows = rows.select(*by, "closed", "_segs", "_e.*").where("seg < _segs")
    rows = rows.select("*", F.explode(F.expr(
        f"CASE WHEN NOT closed AND seg = _segs - 1 THEN sequence(0, {samples}) ELSE sequence(0, {samples - 1}) END"
    )).alias("k")).withColumn("t", F.expr(f"k / {samples}D"))
    wa = "CASE a WHEN 0 THEN power(1 - t, 3) ELSE power(t, 3) END"
    wh = "CASE h WHEN 1 THEN 3 * (1 - t) * (1 - t) * t ELSE 3 * (1 - t) * t * t END"
    return rows.groupBy(*by, F.expr(f"CAST(seg * {samples} + k AS INT)").alias("sample")).agg(
        F.expr(f"sum(({wa}) * ax + ({wh}) * hx) AS x"), F.expr(f"sum(({wa}) * ay + ({wh}) * hy) AS y"))


def curve_error(pred: DataFrame, truth: DataFrame, by: Sequence[str], track: Sequence[str],
                samples: int = 4, out_px: float = 1.0) -> DataFrame:
    """Mean L1 between predicted and true polylines of live curves of three or more points.

    The curve is linear in its control points, so the difference of the polylines is the
    polyline of the differences: one pass instead of two curves and a join on samples.
    """
    key = [*track, "idx"]
    d = truth.where("live AND n >= 3").alias("t").join(pred.alias("p"), key).select(
        *key, "t.n", "t.closed", F.expr("p.x - t.x AS x"), F.expr("p.y - t.y AS y"))
    return curve_points(d, track, samples).groupBy(*by).agg(
        F.expr(f"avg(abs(x) + abs(y)) / 2 * {out_px}D AS curve_error"))


def point_error(df: DataFrame, by: Sequence[str], out_px: float = 1.0) -> DataFrame:
    """Mean, exact p95 and max Euclidean error over live points, plus the L1 mean."""
    from ..functions.distribution import exact_quantiles
    e = df.where("live").select(
        *by, F.expr(f"sqrt(power(px - tx, 2) + power(py - ty, 2)) * {out_px}D AS err"),
        F.expr(f"(abs(px - tx) + abs(py - ty)) / 2 * {out_px}D AS l1"))
    main = e.groupBy(*by).agg(F.expr("avg(err) AS mean_err"), F.expr("max(err) AS max_err"),
                              F.expr("avg(l1) AS l1_err"))
    return main.join(exact_quantiles(e, by, "err", {"p95_err": 0.95}), list(by))


def crop_plan(boxes: DataFrame, by: Sequence[str] = ("element_id",), mode: str = "tracking",
              margin: float = 0.1, min_px: float = 1.0, smooth_offsets: int = 0,
              size: int = CHUNK) -> DataFrame:
    """Window size and per-frame offset from content boxes ``(bx, by_, bw, bh)``, null when empty.

    tracking: the size comes from the largest single-frame box and the window follows its centre;
    empty frames keep the last offset, leading ones take the first. static: one window over the
    union. An element empty on every frame is an error.
    """
    by = list(by)
    if mode == "static":
        t = {"_x0": ("min", F.col("bx")), "_y0": ("min", F.col("by_")),
             "_x1": ("max", F.expr("bx + bw")), "_y1": ("max", F.expr("by_ + bh"))}
        side = f"greatest(_x1 - _x0, _y1 - _y0, {float(min_px)}D)"
        cx, cy, empty = "(_x0 + _x1) / 2D", "(_y0 + _y1) / 2D", "_x0"
    elif mode == "tracking":
        t = {"_side": ("max", F.expr("greatest(bw, bh)"))}
        side, empty = f"greatest(_side, {float(min_px)}D)", "_side"
        cx, cy = "bx + bw / 2D", "by_ + bh / 2D"
    else:
        raise ValueError(f"unknown crop mode {mode!r}")
    wide = with_totals(boxes, by, t, chunk_id("frame", size))
    wide = wide.withColumn("size", F.expr(
        f"CASE WHEN {empty} IS NULL THEN raise_error('element is empty on every frame') "
        f"ELSE CAST(bround({side} * (1 + 2 * {float(margin)}D)) AS BIGINT) END"))
    out = wide.select(*by, "frame", "size", F.expr(f"CAST(bround({cx} - size / 2D) AS BIGINT) AS x0"),
                      F.expr(f"CAST(bround({cy} - size / 2D) AS BIGINT) AS y0"))
    if mode == "static":
        return out
    out = fill_track(out, by, ["x0", "y0"], "frame", size)
    if smooth_offsets > 1:
        d = out.selectExpr(*by, "frame", "size", "CAST(x0 AS DOUBLE) x0", "CAST(y0 AS DOUBLE) y0")
        d = smooth(d, by, ["x0", "y0"], smooth_offsets, "savgol", size=size)
        out = d.selectExpr(*by, "frame", "size", "CAST(bround(x0) AS BIGINT) AS x0",
                           "CAST(bround(y0) AS BIGINT) AS y0")
    return out


def off_source(plan: DataFrame, by: Sequence[str], width: int, height: int) -> DataFrame:
    """Frames whose window leaves the source rectangle."""
    out = f"x0 < 0 OR y0 < 0 OR x0 + size > {width} OR y0 + size > {height}"
    return plan.groupBy(*by).agg(F.expr(f"count_if({out}) AS frames_off_source"))


def resample_ring(points: DataFrame, by: Sequence[str], n: int, size: int = CHUNK) -> DataFrame:
    """Closed ring ``(by, idx, cnt, x, y)`` to ``n`` points uniform in arc length.

    Each edge emits the targets that fall on it, so the arc-length lookup needs no join.
    """
    ring = points.select(*by, "cnt", "x", "y", F.explode(F.expr(
        "CASE WHEN idx = 0 THEN array(0L, CAST(cnt AS BIGINT)) ELSE array(CAST(idx AS BIGINT)) END")).alias("idx"))
    st = stencil(ring, by, "idx", {"_x": lambda w: F.lead("x").over(w),
                                   "_y": lambda w: F.lead("y").over(w)}, 1, size)
    edge = st.where("idx < cnt").withColumn("_len", F.expr("sqrt(power(_x - x, 2) + power(_y - y, 2))"))
    cum = running_sum(edge, by, ["idx"], chunk_id("idx", size), {"_end": F.col("_len")}, totals=True)
    cum = cum.where("_end_total > 0 AND _len > 0").withColumn("_start", F.expr("_end - _len"))
    lo, hi = f"ceil(round(_start * {n} / _end_total, 9))", f"ceil(round(_end * {n} / _end_total, 9)) - 1"
    hit = cum.where(f"{hi} >= {lo}").select("*", F.explode(F.expr(f"sequence({lo}, {hi})")).alias("sample"))
    u = f"(least(greatest(sample * _end_total / {n} - _start, 0D), _len) / _len)"
    return hit.where(f"sample < {n}").select(*by, F.col("sample").cast("int"), F.expr(f"x + (_x - x) * {u} AS x"),
                      F.expr(f"y + (_y - y) * {u} AS y"))


def decimate(points: DataFrame, keep: str, idx: str = "idx", n: str = "n") -> DataFrame:
    """Keep ``max(3, keep)`` evenly spread control points; survivors stay where they are.

    ``keep`` is a SQL expression over the point count. A row decides for itself, so there is no
    join.
    """
    p = points.withColumn("_k", F.expr(f"greatest(3, CAST({keep} AS INT))"))
    near = f"CAST(floor({idx} * (_k - 1) / CAST({n} - 1 AS DOUBLE)) AS INT)"
    hit = (f"exists(sequence({near} - 1, {near} + 2), i -> i BETWEEN 0 AND _k - 1 AND "
           f"bround(i * CAST({n} - 1 AS DOUBLE) / (_k - 1)) = {idx})")
    return p.where(f"_k >= {n} OR {hit}").drop("_k")


def apply_group_transforms(ancestors: DataFrame, groups: DataFrame, mats: DataFrame,
                           crop: bool = False) -> DataFrame:
    """Write each group's matrix to the one transformed ancestor of its shapes.

    ``ancestors`` (element_id, shape_id, node_id, depth, has_transform), ``groups`` (element_id,
    shape_id, group_id), ``mats`` (element_id, group_id, frame, matrix [, crop_inverse]). With no
    transformed ancestor the innermost carries it; more than one is an error.
    """
    carrier = ancestors.groupBy("element_id", "shape_id").agg(
        F.expr("count_if(has_transform) AS _n"),
        F.expr("max_by(node_id, struct(has_transform, depth)) AS carrier")).select(
        "element_id", "shape_id",
        F.expr("CASE WHEN _n > 1 THEN raise_error('shape under several transformed layers') ELSE carrier END AS carrier"))
    # Many shapes share a carrier: reduce to (carrier, group) before meeting the matrices.
    pairs = carrier.join(groups, ["element_id", "shape_id"]).groupBy(
        "element_id", "carrier", "group_id").agg(F.count(F.lit(1)).alias("shapes"))
    out = pairs.join(mats, ["element_id", "group_id"])
    if crop:
        out = out.withColumn("matrix", matmul4(F.col("matrix"), F.col("crop_inverse")))
    return out.select("element_id", "carrier", "group_id", "frame", "shapes", "matrix")
