"""Coverage rasters as sparse pixel rows: ``(by, y, x, cov)`` with zero pixels absent.

Comparisons are keyed on the pixel, so a frame or element that holds much of the table still
spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.distribution import exact_quantiles
from ..functions.ordered import enough, stencil

LEVELS = 65535


def paired(a: DataFrame, b: DataFrame, by: Sequence[str], parts: int | None = None) -> DataFrame:
    """Both coverages on one row per pixel, 0 where one side is absent.

    A full outer join of two sparse tables written as one aggregation over their union: a single
    exchange with map-side combining. With ``parts`` the rows are dealt to so many tasks first and combined there, so
    that none holds more than its share.
    """
    cols = [*by, "y", "x"]
    both = a.select(*cols, F.col("cov").alias("a"), F.lit(0.0).alias("b")).unionByName(
        b.select(*cols, F.lit(0.0).alias("a"), F.col("cov").alias("b")))
    if parts:
        both = both.repartition(parts, *cols)
    return both.groupBy(*cols).agg(F.max("a").alias("a"), F.max("b").alias("b"))


def overlap_scores(a: DataFrame, b: DataFrame, frames: DataFrame, by: Sequence[str],
                   thr: float = 0.5, parts: int | None = None) -> DataFrame:
    """Soft and hard IoU per frame of the frame list; nothing drawn on either side is 1.0."""
    s = paired(a, b, by, parts).groupBy(*by).agg(
        F.expr("sum(least(a, b)) / sum(greatest(a, b)) AS soft_iou"),
        F.expr(f"try_divide(count_if(a > {thr} AND b > {thr}), count_if(a > {thr} OR b > {thr})) AS iou"))
    return frames.join(s, list(by), "left").select(
        *frames.columns, F.expr("coalesce(soft_iou, 1D) AS soft_iou"), F.expr("coalesce(iou, 1D) AS iou"))


def soft_iou(a: DataFrame, b: DataFrame, frames: DataFrame, by: Sequence[str], parts: int | None = None) -> DataFrame:
    return overlap_scores(a, b, frames, by, parts=parts).drop("iou")


def hard_iou(a: DataFrame, b: DataFrame, frames: DataFrame, by: Sequence[str], thr: float = 0.5) -> DataFrame:
    return overlap_scores(a, b, frames, by, thr).drop("soft_iou")


def union_cov(roots: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per-pixel maximum over roots."""
    return roots.groupBy(*by, "y", "x").agg(F.max("cov").alias("cov"))


_STEP = ("struct(acc.d + e.v AS d, least(greatest(acc.lo + e.v, 0D), 1D) AS lo, "
         "least(greatest(acc.hi + e.v, 0D), 1D) AS hi)")
_JOIN = ("struct(acc.d + e.f.d AS d, least(greatest(acc.lo + e.f.d, e.f.lo), e.f.hi) AS lo, "
         "least(greatest(acc.hi + e.f.d, e.f.lo), e.f.hi) AS hi)")
_UNIT = "struct(0D AS d, -1D/0D AS lo, 1D/0D AS hi)"


def accumulate_cov(layers: DataFrame, by: Sequence[str], clip_each: bool = True,
                   size: int = 4096) -> DataFrame:
    """Draw shapes in order inside a root: add or subtract, clipped to [0, 1].

    ``layers`` rows carry ``ord`` and ``blend`` (Add / Subtract). With ``clip_each`` the order
    matters. "Add then clip" is a clamp function and clamps compose to clamps, so a long pile is
    folded chunk by chunk and the chunks are folded again; no pixel's pile is gathered whole.
    """
    signed = layers.select(*by, "y", "x", "ord", F.expr(
        "CASE WHEN blend = 'Subtract' THEN -cov ELSE cov END AS v"))
    key = [*by, "y", "x"]
    if not clip_each:
        out = signed.groupBy(*key).agg(F.expr("least(greatest(sum(v), 0D), 1D) AS cov"))
        return out.where("cov > 0")
    start = _UNIT.replace("-1D/0D", "double('-Infinity')").replace("1D/0D", "double('Infinity')")
    part = signed.groupBy(*key, F.floor(F.col("ord") / size).alias("_c")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "v"))).alias("_l"))
    part = part.select(*key, "_c", F.expr(f"aggregate(_l, {start}, (acc, e) -> {_STEP}) AS f"))
    whole = part.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_c", "f"))).alias("_l"))
    out = whole.select(*key, F.expr(
        f"aggregate(_l, {start}, (acc, e) -> {_JOIN}, acc -> least(greatest(acc.d, acc.lo), acc.hi)) AS cov"))
    return out.where("cov > 0")


def frame_coverage(pixels: DataFrame, frames: DataFrame, by: Sequence[str], area: int) -> DataFrame:
    """Mean coverage per frame (6 places, half-even) and whether anything is on screen.

    The sum is rounded first, so the result does not depend on the order partitions arrive in.
    """
    s = pixels.groupBy(*by).agg(F.sum("cov").alias("_s"))
    return frames.join(s, list(by), "left").select(
        *frames.columns, F.expr(f"bround(round(coalesce(_s, 0D), 9) / {area}, 6) AS coverage"),
        F.expr("coalesce(_s, 0D) > 0 AS on_screen"))


def quantise(df: DataFrame, cov: str = "cov") -> DataFrame:
    """Round to one of 65,536 levels, halves to even."""
    return df.withColumn(cov, F.expr(f"bround(least(greatest({cov}, 0D), 1D) * {LEVELS}) / {LEVELS}"))


def shift_cov(pixels: DataFrame, by: Sequence[str], dx: str, dy: str, width: int, height: int, rows: int | None = None) -> DataFrame:
    """Bilinear translate by (dx, dy); what leaves the window is lost, what enters is 0.

    ``rows`` is a bound on the number of pixels, where one is known; else they are counted.
    """
    x, y = f"(x + {dx})", f"(y + {dy})"
    fx, fy = f"({x} - floor({x}))", f"({y} - floor({y}))"
    cells = ", ".join(
        f"named_struct('tx', CAST(floor({x}) + {i} AS BIGINT), 'ty', CAST(floor({y}) + {j} AS BIGINT), 'w', "
        f"({fx if i else f'(1 - {fx})'}) * ({fy if j else f'(1 - {fy})'}))"
        for i in (0, 1) for j in (0, 1))
    t = pixels.select(*by, "cov", F.explode(F.expr(f"filter(array({cells}), e -> e.w > 0)")).alias("_t"))
    t = t.select(*by, F.col("_t.ty").alias("y"), F.col("_t.tx").alias("x"), F.expr("cov * _t.w AS cov"))
    t = t.where(f"x BETWEEN 0 AND {width - 1} AND y BETWEEN 0 AND {height - 1}")
    t = t.repartition(enough(t, 4 * (pixels.count() if rows is None else rows)), *by, "y", "x")
    return t.groupBy(*by, "y", "x").agg(F.sum("cov").alias("cov"))


def scanline_parts(polylines: DataFrame, height: int, ss: int = 2) -> int:
    """Partitions for the pixels of polylines: a point's edge crosses all scanlines at most, and half of them as a rule."""
    return enough(polylines, polylines.count() * height * ss // 2)


def fill_coverage(polylines: DataFrame, by: Sequence[str], width: int, height: int, ss: int = 2) -> DataFrame:
    """Closed polygons ``(by, idx, cnt, x, y)`` in pixels to coverage.

    Rule: even-odd at sub-pixel centres, ``ss x ss`` per pixel, box average. Each edge emits the
    scanlines it crosses; crossings on one scanline pair up into spans; spans emit pixels.
    """
    ring = polylines.select(*by, "cnt", "x", "y", F.explode(F.expr(
        "CASE WHEN idx = 0 THEN array(0L, CAST(cnt AS BIGINT)) ELSE array(CAST(idx AS BIGINT)) END")).alias("idx"))
    edge = stencil(ring, by, "idx", {"x2": lambda w: F.lead("x").over(w),
                                     "y2": lambda w: F.lead("y").over(w)}, 1).where("idx < cnt AND y <> y2")
    # Scanline r has its centre at (r + 0.5) / ss; half-open in y, so a shared vertex counts once.
    lo = f"greatest(CAST(ceil(least(y, y2) * {ss} - 0.5) AS BIGINT), 0L)"
    hi = f"least(CAST(ceil(greatest(y, y2) * {ss} - 0.5) AS BIGINT) - 1, {height * ss - 1}L)"
    cross = edge.where(f"{hi} >= {lo}").select(*by, "x", "y", "x2", "y2", F.explode(F.expr(f"sequence({lo}, {hi})")).alias("r"))
    cross = cross.select(*by, F.expr(f"r div {ss} AS py"), "r", F.expr(f"x + ((r + 0.5D) / {ss} - y) * (x2 - x) / (y2 - y) AS cx"))
    cross = cross.repartition(scanline_parts(polylines, height, ss), *by, "py")
    w = Window.partitionBy(*by, "py", "r").orderBy("cx")
    span = cross.select(*by, "py", "r", "cx", F.row_number().over(w).alias("_i"), F.lead("cx").over(w).alias("cx2"))
    span = span.where("_i % 2 = 1 AND cx2 IS NOT NULL").select(
        *by, "py", F.expr(f"greatest(CAST(ceil(cx * {ss} - 0.5) AS BIGINT), 0L) AS s0"),
        F.expr(f"least(CAST(ceil(cx2 * {ss} - 0.5) AS BIGINT) - 1, {width * ss - 1}L) AS s1")).where("s1 >= s0")
    return _span_pixels(span, by, ss)


def _span_pixels(spans: DataFrame, by: Sequence[str], ss: int) -> DataFrame:
    """Disjoint spans of sub-pixels ``(by, py, s0, s1)``, partitioned by row of pixels, to coverage per pixel."""
    px = spans.select(*by, F.col("py").alias("y"), "s0", "s1", F.explode(F.expr(
        f"sequence(s0 div {ss}, s1 div {ss})")).alias("x"))
    return px.groupBy(*by, "y", "x").agg(F.expr(
        f"sum(least(s1, x * {ss} + {ss - 1}) - greatest(s0, x * {ss}) + 1) / {float(ss * ss)}D AS cov"))


def stroke_coverage(polylines: DataFrame, by: Sequence[str], width: int, height: int, band: float,
                    ss: int = 2) -> DataFrame:
    """Open polylines drawn as a band at least one pixel wide, same sub-pixel rule.

    A segment's band meets a scanline in one interval, which is solved for: the two round ends and the straight part between
    them each give one, and together they have no gap. The sub-pixel centres at its ends are then tested by the distance
    itself. Spans of a scanline are cut to what earlier ones leave over, so a sub-pixel is counted once and rows follow
    the covered sub-pixels, not the segments' bounding boxes.
    """
    half = max(float(band), 1.0) / 2
    seg = stencil(polylines.select(*by, "idx", "x", "y"), by, "idx", {
        "x2": lambda w: F.lead("x").over(w), "y2": lambda w: F.lead("y").over(w)}, 1).where("x2 IS NOT NULL")
    ylo = f"greatest(CAST(ceil((least(y, y2) - {half}D) * {ss} - 0.5) AS BIGINT), 0L)"
    yhi = f"least(CAST(floor((greatest(y, y2) + {half}D) * {ss} - 0.5) AS BIGINT), {height * ss - 1}L)"
    rows = seg.where(f"{yhi} >= {ylo}").select(*by, "x", "y", "x2", "y2", F.expr("x2 - x AS dx"), F.expr("y2 - y AS dy"),
                                              F.explode(F.expr(f"sequence({ylo}, {yhi})")).alias("r"))
    rows = rows.withColumn("row", F.expr(f"r div {ss}")).repartition(scanline_parts(polylines, height, ss), *by, "row")
    rows = rows.withColumn("py", F.expr(f"(r + 0.5D) / {ss}")).withColumn("l2", F.expr("dx * dx + dy * dy"))

    def end(x: str, y: str) -> tuple[str, str]:
        left = f"{half * half}D - (py - {y}) * (py - {y})"
        return tuple(f"CASE WHEN {left} >= 0 THEN {x} {sign} sqrt({left}) END" for sign in "-+")
    never, always = "CAST(NULL AS DOUBLE)", "double('Infinity')"
    strip = [f"CASE WHEN dy <> 0 THEN x + (py - y) * dx / dy {sign} {half}D * sqrt(l2) / abs(dy) "
             f"WHEN abs(py - y) <= {half}D THEN {sign}{always} ELSE {never} END" for sign in "-+"]
    ahead = ["(x - (py - y) * dy / dx)", "(x + (l2 - (py - y) * dy) / dx)"]
    slab = [f"CASE WHEN dx <> 0 THEN {pick}({ahead[0]}, {ahead[1]}) WHEN (py - y) * dy BETWEEN 0 AND l2 THEN {sign}{always} ELSE {never} END"
            for sign, pick in (("-", "least"), ("+", "greatest"))]
    rows = rows.select("*", *[F.expr(e).alias(n) for n, e in zip(
        ("a0", "a1", "b0", "b1", "s0", "s1", "p0", "p1"), (*end("x", "y"), *end("x2", "y2"), *strip, *slab))])
    body = "s0 IS NOT NULL AND p0 IS NOT NULL AND l2 > 0 AND greatest(s0, p0) <= least(s1, p1)"
    rows = rows.select(*by, "row", "r", "x", "y", "dx", "dy", "py", F.expr(f"least(a0, b0, CASE WHEN {body} THEN greatest(s0, p0) END) AS lo"),
                       F.expr(f"greatest(a1, b1, CASE WHEN {body} THEN least(s1, p1) END) AS hi")).where("lo IS NOT NULL")

    def inside(s: str) -> str:
        px = f"(({s} + 0.5D) / {ss})"
        t = f"least(greatest((({px} - x) * dx + (py - y) * dy) / greatest(power(dx, 2) + power(dy, 2), 1e-18), 0D), 1D)"
        return f"power({px} - x - {t} * dx, 2) + power(py - y - {t} * dy, 2) <= {half * half}D"
    rows = rows.select("*", F.expr(f"CAST(ceil(lo * {ss} - 0.5) AS BIGINT) AS e0"), F.expr(f"CAST(floor(hi * {ss} - 0.5) AS BIGINT) AS e1"))
    rows = rows.select(
        *by, "row", "r", F.expr(f"greatest(CASE WHEN {inside('(e0 - 1)')} THEN e0 - 1 WHEN {inside('e0')} THEN e0 ELSE e0 + 1 END, 0L) AS s0"),
        F.expr(f"least(CASE WHEN {inside('(e1 + 1)')} THEN e1 + 1 WHEN {inside('e1')} THEN e1 ELSE e1 - 1 END, {width * ss - 1}L) AS s1")
    ).where("s1 >= s0")
    before = Window.partitionBy(*by, "row", "r").orderBy("s0", "s1").rowsBetween(Window.unboundedPreceding, -1)
    fresh = rows.withColumn("s0", F.greatest(F.col("s0"), F.coalesce(F.max("s1").over(before) + 1, F.col("s0")))).where("s1 >= s0")
    return _span_pixels(fresh.withColumnRenamed("row", "py"), by, ss)


def with_opacity(pixels: DataFrame, shapes: DataFrame, by: Sequence[str], width: int, height: int) -> DataFrame:
    """Scale by opacity; an inverted shape covers the complement inside the window."""
    p = pixels.join(shapes, list(by))
    plain = p.where("NOT invert").select(*by, "y", "x", F.expr("cov * opacity AS cov"))
    grid = shapes.where("invert").select(*by, "opacity", F.explode(F.expr(
        f"sequence(0L, {height - 1}L)")).alias("y")).select("*", F.explode(F.expr(f"sequence(0L, {width - 1}L)")).alias("x"))
    inv = grid.join(pixels, [*by, "y", "x"], "left").select(
        *by, "y", "x", F.expr("(1 - coalesce(cov, 0D)) * opacity AS cov"))
    return plain.unionByName(inv).where("cov > 0")


def visibility(shape_pixels: DataFrame, element: Sequence[str], shape: str = "shape_id",
               frame: str = "frame") -> DataFrame:
    """Share of a shape's own ink that nothing else draws, per (shape, frame).

    Coverage must be binary (sub-pixel grain), where add-and-clip equals maximum. A pixel's group
    is at most the element's shapes.
    """
    pile = Window.partitionBy(*element, frame, "y", "x")
    p = shape_pixels.select(*element, shape, frame, "cov", F.sum("cov").over(pile).alias("_s"))
    return p.groupBy(*element, shape, frame).agg(
        F.sum("cov").alias("own"),
        F.expr("coalesce(try_divide(sum(greatest(least(1D, _s) - least(1D, _s - cov), 0D)), sum(cov)), 0D) AS visible"))


def visibility_profile(vis: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bucket shares and exact quantiles of visibility."""
    g = vis.groupBy(*by).agg(
        F.expr("count(1) AS cells"), F.expr("count_if(visible < 0.05) / count(1) AS below_005"),
        F.expr("count_if(visible < 0.20) / count(1) AS below_020"), F.expr("count_if(visible > 0.80) / count(1) AS above_080"))
    q = exact_quantiles(vis, by, "visible", {f"q{p:02d}": p / 100 for p in (5, 25, 50, 75, 95)})
    return g.join(q, list(by))


def align(pixels: DataFrame, extents: DataFrame, by: Sequence[str]) -> DataFrame:
    """Crop to the smaller of two rasters; ``extents`` has ``(by, w1, h1, w2, h2)``."""
    return pixels.join(extents, list(by)).where("x < least(w1, w2) AND y < least(h1, h2)").select(*pixels.columns)


def coverage_diff(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Signed difference per pixel: over, under and agreement."""
    return paired(a, b, by).selectExpr(*by, "y", "x", "greatest(a - b, 0D) AS over", "greatest(b - a, 0D) AS under",
                                       "least(a, b) AS agree")
