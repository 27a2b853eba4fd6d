"""Coverage queries on the sparse pixel tables (frame = supplier)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as C
from .registry import query
from .scoring import rounded
from .tables import HALVES_SQL, PIXELS_SQL, frame_list, load, pixels

BOTH_SQL = f"""{PIXELS_SQL}, pairs AS (
  SELECT frame, y, x, coalesce(a.cov, 0) AS a, coalesce(b.cov, 0) AS b
  FROM (SELECT * FROM pixels WHERE side = 'O') a FULL JOIN (SELECT * FROM pixels WHERE side = 'F') b USING (frame, y, x))"""


def sides(spark, sf):
    p = pixels(spark, sf)
    return p.where("side = 'O'"), p.where("side = 'F'"), frame_list(spark, sf)


SIDES_SQL = "sides AS (SELECT side, s_suppkey AS frame FROM supplier, (SELECT DISTINCT side FROM pixels))"


def side_frames(spark, sf):
    """``(side, frame)``: every frame once per side that has pixels."""
    return frame_list(spark, sf).crossJoin(F.broadcast(pixels(spark, sf).select("side").distinct())).select("side", "frame")


@query("soft_iou", f"""WITH {BOTH_SQL}, s AS (SELECT frame, sum(least(a, b)) / sum(greatest(a, b)) AS v FROM pairs GROUP BY 1)
SELECT s_suppkey AS frame, round(coalesce(v, 1), 6) AS soft_iou FROM supplier LEFT JOIN s ON frame = s_suppkey""")
def soft_iou(spark, sf):
    a, b, f = sides(spark, sf)
    return rounded(C.soft_iou(a, b, f, ["frame"]))


@query("hard_iou", f"""WITH {BOTH_SQL}, s AS (
  SELECT frame, count(*) FILTER (a > 0.5 AND b > 0.5)::DOUBLE / nullif(count(*) FILTER (a > 0.5 OR b > 0.5), 0) AS v FROM pairs GROUP BY 1)
SELECT s_suppkey AS frame, round(coalesce(v, 1), 6) AS iou FROM supplier LEFT JOIN s ON frame = s_suppkey""")
def hard_iou(spark, sf):
    a, b, f = sides(spark, sf)
    return rounded(C.hard_iou(a, b, f, ["frame"]))


@query("union_cov", f"WITH {PIXELS_SQL} SELECT frame, y, x, max(cov) AS cov FROM pixels GROUP BY ALL")
def union_cov(spark, sf):
    return C.union_cov(pixels(spark, sf), ["frame"])


@query("coverage_diff", f"""WITH {BOTH_SQL} SELECT frame, y, x, round(greatest(a - b, 0), 6) AS over,
  round(greatest(b - a, 0), 6) AS under, least(a, b) AS agree FROM pairs""")
def coverage_diff(spark, sf):
    a, b, _ = sides(spark, sf)
    return rounded(C.coverage_diff(a, b, ["frame"]))


LAYERS_SQL = """layers AS (
  SELECT l_suppkey AS frame, l_linenumber AS y, l_partkey % 128 AS x, l_orderkey AS ord,
         sum(CASE WHEN l_returnflag = 'R' THEN -l_discount ELSE l_discount END) * 4 AS v FROM lineitem GROUP BY ALL)"""


@query("accumulate_cov", f"""WITH RECURSIVE {LAYERS_SQL}, o AS (
  SELECT *, row_number() OVER (PARTITION BY frame, y, x ORDER BY ord) AS i FROM layers), acc AS (
  SELECT frame, y, x, 1::BIGINT AS i, least(greatest(v, 0), 1) AS cov FROM o WHERE i = 1
  UNION ALL SELECT o.frame, o.y, o.x, o.i, least(greatest(acc.cov + o.v, 0), 1)
  FROM acc JOIN o ON o.frame = acc.frame AND o.y = acc.y AND o.x = acc.x AND o.i = acc.i + 1)
SELECT frame, y, x, round(arg_max(cov, i), 6) AS cov FROM acc GROUP BY ALL HAVING arg_max(cov, i) > 1e-9""")
def accumulate_cov(spark, sf):
    layers = load(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("frame"), F.col("l_linenumber").alias("y"), F.expr("l_partkey % 128 AS x"),
        F.col("l_orderkey").alias("ord")).agg(
        F.expr("sum(CASE WHEN l_returnflag = 'R' THEN -l_discount ELSE l_discount END) * 4 AS v")).selectExpr(
        "frame", "y", "x", "ord", "abs(v) AS cov", "CASE WHEN v < 0 THEN 'Subtract' ELSE 'Add' END AS blend")
    return rounded(C.accumulate_cov(layers, ["frame"]).where("cov > 1e-9"))


@query("frame_coverage", f"""WITH {PIXELS_SQL}, {SIDES_SQL}, s AS (SELECT side, frame, sum(cov) AS s FROM pixels GROUP BY ALL)
SELECT side, frame, round_even(round(coalesce(s, 0), 9) / 896, 6) AS coverage, coalesce(s, 0) > 0 AS on_screen
FROM sides LEFT JOIN s USING (side, frame)""", also="frame_coverage_all")
def frame_coverage(spark, sf):
    return C.frame_coverage(pixels(spark, sf), side_frames(spark, sf), ["side", "frame"], 896)


@query("quantise", """SELECT doc_id, round_even(least(greatest(n_chars / 30000, 0), 1) * 65535, 0) / 65535 AS cov FROM documents""")
def quantise(spark, sf):
    return C.quantise(load(spark, sf, "documents").selectExpr("doc_id", "n_chars / 30000 AS cov"))


@query("shift_cov", f"""WITH {PIXELS_SQL}, t AS (
  SELECT side, frame, CAST(floor(y + 0.5) AS BIGINT) + j AS y, CAST(floor(x + 1.25) AS BIGINT) + i AS x,
         cov * (CASE i WHEN 1 THEN (x + 1.25) - floor(x + 1.25) ELSE 1 - ((x + 1.25) - floor(x + 1.25)) END) * 0.5 AS c
  FROM pixels, range(2) a(i), range(2) b(j))
SELECT side, frame, y, x, round(sum(c), 6) AS cov FROM t WHERE x BETWEEN 0 AND 127 AND y BETWEEN 0 AND 7 GROUP BY ALL""", also="shift_cov_all")
def shift_cov(spark, sf):
    return rounded(C.shift_cov(pixels(spark, sf), ["side", "frame"], "1.25D", "0.5D", 128, 8,
                             load(spark, sf, "lineitem").count()))


INK_SQL = """ink AS (SELECT DISTINCT l_suppkey % 20 AS element_id, l_linenumber AS shape_id, l_orderkey % 16 AS frame,
  l_partkey % 16 AS y, (l_partkey // 16) % 32 AS x FROM lineitem), pile AS (
  SELECT *, count(*) OVER (PARTITION BY element_id, frame, y, x) AS s FROM ink), vis AS (
  SELECT element_id, shape_id, frame, count(*) AS own, count(*) FILTER (s = 1)::DOUBLE / count(*) AS visible FROM pile GROUP BY ALL)"""


def ink(spark, sf):
    return load(spark, sf, "lineitem").selectExpr(
        "l_suppkey % 20 AS element_id", "l_linenumber AS shape_id", "l_orderkey % 16 AS frame", "l_partkey % 16 AS y",
        "(l_partkey div 16) % 32 AS x").distinct().withColumn("cov", F.lit(1.0))


@query("visibility", f"""WITH {INK_SQL} SELECT element_id, shape_id, frame, own::DOUBLE AS own, round(visible, 6) AS visible FROM vis""")
def visibility(spark, sf):
    return rounded(C.visibility(ink(spark, sf), ["element_id"]))


@query("visibility_profile", f"""WITH {INK_SQL} SELECT element_id, count(*) AS cells,
  round(count(*) FILTER (visible < 0.05)::DOUBLE / count(*), 6) AS below_005, round(count(*) FILTER (visible < 0.20)::DOUBLE / count(*), 6) AS below_020,
  round(count(*) FILTER (visible > 0.80)::DOUBLE / count(*), 6) AS above_080,
  {', '.join(f"round(quantile_cont(visible, {p / 100}), 6) AS q{p:02d}" for p in (5, 25, 50, 75, 95))} FROM vis GROUP BY 1""")
def visibility_profile(spark, sf):
    return rounded(C.visibility_profile(C.visibility(ink(spark, sf), ["element_id"]), ["element_id"]))


def polygons(spark, sf):
    """Vector polygons scaled into a 32 x 24 window."""
    from .geometry import control
    return control(spark, sf).selectExpr("vec_id", "idx", "n AS cnt", "16 + x * 60 AS x", "12 + y * 45 AS y")


POLY_SQL = f"""{HALVES_SQL}, poly AS (SELECT vec_id, idx, n AS cnt, 16 + x * 60 AS x, 12 + y * 45 AS y FROM halves), edge AS (
  SELECT vec_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM poly WINDOW w AS (PARTITION BY vec_id ORDER BY idx))"""


@query("fill_coverage", f"""WITH {POLY_SQL}, crossing AS (
  SELECT vec_id, r, x + ((r + 0.5) / 2 - y) * (x2 - x) / (y2 - y) AS cx FROM edge, range(48) g(r)
  WHERE (y <= (r + 0.5) / 2) <> (y2 <= (r + 0.5) / 2)), sub AS (
  SELECT vec_id, r, s, count(*) FILTER (cx <= (s + 0.5) / 2) AS n FROM crossing, range(64) h(s) GROUP BY ALL)
SELECT vec_id, r // 2 AS y, s // 2 AS x, count(*) / 4 AS cov FROM sub WHERE n % 2 = 1 GROUP BY ALL""")
def fill_coverage(spark, sf):
    """The twin tests every sub-pixel centre against every edge crossing of its scanline."""
    return C.fill_coverage(polygons(spark, sf), ["vec_id"], 32, 24)


@query("stroke_coverage", f"""WITH {HALVES_SQL}, p AS (SELECT vec_id, idx, 16 + x * 60 AS x, 12 + y * 45 AS y FROM halves), s AS (
  SELECT vec_id, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY idx)), d AS (
  SELECT vec_id, sx, sy, x, y, x2, y2, least(greatest((((sx + 0.5) / 2 - x) * (x2 - x) + ((sy + 0.5) / 2 - y) * (y2 - y))
         / greatest(pow(x2 - x, 2) + pow(y2 - y, 2), 1e-18), 0), 1) AS t
  FROM s, range(64) a(sx), range(48) b(sy) WHERE x2 IS NOT NULL AND (sx + 0.5) / 2 BETWEEN least(x, x2) - 1 AND greatest(x, x2) + 1
    AND (sy + 0.5) / 2 BETWEEN least(y, y2) - 1 AND greatest(y, y2) + 1), h AS (
  SELECT DISTINCT vec_id, sx, sy FROM d WHERE pow((sx + 0.5) / 2 - x - t * (x2 - x), 2) + pow((sy + 0.5) / 2 - y - t * (y2 - y), 2) <= 0.5625)
SELECT vec_id, sy // 2 AS y, sx // 2 AS x, count(*) / 4 AS cov FROM h GROUP BY ALL""")
def stroke_coverage(spark, sf):
    return C.stroke_coverage(polygons(spark, sf), ["vec_id"], 32, 24, 1.5)


@query("with_opacity", f"""WITH {PIXELS_SQL}, {SIDES_SQL}, s AS (
  SELECT *, frame % 11 / 10 AS opacity, frame % 5 = 0 AS invert FROM sides)
SELECT side, frame, y, x, round(cov * opacity, 6) AS cov FROM pixels JOIN s USING (side, frame) WHERE NOT invert AND cov * opacity > 0
UNION ALL SELECT s.side, s.frame, gy, gx, round((1 - coalesce(cov, 0)) * opacity, 6) FROM s CROSS JOIN range(8) a(gy) CROSS JOIN range(128) b(gx)
LEFT JOIN pixels p ON p.side = s.side AND p.frame = s.frame AND p.y = gy AND p.x = gx WHERE invert AND (1 - coalesce(cov, 0)) * opacity > 0""", also="with_opacity_all")
def with_opacity(spark, sf):
    shapes = side_frames(spark, sf).selectExpr("side", "frame", "frame % 11 / 10 AS opacity", "frame % 5 = 0 AS invert")
    return rounded(C.with_opacity(pixels(spark, sf).withColumn("y", F.col("y").cast("long")), shapes, ["side", "frame"], 128, 8))


@query("align", f"""WITH {PIXELS_SQL} SELECT side, frame, y, x, cov FROM pixels
WHERE x < least(128, 100 + frame % 40) AND y < least(8, 4 + frame % 5)""")
def align(spark, sf):
    ext = frame_list(spark, sf).selectExpr("frame", "128 AS w1", "8 AS h1", "100 + frame % 40 AS w2", "4 + frame % 5 AS h2")
    return C.align(pixels(spark, sf), ext, ["frame"])


def _filled_sql(name, keep):
    """Sub-pixel fill of the polygons after keeping the points ``keep`` selects."""
    return f"""{name}_p AS (
  SELECT vec_id, idx, x, y FROM (SELECT vec_id, idx, cnt AS n, x, y, CAST({keep} AS INTEGER) AS k FROM poly)
  WHERE k >= n OR list_contains(list_transform(range(k), lambda q: round_even(q * (n - 1)::DOUBLE / (k - 1), 0)), idx)), {name}_e AS (
  SELECT vec_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM {name}_p WINDOW w AS (PARTITION BY vec_id ORDER BY idx)), {name}_c AS (
  SELECT vec_id, r, x + ((r + 0.5) / 2 - y) * (x2 - x) / (y2 - y) AS cx FROM {name}_e, range(48) g(r)
  WHERE (y <= (r + 0.5) / 2) <> (y2 <= (r + 0.5) / 2)), {name} AS (
  SELECT vec_id, r // 2 AS y, s // 2 AS x, count(*) / 4 AS cov FROM (
    SELECT vec_id, r, s, count(*) FILTER (cx <= (s + 0.5) / 2) AS n FROM {name}_c, range(64) h(s) GROUP BY ALL) WHERE n % 2 = 1 GROUP BY ALL)"""


_POINT_VARIANTS = {"drop_1": "n - 1", "drop_20pct": "floor(n * 0.8)"}


@query("ablate_points", f"WITH {POLY_SQL}, " + _filled_sql("exact", "cnt") + ", " + _filled_sql("drop_1", "greatest(3, cnt - 1)") + ", "
       + _filled_sql("drop_20pct", "greatest(3, floor(cnt * 0.8))")
       + " " + " UNION ALL ".join(f"""SELECT '{v}' AS variant, vec_id, round(coalesce(s, 1), 6) AS soft_iou FROM (SELECT DISTINCT vec_id FROM poly) LEFT JOIN (
  SELECT vec_id, sum(least(coalesce(a.cov, 0), coalesce(b.cov, 0))) / sum(greatest(coalesce(a.cov, 0), coalesce(b.cov, 0))) AS s
  FROM exact a FULL JOIN {v} b USING (vec_id, y, x) GROUP BY 1) USING (vec_id)""" for v in _POINT_VARIANTS))
def ablate_points(spark, sf):
    """Soft IoU of re-drawing each polygon with fewer control points, survivors left in place."""
    from ..functions.ordered import chunk_id, positions, with_totals
    from ..operators.geometry import decimate
    poly = polygons(spark, sf)
    ids = poly.select("vec_id").distinct()
    exact, parts = C.fill_coverage(poly, ["vec_id"], 32, 24), C.scanline_parts(poly, 24)
    out = None
    for variant, keep in _POINT_VARIANTS.items():
        kept = decimate(poly.withColumn("n", F.col("cnt")), keep).select("vec_id", "x", "y", "idx")
        kept = positions(kept, ["vec_id"], ["idx"], chunk_id("idx"), "pos")
        kept = with_totals(kept, ["vec_id"], {"cnt": ("count", F.lit(1))}, chunk_id("pos"))
        drawn = C.fill_coverage(kept.selectExpr("vec_id", "pos AS idx", "cnt", "x", "y"), ["vec_id"], 32, 24)
        s = C.soft_iou(drawn, exact, ids, ["vec_id"], parts).select(F.lit(variant).alias("variant"), "vec_id", "soft_iou")
        out = s if out is None else out.unionByName(s)
    return rounded(out)
