"""Composite queries: simplification, refit, rebuild, program decode, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pipelines as P
from ..operators import scoring as SC
from ..operators import simplify as S
from . import lifespans as life
from .registry import query
from .scoring import rounded
from .tables import TRACK_SQL, load, track

TOL = 60.0


def curve(spark, sf):
    """Each user's values as a one-point track."""
    return track(spark, sf, "value").selectExpr("user_id", "frame AS pos", "frame", "array(value, 0D) AS pts")


def knots_sql(tracks: str, budget: str) -> str:
    """Knots of the tracks b (user_id, pos, frame, v, s): minimax programme up to 64 frames, greedy reach with patience 8 beyond.

    ``s`` scales an error before it is compared with ``budget``; ``tracks`` are the CTEs that end in b.
    """
    share = "((m.pos - a.pos)::DOUBLE / (e.pos - a.pos))"
    return f"""WITH RECURSIVE {tracks}, n AS (SELECT user_id, max(pos) AS last, count(*) AS t FROM b GROUP BY 1), cost AS (
  SELECT a.user_id, a.pos AS a, e.pos AS e, coalesce(max(abs((1.0::DOUBLE - {share}) * a.v + {share} * e.v - m.v) * m.s), 0) AS cost
  FROM b a JOIN b e ON e.user_id = a.user_id AND e.pos > a.pos LEFT JOIN b m ON m.user_id = a.user_id AND m.pos > a.pos AND m.pos < e.pos GROUP BY 1, 2, 3), c AS (
  SELECT cost.* FROM cost JOIN n USING (user_id) WHERE t BETWEEN 3 AND 64
  UNION ALL SELECT user_id, pos, pos, 0 FROM b JOIN n USING (user_id) WHERE t BETWEEN 3 AND 64), lvl AS (
  SELECT 0 AS k, c.user_id, e, cost AS w, 0::BIGINT AS came, max(CASE WHEN e = last THEN cost END) OVER (PARTITION BY c.user_id) AS wl
  FROM c JOIN n USING (user_id) WHERE a = 0
  UNION ALL SELECT k, user_id, e, m[1], m[2], max(CASE WHEN e = last THEN m[1] END) OVER (PARTITION BY user_id) FROM (
    SELECT l.k + 1 AS k, l.user_id, c.e, any_value(n.last) AS last, min((greatest(l.w, c.cost), l.e)) AS m
    FROM lvl l JOIN c ON c.user_id = l.user_id AND c.a = l.e JOIN n ON n.user_id = l.user_id WHERE l.wl > {budget} AND l.k < n.t - 1 GROUP BY 1, 2, 3)), back AS (
  SELECT l.user_id, l.k, l.came AS via FROM lvl l JOIN n ON n.user_id = l.user_id AND l.e = n.last
  JOIN (SELECT user_id, max(k) AS k FROM lvl GROUP BY 1) x ON x.user_id = l.user_id AND x.k = l.k WHERE l.k > 0
  UNION ALL SELECT l.user_id, l.k, l.came FROM back p JOIN lvl l ON l.user_id = p.user_id AND l.k = p.k - 1 AND l.e = p.via WHERE l.k > 0), hop AS (
  SELECT user_id, a, min(e) AS nxt FROM (SELECT *, lead(e) OVER (PARTITION BY user_id, a ORDER BY e) AS e2 FROM cost WHERE cost <= {budget})
  WHERE e2 IS NULL OR e2 - e > 8 GROUP BY 1, 2), walk AS (
  SELECT user_id, 0::BIGINT AS pos FROM n WHERE t > 64
  UNION ALL SELECT w.user_id, nxt FROM walk w JOIN hop ON hop.user_id = w.user_id AND a = w.pos), knots AS (
  SELECT user_id, pos, frame, CASE WHEN t <= 2 THEN 'trivial' WHEN t <= 64 THEN 'dp' ELSE 'greedy' END AS method FROM (
    SELECT user_id, pos FROM b JOIN n USING (user_id) WHERE t <= 2 UNION SELECT user_id, unnest([0, last]) FROM n WHERE t BETWEEN 3 AND 64
    UNION SELECT user_id, via FROM back UNION SELECT user_id, pos FROM walk) JOIN b USING (user_id, pos) JOIN n USING (user_id))"""


CURVE_SQL = f"{TRACK_SQL}, b AS (SELECT user_id, CAST(frame AS BIGINT) AS pos, frame, value AS v, 1.0::DOUBLE AS s FROM track)"


@query("simplify", f"{knots_sql(CURVE_SQL, str(TOL))} SELECT user_id, frame, method FROM knots")
def simplify(spark, sf):
    """Chosen knots per user."""
    return S.simplify(curve(spark, sf), ["user_id"], TOL).select("user_id", "frame", "method")


@query("simplify_count", f"{knots_sql(CURVE_SQL, str(TOL))} SELECT user_id, method, count(*) AS n_knots FROM knots GROUP BY ALL", also="simplify_count_all")
def simplify_count(spark, sf):
    """Knots of every track, short or long, and how they were found."""
    return S.simplify(curve(spark, sf), ["user_id"], TOL).groupBy("user_id", "method").agg(F.expr("count(1) AS n_knots"))


@query("selection", f"""{knots_sql(CURVE_SQL, str(TOL))}, seg AS (
  SELECT k.user_id, k.pos AS p0, lead(k.pos) OVER w AS p1, b.v AS v0, lead(b.v) OVER w AS v1 FROM knots k JOIN b USING (user_id, pos)
  WINDOW w AS (PARTITION BY k.user_id ORDER BY k.pos)), err AS (
  SELECT user_id, max(abs(v0 * (1 - (b.pos - p0)::DOUBLE / (p1 - p0)) + v1 * ((b.pos - p0)::DOUBLE / (p1 - p0)) - v)) AS e
  FROM seg JOIN b USING (user_id) WHERE b.pos > p0 AND b.pos < p1 GROUP BY 1)
SELECT user_id, count(*) AS n_knots, max(method) AS method, round(coalesce(any_value(e), 0), 6) AS max_error, max(method) <> 'greedy' AS exact,
  {TOL}::DOUBLE AS tol_min, {TOL}::DOUBLE AS tol_max FROM knots LEFT JOIN err USING (user_id) GROUP BY 1""")
def selection(spark, sf):
    t = curve(spark, sf)
    return rounded(S.selection(t, S.simplify(t, ["user_id"], TOL), ["user_id"], tol=TOL))


BIASED_SQL = f"""{TRACK_SQL}, local AS (
  SELECT user_id, frame, value, CASE WHEN event_type = 'purchase' THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS p FROM track), b AS (
  SELECT user_id, CAST(frame AS BIGINT) AS pos, frame, value AS v, 1 / ({TOL}::DOUBLE * least(greatest(
    1.0::DOUBLE - 0.5::DOUBLE * p + 0.8::DOUBLE * (1.0::DOUBLE - p), 0.2::DOUBLE), 4.0::DOUBLE)) AS s FROM local)"""


def _biased(spark, sf):
    from ..operators.tracks import local_tol
    t = track(spark, sf, "value", "event_type").withColumn("p", F.expr("CASE WHEN event_type = 'purchase' THEN 0.9D ELSE 0.1D END"))
    return local_tol(t, TOL, 0.5, 0.8).selectExpr("user_id", "frame AS pos", "frame", "array(value, 0D) AS pts", "1 / tol AS inv_tol")


@query("simplify_biased", f"{knots_sql(BIASED_SQL, '1.0::DOUBLE')} SELECT user_id, frame, method FROM knots")
def simplify_biased(spark, sf):
    """Local tolerance: tighter where a key is likely, looser elsewhere."""
    return S.simplify(_biased(spark, sf), ["user_id"], TOL, "inv_tol").select("user_id", "frame", "method")


@query("selection_biased", f"""{knots_sql(BIASED_SQL, '1.0::DOUBLE')}
SELECT user_id, count(DISTINCT knots.pos) AS n_knots, max(method) AS method, CASE WHEN max(method) = 'trivial' THEN {TOL}::DOUBLE ELSE round(min(1 / s), 6) END AS tol_min,
  CASE WHEN max(method) = 'trivial' THEN {TOL}::DOUBLE ELSE round(max(1 / s), 6) END AS tol_max FROM knots JOIN b USING (user_id) GROUP BY 1""")
def selection_biased(spark, sf):
    """The range of tolerances that a biased choice was made under."""
    t = _biased(spark, sf)
    out = S.selection(t, S.simplify(t, ["user_id"], TOL, "inv_tol"), ["user_id"], tol=TOL, inv_tol="inv_tol")
    return rounded(out.select("user_id", "n_knots", "method", "tol_min", "tol_max"))


def _keys(t):
    return t.where("event_type = 'purchase'").selectExpr(
        "user_id", "frame", "CASE event_id % 2 WHEN 0 THEN 'linear' ELSE 'hold' END AS interp")


REFIT_SQL = f"""WITH RECURSIVE {TRACK_SQL}, k AS (
  SELECT user_id, frame, CASE event_id % 2 WHEN 0 THEN 'linear' ELSE 'hold' END AS interp,
         row_number() OVER w - 1 AS i, lead(frame) OVER w AS f1 FROM track WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY frame)), part AS (
  SELECT t.user_id, t.value AS y, coalesce(k.i, 0) AS i, CASE WHEN k.i IS NULL OR f1 IS NULL OR interp = 'hold' THEN 0
         ELSE (t.frame - k.frame)::DOUBLE / (f1 - k.frame) END AS u FROM track t ASOF LEFT JOIN k ON k.user_id = t.user_id AND t.frame >= k.frame), eq AS (
  SELECT user_id, i, sum(d) AS d, sum(e) AS e, sum(y) AS y FROM (
    SELECT user_id, i, (1 - u) * (1 - u) AS d, (1 - u) * u AS e, (1 - u) * y AS y FROM part UNION ALL SELECT user_id, i + 1, u * u, 0, u * y FROM part WHERE u > 0)
  WHERE user_id IN (SELECT user_id FROM k) GROUP BY 1, 2), fwd AS (
  SELECT user_id, i, d, e, y FROM eq WHERE i = 0
  UNION ALL SELECT q.user_id, q.i, q.d - f.e * f.e / f.d, q.e, q.y - f.e * f.y / f.d FROM fwd f JOIN eq q ON q.user_id = f.user_id AND q.i = f.i + 1), bwd AS (
  SELECT f.user_id, f.i, y / d AS x FROM fwd f JOIN (SELECT user_id, max(i) AS i FROM fwd GROUP BY 1) l USING (user_id, i)
  UNION ALL SELECT f.user_id, f.i, (f.y - f.e * b.x) / f.d FROM bwd b JOIN fwd f ON f.user_id = b.user_id AND f.i = b.i - 1)"""


@query("refit", f"{REFIT_SQL} SELECT k.user_id, k.i AS kidx, k.frame, round(x, 6) AS value FROM bwd JOIN k USING (user_id, i)")
def refit(spark, sf):
    """Least-squares key values of mixed linear and hold keys."""
    t = track(spark, sf, "value", "event_type")
    return rounded(S.refit(t.select("user_id", "frame", "value"), _keys(t), ["user_id"]))


@query("refit_residual", f"""WITH {TRACK_SQL} SELECT user_id, count(*) AS n_keys, 0.0::DOUBLE AS residual FROM track WHERE event_type = 'purchase' GROUP BY 1""")
def refit_residual(spark, sf):
    """Catmull-Rom, linear and hold keys: a least-squares solution leaves the normal equations without residual."""
    from ..operators.refit import residual
    t = track(spark, sf, "value", "event_type")
    keys = t.where("event_type = 'purchase'").selectExpr("user_id", "frame", "element_at(array('catmullrom', 'linear', 'catmullrom', 'hold'), 1 + CAST(event_id % 4 AS INT)) AS interp")
    raw = t.select("user_id", "frame", "value")
    return rounded(residual(raw, keys, ["user_id"], S.refit(raw, keys, ["user_id"])))


@query("refit_hold", f"""WITH {TRACK_SQL}, k AS (
  SELECT user_id, frame, row_number() OVER (PARTITION BY user_id ORDER BY frame) - 1 AS kidx FROM track WHERE event_type = 'purchase'), a AS (
  SELECT t.user_id, coalesce(k.kidx, 0) AS kidx, t.value FROM track t ASOF LEFT JOIN k ON k.user_id = t.user_id AND t.frame >= k.frame)
SELECT user_id, kidx, k.frame, round(avg(a.value), 6) AS value FROM a JOIN k USING (user_id, kidx) GROUP BY ALL""")
def refit_hold(spark, sf):
    """With hold keys the least-squares value of a key is the mean of the frames it covers."""
    t = track(spark, sf, "value", "event_type")
    keys = t.where("event_type = 'purchase'").selectExpr("user_id", "frame", "'hold' AS interp")
    return rounded(S.refit(t.select("user_id", "frame", "value"), keys, ["user_id"]))


REBUILT_SQL = f"""{TRACK_SQL}, lv AS (
  SELECT user_id, frame, value, row_number() OVER (PARTITION BY user_id ORDER BY frame) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS t
  FROM track WHERE event_type <> 'error'), fit AS (SELECT *, CASE WHEN t < 3 THEN 1 ELSE least(5, CASE WHEN t % 2 = 1 THEN t ELSE t - 1 END) END AS w FROM lv), b AS (
  SELECT f.user_id, f.pos, any_value(f.frame) AS frame, CASE WHEN any_value(f.w) <= 1 THEN any_value(f.value) ELSE sum(g.value) / any_value(f.w) END AS v, 1.0::DOUBLE AS s
  FROM fit f, range(-2, 3) d(d), fit g WHERE abs(d) <= f.w // 2 AND g.user_id = f.user_id AND g.pos = least(greatest(f.pos + d, 0), f.t - 1) GROUP BY f.user_id, f.pos)"""


@query("rebuild", f"""{knots_sql(REBUILT_SQL, str(TOL))}
SELECT k.user_id, k.frame, CASE WHEN t.event_type = 'purchase' AND t.event_id % 2 = 1 THEN 'hold' ELSE 'linear' END AS interp, round(b.v, 6) AS x, 0.0::DOUBLE AS y
FROM knots k JOIN b USING (user_id, pos) JOIN track t ON t.user_id = k.user_id AND t.frame = k.frame""")
def rebuild(spark, sf):
    """Live frames smoothed, thinned to knots and keyed with the artist's interpolation."""
    t = track(spark, sf, "value", "event_type").withColumn("live", F.expr("event_type <> 'error'"))
    pts = t.where("live").selectExpr("user_id", "frame", "value AS x", "0D AS y")
    return rounded(P.rebuild(pts, _keys(t), ["user_id"], TOL, 5))


@query("assemble_program", f"""WITH {TRACK_SQL}, tk AS (
  SELECT user_id, frame, CASE event_id % 2 WHEN 0 THEN 'linear' ELSE 'hold' END AS interp,
         row_number() OVER (PARTITION BY user_id ORDER BY frame) AS r FROM track WHERE event_type = 'purchase'), pk AS (
  SELECT user_id, frame, value, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS r FROM track WHERE event_type = 'signup' AND event_id % 5 > 0), lv AS (
  SELECT user_id, frame, value > 20 AS live, lag(value > 20, 1, false) OVER (PARTITION BY user_id ORDER BY frame) AS prev,
         bool_and(value > 20) OVER (PARTITION BY user_id) AS always FROM track)
SELECT user_id AS shape_id, 'path' AS track, pk.frame, coalesce(interp, 'linear') AS interp, value AS v FROM pk LEFT JOIN tk USING (user_id, r)
UNION ALL SELECT user_id, 'opacity', frame, 'hold', CASE WHEN live THEN 100 ELSE 0 END FROM lv WHERE live <> prev AND NOT always
UNION ALL SELECT user_id, 'opacity', frame, 'hold', 0 FROM lv WHERE frame = 0 AND NOT live""")
def assemble_program(spark, sf):
    """Signups become predicted keys, every fifth slot is padding; purchases are the template."""
    t = track(spark, sf, "value", "event_type").selectExpr("user_id % 10 AS element_id", "user_id AS shape_id", "frame", "event_id", "event_type", "value")
    tmpl = t.where("event_type = 'purchase'").selectExpr("element_id", "shape_id", "frame", "CASE event_id % 2 WHEN 0 THEN 'linear' ELSE 'hold' END AS interp")
    pred = t.where("event_type = 'signup'").selectExpr(
        "element_id", "shape_id", f"CASE WHEN event_id % 5 > 0 THEN frame ELSE {P.PAD_FRAME} END AS frame", "array(value) AS value")
    live = t.selectExpr("element_id", "shape_id", "frame", "value > 20 AS live")
    shapes = t.select("element_id", "shape_id").distinct()
    return P.assemble_program(shapes, tmpl, pred, live).selectExpr("shape_id", "track", "frame", "interp", "value[0] AS v")


GRID = [(on, off, gap) for on in (0.4, 0.6) for off in (0.2, 0.4, 0.6) for gap in (1, 3)]
GRID_SQL = "grid(ton, toff, gap) AS (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c})" for a, b, c in GRID) + ")"
SWEEP_SQL = f"""{life.CELLS_SQL}, {GRID_SQL}, w AS (SELECT * FROM cells, grid WHERE toff <= ton), h AS (
  SELECT *, coalesce(last_value(CASE WHEN p > ton THEN true WHEN p <= toff THEN false END IGNORE NULLS)
    OVER (PARTITION BY user_id, ton, toff, gap ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS live FROM w), r AS (
  SELECT *, frame - row_number() OVER (PARTITION BY user_id, ton, toff, gap, live ORDER BY frame) AS g FROM h), z AS (
  SELECT *, count(*) OVER q AS len, min(frame) OVER q AS lo, max(frame) OVER q AS hi, max(frame) OVER (PARTITION BY user_id, ton, toff, gap) AS fin
  FROM r WINDOW q AS (PARTITION BY user_id, ton, toff, gap, live, g)), d AS (
  SELECT *, live OR (len < gap AND lo > 0 AND hi < fin) AS d FROM z), l AS (
  SELECT *, lag(d) OVER v AS dp, lag(truth) OVER v AS tp FROM d WINDOW v AS (PARTITION BY user_id, ton, toff, gap ORDER BY frame)), s AS (
  SELECT ton AS "on", toff AS "off", gap, count(*) AS cells, count(*) FILTER (d = truth)::DOUBLE / count(*) AS accuracy,
         count(*) FILTER (d AND NOT truth)::DOUBLE / count(*) AS fp_rate, count(*) FILTER (NOT d AND truth)::DOUBLE / count(*) AS fn_rate,
         count(*) FILTER (d <> dp)::DOUBLE / greatest(1, count(*) FILTER (truth <> tp)) AS transition_ratio FROM l GROUP BY ALL)"""


def _sweep(spark, sf):
    grid = spark.createDataFrame(GRID, "on double, off double, gap int")
    return P.sweep(life.cells(spark, sf, "p", "truth"), ["user_id"], grid)


@query("sweep", f"""WITH {SWEEP_SQL} SELECT "on", "off", gap, cells, round(accuracy, 6) AS accuracy, round(fp_rate, 6) AS fp_rate,
  round(fn_rate, 6) AS fn_rate, round(transition_ratio, 6) AS transition_ratio FROM s""")
def sweep(spark, sf):
    return rounded(_sweep(spark, sf))


@query("sweep_best", f"""WITH {SWEEP_SQL} SELECT "on", "off", gap, round(accuracy, 6) AS accuracy FROM s ORDER BY accuracy DESC, "on", "off", gap LIMIT 1""")
def sweep_best(spark, sf):
    return rounded(SC.sweep_best(_sweep(spark, sf), ["on", "off", "gap"], "accuracy"))


@query("dense_points", f"""WITH {TRACK_SQL}, k AS (
  SELECT user_id, frame AS f0, lead(frame) OVER w AS f1, value AS p1, lead(value) OVER w AS p2 FROM track WHERE event_type = 'purchase'
  WINDOW w AS (PARTITION BY user_id ORDER BY frame)), fk AS (SELECT user_id, arg_min(p1, f0) AS fv FROM k GROUP BY 1), o AS (
  SELECT user_id, frame AS o0, value AS ov FROM track WHERE event_type = 'view'), fo AS (SELECT user_id, arg_min(ov, o0) AS fov FROM o GROUP BY 1), s AS (
  SELECT t.user_id, t.frame, t.event_type, CASE WHEN f0 IS NULL THEN fv WHEN f1 IS NULL THEN p1
         ELSE p1 * (1 - (t.frame - f0)::DOUBLE / (f1 - f0)) + p2 * ((t.frame - f0)::DOUBLE / (f1 - f0)) END AS x
  FROM track t JOIN fk USING (user_id) ASOF LEFT JOIN k ON k.user_id = t.user_id AND k.f0 <= t.frame), v AS (
  SELECT s.*, coalesce(o.ov, fov) AS op FROM s LEFT JOIN fo ON fo.user_id = s.user_id ASOF LEFT JOIN o ON o.user_id = s.user_id AND o.o0 <= s.frame)
SELECT user_id AS shape_id, frame, 0 AS point_idx, round(x, 6) AS x, round((2 * x + frame) * 100 + 50 - 10, 6) AS cx,
       CASE WHEN op IS NULL THEN true ELSE least(greatest(op / 100, 0), 1) > 0.5 END AS live, event_type = 'purchase' AS is_key FROM v""")
def dense_points(spark, sf):
    """Sampled path, opacity, matrix and crop per cell, as one plan over long rows."""
    t = track(spark, sf, "value", "event_type").selectExpr("user_id % 10 AS element_id", "user_id AS shape_id", "frame", "event_type", "value")
    path = t.where("event_type = 'purchase'").selectExpr("element_id", "shape_id", "frame", "'linear' AS interp", "array(value, 1D) AS value")
    op = t.where("event_type = 'view'").selectExpr("element_id", "shape_id", "frame", "'hold' AS interp", "array(value) AS value")
    cells = t.selectExpr("element_id", "shape_id", "frame", "0 AS path_lo", "1000000 AS path_hi")
    mats = t.selectExpr("element_id", "shape_id", "frame",
                        "array(2D, 0D, 0D, 0D, 0D, 2D, 0D, 0D, 0D, 0D, 1D, 0D, CAST(frame AS DOUBLE), 0D, 0D, 1D) AS matrix")
    crops = t.select("element_id", "frame").distinct().selectExpr(
        "element_id", "frame", "100 AS width", "100 AS height", "10D AS x0", "0D AS y0", "1D AS scale", "1 AS out_px")
    return rounded(P.dense_points(cells, path, op, mats, crops).select(
        "shape_id", "frame", "point_idx", "x", "cx", "live", "is_key"))
