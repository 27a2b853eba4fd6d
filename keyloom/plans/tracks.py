"""Keyed-track queries over the per-user event tracks; keys are purchases on the frame axis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracks as T
from .registry import query
from .scoring import rounded
from .tables import TRACK_SQL, load, track

MODES_SQL = """CASE event_id % 3 WHEN 0 THEN 'linear' WHEN 1 THEN 'hold' ELSE 'catmullrom' END"""


def keyed(spark, sf):
    """(all frames, purchase keys with value and interpolation)."""
    t = track(spark, sf, "event_type", "value")
    keys = t.where("event_type = 'purchase'").select(
        "user_id", "frame", F.expr(MODES_SQL).alias("interp"), F.array("value").alias("value"))
    return t.select("user_id", "frame"), keys


SEG_SQL = f"""{TRACK_SQL}, k AS (
  SELECT user_id, frame, {MODES_SQL} AS interp, value FROM track WHERE event_type = 'purchase'), seg AS (
  SELECT user_id, frame AS f0, lead(frame) OVER w AS f1, interp, value AS p1,
         coalesce(lag(value) OVER w, value) AS p0, coalesce(lead(value) OVER w, value) AS p2,
         coalesce(lead(value, 2) OVER w, lead(value) OVER w, value) AS p3
  FROM k WINDOW w AS (PARTITION BY user_id ORDER BY frame)), firsts AS (
  SELECT user_id, arg_min(value, frame) AS fv FROM k GROUP BY 1), s AS (
  SELECT t.user_id, t.frame, fv, seg.*, CASE WHEN f1 > f0 THEN (t.frame - f0)::DOUBLE / (f1 - f0) ELSE 0 END AS u
  FROM track t JOIN firsts USING (user_id)
  ASOF LEFT JOIN seg ON t.user_id = seg.user_id AND t.frame >= seg.f0)"""


def _sample_sql(mode):
    m = f"'{mode}'" if mode else "interp"
    return f"""WITH {SEG_SQL}
SELECT user_id, frame, CASE WHEN f0 IS NULL THEN fv WHEN f1 IS NULL OR {m} = 'hold' THEN p1
  WHEN {m} = 'catmullrom' THEN 0.5::DOUBLE * (2 * p1 + (p2 - p0) * u + (2 * p0 - 5 * p1 + 4 * p2 - p3) * u * u
       + (-p0 + 3 * p1 - 3 * p2 + p3) * u * u * u)
  ELSE p1 * (1 - u) + p2 * u END AS value FROM s"""


def _sampled(mode):
    def run(spark, sf):
        frames, keys = keyed(spark, sf)
        return T.sample_track(keys, frames, ["user_id"], mode).selectExpr(
            "user_id", "frame", "value[0] AS value")
    return run


for _name, _mode in (("sample_track_linear", "linear"), ("sample_track_hold", "hold"),
                     ("sample_track_catmullrom", "catmullrom"), ("sample_track_mixed", None)):
    query(_name, _sample_sql(_mode))(_sampled(_mode))


@query("dense_axis", f"""WITH {TRACK_SQL}, span AS (
  SELECT user_id, min(frame) AS lo, max(frame) AS hi FROM track WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, unnest(range(lo, hi + 1, 2)) AS frame FROM span""")
def dense_axis(spark, sf):
    t = track(spark, sf, "event_type").where("event_type = 'purchase'")
    span = t.groupBy("user_id").agg(F.min("frame").cast("long").alias("lo"), F.max("frame").cast("long").alias("hi"))
    return T.dense_axis(span, ["user_id"], step=2)


@query("key_axis", f"""WITH {TRACK_SQL}
SELECT user_id, least(min(frame) FILTER (event_type = 'purchase'), min(frame) FILTER (event_type = 'view')) AS lo,
  greatest(max(frame) FILTER (event_type = 'purchase'), max(frame) FILTER (event_type = 'view')) AS hi
FROM track WHERE event_type IN ('purchase', 'view') GROUP BY 1""")
def key_axis(spark, sf):
    t = track(spark, sf, "event_type")
    return T.key_axis(t.where("event_type = 'purchase'"), t.where("event_type = 'view'"), ["user_id"])


@query("key_mask", f"""WITH {TRACK_SQL}
SELECT user_id, frame, event_type = 'purchase' AS is_key FROM track""")
def key_mask(spark, sf):
    frames, keys = keyed(spark, sf)
    return T.key_mask(keys, frames, ["user_id"])


SIZED_SQL = f"""{TRACK_SQL}, sized AS (
  SELECT user_id, frame, value, count(*) OVER (PARTITION BY user_id) AS t FROM track), fit AS (
  SELECT *, CASE WHEN t < 3 THEN 1 ELSE greatest(1, least(9, CASE WHEN t % 2 = 1 THEN t ELSE t - 1 END)) END AS w FROM sized)"""


@query("smooth_boxcar", f"""WITH {SIZED_SQL}
SELECT a.user_id, a.frame, round(CASE WHEN any_value(a.w) <= 1 THEN any_value(a.value) ELSE sum(b.value) / any_value(a.w) END, 6) AS value
FROM fit a, range(-4, 5) d(d), fit b
WHERE abs(d) <= a.w // 2 AND b.user_id = a.user_id AND b.frame = least(greatest(a.frame + d, 0), a.t - 1)
GROUP BY a.user_id, a.frame""")
def smooth_boxcar(spark, sf):
    t = track(spark, sf, "value").select("user_id", "frame", "value")
    return rounded(T.smooth(t, ["user_id"], ["value"], 9))


def _savgol_values():
    return ", ".join(f"({w}, {o}, {i}, {c!r}::DOUBLE)" for w in (3, 5, 7, 9) for o, i, c in T.savgol_weights(w, 2))


@query("smooth_savgol", f"""WITH {SIZED_SQL}, k(w, o, i, c) AS (VALUES {_savgol_values()}),
m AS (SELECT *, least(greatest(frame, w // 2), t - 1 - w // 2) AS mid FROM fit WHERE w > 1)
SELECT m.user_id, m.frame, round(sum(k.c * b.value), 6) AS value
FROM m JOIN k ON k.w = m.w AND k.o = m.frame - m.mid JOIN fit b ON b.user_id = m.user_id AND b.frame = m.mid + k.i
GROUP BY 1, 2 UNION ALL SELECT user_id, frame, round(value, 6) FROM fit WHERE w <= 1""")
def smooth_savgol(spark, sf):
    t = track(spark, sf, "value").select("user_id", "frame", "value")
    return rounded(T.smooth(t, ["user_id"], ["value"], 9, "savgol"))


@query("segment_cost", f"""WITH {TRACK_SQL}
SELECT a.user_id, a.frame AS a, b.frame AS b,
  round(coalesce(max(sqrt(pow(m.value - (a.value * (1 - (m.frame - a.frame) / (b.frame - a.frame))
                     + b.value * ((m.frame - a.frame) / (b.frame - a.frame))), 2))), 0), 6) AS cost
FROM track a JOIN track b ON a.user_id = b.user_id AND b.frame BETWEEN a.frame + 1 AND a.frame + 6
LEFT JOIN track m ON m.user_id = a.user_id AND m.frame > a.frame AND m.frame < b.frame GROUP BY ALL""")
def segment_cost(spark, sf):
    t = track(spark, sf, "value")
    return rounded(T.segment_cost(t, ["user_id"], ["value"], 6).selectExpr(
        "user_id", "a", "CAST(b AS INT) AS b", "cost"))


@query("local_tol", f"""SELECT event_id, round(2.0::DOUBLE * least(greatest(1 - 0.5::DOUBLE * least(value / 100, 1)
  + 0.8::DOUBLE * (1 - least(value / 100, 1)), 0.2), 4.0), 6) AS tol FROM events""")
def local_tol(spark, sf):
    ev = load(spark, sf, "events").selectExpr("event_id", "value / 100 AS p")
    return rounded(T.local_tol(ev, 2.0, 0.5, 0.8).select("event_id", "tol"))


@query("context_window", f"""WITH {TRACK_SQL}
SELECT user_id, frame, coalesce(lag(value, 1) OVER w, first_value(value) OVER w) AS value_0, value AS value_1,
       coalesce(lead(value, 1) OVER w, last_value(value) OVER (PARTITION BY user_id ORDER BY frame
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value_2
FROM track WINDOW w AS (PARTITION BY user_id ORDER BY frame)""")
def context_window(spark, sf):
    return T.context_window(track(spark, sf, "value"), ["user_id"], "value", 3)


PRED_SQL = f"""{TRACK_SQL}, pt AS (
  SELECT user_id % 10 AS element, user_id, frame, value AS px, event_id % 7 AS py, value * 0.9 AS tx, event_id % 5 AS ty,
         event_type <> 'error' AS live FROM track), l AS (
  SELECT *, lag(px - tx) OVER w AS lx, lag(py - ty) OVER w AS ly, lag(live) OVER w AS ll, lag(frame) OVER w AS lf
  FROM pt WINDOW w AS (PARTITION BY user_id ORDER BY frame))"""


def predicted_points(spark, sf):
    return track(spark, sf, "value", "event_type").selectExpr(
        "user_id % 10 AS element", "user_id", "frame", "value AS px", "event_id % 7 AS py", "value * 0.9D AS tx",
        "event_id % 5 AS ty", "event_type <> 'error' AS live")


@query("track_jitter", f"""WITH {PRED_SQL}
SELECT element, round(coalesce(avg(sqrt(pow(px - tx - lx, 2) + pow(py - ty - ly, 2))) FILTER (live AND ll), 0), 6) AS jitter_px
FROM l GROUP BY element""")
def track_jitter(spark, sf):
    return rounded(T.track_jitter(predicted_points(spark, sf), ["element"], ["user_id"], 1.0))


@query("temporal_error", f"""WITH {PRED_SQL}
SELECT element, round(coalesce((sum(abs(px - tx - lx) + abs(py - ty - ly)) FILTER (live AND ll AND frame - lf = 1))
  / nullif(2 * count(*) FILTER (live AND ll AND frame - lf = 1), 0), 0), 6) AS temporal_error FROM l GROUP BY element""")
def temporal_error(spark, sf):
    return rounded(T.temporal_error(predicted_points(spark, sf), ["element"], ["user_id"], [("px", "tx"), ("py", "ty")]))


@query("fill_track", f"""WITH {TRACK_SQL}, g AS (
  SELECT user_id, frame, CASE WHEN event_type IN ('click', 'view') THEN value END AS value FROM track)
SELECT user_id, frame, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS value FROM g""")
def fill_track(spark, sf):
    t = track(spark, sf, "event_type", "value").selectExpr(
        "user_id", "frame", "CASE WHEN event_type IN ('click', 'view') THEN value END AS value")
    return T.fill_track(t, ["user_id"], ["value"])
