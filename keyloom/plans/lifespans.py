"""State-track queries over the per-user event tracks.

An element is ``user_id % 10``, its shapes are the users, the probability is ``value / 100``
clipped to [0, 1] and the truth is a purchase or a view.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import clip, ratio
from ..operators import lifespans as L
from .registry import query
from .tables import TRACK_SQL, track

ON, OFF, GAP = 0.6, 0.3, 3


def cells(spark, sf, *cols):
    """Cells with the named columns out of ``element``, ``p`` and ``truth``."""
    made = {"element": (F.col("user_id") % 10).alias("element"),
            "p": clip(F.col("value") / 100.0, 0.0, 1.0).alias("p"),
            "truth": F.col("event_type").isin("purchase", "view").alias("truth")}
    reads = {"p": "value", "truth": "event_type"}
    t = track(spark, sf, *[reads[c] for c in cols if c in reads])
    return t.select("user_id", "frame", *[made[c] for c in cols])


CELLS_SQL = f"""{TRACK_SQL}, cells AS (
  SELECT user_id, user_id % 10 AS element, frame,
         least(greatest(value / 100.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS p,
         event_type IN ('purchase', 'view') AS truth
  FROM track)"""

HYST_SQL = f"""{CELLS_SQL}, hyst AS (
  SELECT *, coalesce(last_value(CASE WHEN p > {ON}::DOUBLE THEN true WHEN p <= {OFF}::DOUBLE THEN false END
                                IGNORE NULLS)
                     OVER (PARTITION BY user_id ORDER BY frame
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS live
  FROM cells), runs AS (
  SELECT *, frame - row_number() OVER (PARTITION BY user_id, live ORDER BY frame) AS grp FROM hyst
), sized AS (
  SELECT *, count(*) OVER (PARTITION BY user_id, live, grp) AS len,
         min(frame) OVER (PARTITION BY user_id, live, grp) AS run_lo,
         max(frame) OVER (PARTITION BY user_id, live, grp) AS run_hi,
         max(frame) OVER (PARTITION BY user_id) AS last_frame
  FROM runs), closed AS (
  SELECT user_id, element, frame, p, truth, live,
         live OR (len < {GAP} AND run_lo > 0 AND run_hi < last_frame) AS closed
  FROM sized)"""


def _hyst(spark, sf, *cols):
    return L.hysteresis(cells(spark, sf, "p", *cols), ["user_id"], "p", ON, OFF,
                        keep=["user_id", "frame", *cols])


def _closed(spark, sf, *cols):
    return L.close_gaps(_hyst(spark, sf, *cols), ["user_id"], GAP)


@query("hysteresis", f"WITH {HYST_SQL} SELECT user_id, frame, live FROM hyst")
def hysteresis(spark, sf):
    return _hyst(spark, sf).select("user_id", "frame", "live")


@query("close_gaps", f"WITH {HYST_SQL} SELECT user_id, frame, live, closed FROM closed")
def close_gaps(spark, sf):
    return _closed(spark, sf).select("user_id", "frame", "live", "closed")


@query("islands", f"""WITH {HYST_SQL}
SELECT user_id, min(frame) AS start, max(frame) AS "end" FROM (
  SELECT *, frame - row_number() OVER (PARTITION BY user_id, closed ORDER BY frame) AS g FROM closed)
WHERE closed GROUP BY user_id, g""")
def islands(spark, sf):
    return L.islands(_closed(spark, sf), ["user_id"], "closed")


@query("transitions", f"""WITH {HYST_SQL}
SELECT user_id, frame, CASE WHEN closed THEN 'on' ELSE 'off' END AS change,
       CASE WHEN closed THEN frame ELSE frame - 1 END AS live_side
FROM (SELECT *, lag(closed) OVER (PARTITION BY user_id ORDER BY frame) AS was FROM closed)
WHERE was IS NOT NULL AND was <> closed""")
def transitions(spark, sf):
    return L.transitions(_closed(spark, sf), ["user_id"], "closed")


@query("mask_to_keys", f"""WITH {HYST_SQL}, edge AS (
  SELECT *, lag(closed, 1, false) OVER (PARTITION BY user_id ORDER BY frame) AS prev,
         bool_and(closed) OVER (PARTITION BY user_id) AS always FROM closed)
SELECT user_id, frame, CASE WHEN closed THEN 100.0 ELSE 0.0 END::DOUBLE AS value, 'hold' AS interp
FROM edge WHERE closed <> prev AND NOT always
UNION ALL
SELECT user_id, frame, 0.0::DOUBLE, 'hold' FROM edge WHERE frame = 0 AND NOT closed""")
def mask_to_keys(spark, sf):
    return L.mask_to_keys(_closed(spark, sf), ["user_id"], "closed")


@query("mask_confusion", f"""WITH {HYST_SQL}, lagged AS (
  SELECT *, lag(closed) OVER w AS pp, lag(truth) OVER w AS pt FROM closed
  WINDOW w AS (PARTITION BY user_id ORDER BY frame))
SELECT element, count(*) AS cells,
       round(count(*) FILTER (closed = truth)::DOUBLE / count(*), 6) AS accuracy,
       round(count(*) FILTER (closed AND NOT truth)::DOUBLE / count(*), 6) AS fp_rate,
       round(count(*) FILTER (NOT closed AND truth)::DOUBLE / count(*), 6) AS fn_rate,
       round(count(*) FILTER (closed)::DOUBLE / count(*), 6) AS live_rate_pred,
       round(count(*) FILTER (truth)::DOUBLE / count(*), 6) AS live_rate_true,
       count(*) FILTER (closed <> pp) AS transitions_pred,
       count(*) FILTER (truth <> pt) AS transitions_true
FROM lagged GROUP BY element""")
def mask_confusion(spark, sf):
    out = L.confusion(_closed(spark, sf, "element", "truth"), ["element"], "closed", "truth", track=["element", "user_id"])
    rates = ("accuracy", "fp_rate", "fn_rate", "live_rate_pred", "live_rate_true")
    return out.select("element", "cells", *[F.round(c, 6).alias(c) for c in rates],
                      "transitions_pred", "transitions_true")


@query("label_confusion", """SELECT count(*) AS cells,
  count(*) FILTER (quality = 1 AND toxic = 1) AS both, count(*) FILTER (quality = 1 AND toxic = 0) AS fp,
  count(*) FILTER (quality = 0 AND toxic = 1) AS fn, source
FROM labels JOIN documents USING (doc_id) WHERE quality = 1 OR toxic = 1 GROUP BY source""")
def label_confusion(spark, sf):
    """Confusion by full join of two sparse live tables (absent row = dead cell)."""
    from .tables import load
    lab = load(spark, sf, "labels")
    docs = load(spark, sf, "documents").select("doc_id", "source")
    both = L.outer_cells(lab.where("quality = 1"), lab.where("toxic = 1"), ["doc_id"])
    return both.join(docs, "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("pred") & F.col("truth")).alias("both"),
        F.count_if(F.col("pred") & ~F.col("truth")).alias("fp"),
        F.count_if(~F.col("pred") & F.col("truth")).alias("fn"))


@query("dilate_erode", f"""WITH {HYST_SQL}
SELECT user_id, frame,
       closed OR lag(closed, 1, false) OVER w OR lead(closed, 1, false) OVER w AS dilated,
       closed AND lag(closed, 1, true) OVER w AND lead(closed, 1, true) OVER w AS eroded
FROM closed WINDOW w AS (PARTITION BY user_id ORDER BY frame)""")
def dilate_erode(spark, sf):
    c = _closed(spark, sf)
    d = L.shift_mask(c, ["user_id"], "dilate", "closed", name="dilated")
    return L.shift_mask(d, ["user_id"], "erode", "closed", name="eroded").select(
        "user_id", "frame", "dilated", "eroded")


@query("any_live", f"""WITH {HYST_SQL}
SELECT element, frame, bool_or(closed) AS any_live FROM closed GROUP BY ALL""")
def any_live(spark, sf):
    return L.any_live(_closed(spark, sf, "element"), ["element", "frame"], "closed")


@query("coverage_rule", f"""WITH {CELLS_SQL}, f AS (
  SELECT element, frame, truth, bool_or(truth) OVER (PARTITION BY element, frame) AS rule FROM cells)
SELECT element, count(*) AS cells, count(*) FILTER (truth) AS live_cells,
       round(count(*) FILTER (truth = rule)::DOUBLE / count(*), 6) AS agreement
FROM f GROUP BY element""")
def coverage_rule(spark, sf):
    return L.coverage_rule(cells(spark, sf, "element", "truth"), ["element"], flag="truth").select(
        "element", "cells", "live_cells", F.round("agreement", 6).alias("agreement"))


@query("noisy_mask", f"""WITH {CELLS_SQL}, h AS (
  SELECT element, user_id, frame, truth, count(*) OVER (PARTITION BY element) AS n, row_number() OVER (
    PARTITION BY element, truth ORDER BY md5(concat_ws(':', '7', user_id, frame)), user_id, frame) - 1 AS rk FROM cells)
SELECT element, user_id, frame, truth, truth OR rk < round_even(0.03 * n, 0) AS noisy FROM h""")
def noisy_mask(spark, sf):
    """Flips ranked by a seeded order."""
    c = cells(spark, sf, "element", "truth")
    return L.noisy_mask(c, ["element"], 0.03, "fp", 7, ["user_id", "frame"], "truth").select(
        "element", "user_id", "frame", "truth", "noisy")


@query("live_cells", f"""WITH {CELLS_SQL}, span AS (
  SELECT user_id, min(frame) FILTER (truth) AS path_lo, max(frame) FILTER (truth) AS path_hi
  FROM cells GROUP BY user_id)
SELECT user_id, frame, CASE WHEN user_id % 3 = 0 THEN frame BETWEEN path_lo AND path_hi ELSE p > 0 END AS live_any,
       CASE WHEN user_id % 3 = 0 THEN true ELSE p > 0.5 END AS live_half
FROM cells JOIN span USING (user_id)""")
def live_cells(spark, sf):
    """Every third shape carries no opacity track and is live over its own key range."""
    from ..functions.ordered import chunk_id, with_totals
    c = with_totals(cells(spark, sf, "p", "truth"), ["user_id"], {
        "path_lo": ("min", F.when(F.col("truth"), F.col("frame"))),
        "path_hi": ("max", F.when(F.col("truth"), F.col("frame")))}, chunk_id("frame"))
    c = c.withColumn("opacity", F.when(F.col("user_id") % 3 != 0, F.col("p") * 100.0))
    return L.live_cells(c).select("user_id", "frame", "live_any", "live_half")


@query("live_summary", f"""WITH {HYST_SQL}, lagged AS (
  SELECT *, lag(closed, 1, false) OVER w AS prev, lag(closed) OVER w AS was FROM closed
  WINDOW w AS (PARTITION BY user_id ORDER BY frame))
SELECT user_id, count(*) AS frames, count(*) FILTER (closed) AS live_frames,
       count(*) FILTER (closed AND NOT prev) AS intervals,
       count(*) FILTER (closed <> was) AS transitions,
       round(count(*) FILTER (closed)::DOUBLE / count(*), 6) AS live_rate
FROM lagged GROUP BY ROLLUP (user_id)""")
def live_summary(spark, sf):
    """Threshold, repair, then intervals, changes and live rate per user with an all-users row."""
    from ..functions.ordered import stencil
    c = stencil(_closed(spark, sf), ["user_id"], "frame", {
        "was": lambda w: F.lag("closed").over(w)}, 1)
    begins = F.col("closed") & ~F.coalesce("was", F.lit(False))
    return c.rollup("user_id").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if("closed").alias("live_frames"),
        F.count_if(begins).alias("intervals"),
        F.count_if(F.col("closed") != F.col("was")).alias("transitions"),
        F.round(ratio(F.count_if("closed"), F.count(F.lit(1))), 6).alias("live_rate"))
