"""Datasets and scores that queries write and read back: versions, shots, existence, score files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import work_dir
from ..operators import scoring as S
from ..sources import versions as V
from .registry import query
from .scoring import LAYOUT, LAYOUT_SQL, SEED_METRICS, SEEDS, seeds
from .tables import TRACK_SQL, load, track


def published(spark, sf):
    """The tracks as a version: points by event type (shot) and user (element), and one row per element. Its root."""
    points = track(spark, sf, "event_type", "value").selectExpr(
        "event_type AS shot", "user_id AS element_id", "frame", "event_id", "value")
    elements = points.groupBy("shot", "element_id").agg(F.expr("count(1) AS n_frames"), F.expr("max(frame) AS last_frame"))
    root = work_dir(spark)
    V.write_version({"points": points, "elements": elements}, root, "v003", facts={"dataset_version": "v003"})
    return root


@query("dataset_points", f"""WITH {TRACK_SQL} SELECT event_type AS shot, user_id AS element_id, frame, event_id, value FROM track""")
def dataset_points(spark, sf):
    """Every row of a published version, read back."""
    return V.read_version(spark, published(spark, sf), "v003", "points")


@query("dataset_shots", f"""WITH {TRACK_SQL} SELECT event_type AS shot, user_id AS element_id, count(*) AS n_frames, max(frame) AS last_frame, round(avg(value), 6) AS mean
FROM track WHERE event_type IN ('purchase', 'error') GROUP BY ALL""")
def dataset_shots(spark, sf):
    """Two shots of a version: only their folders are opened; elements joined to their points."""
    root = published(spark, sf)
    points, elements = (V.read_version(spark, root, "v003", t, ["purchase", "error"]) for t in ("points", "elements"))
    means = points.groupBy("shot", "element_id").agg(F.expr("round(avg(value), 6) AS mean"))
    return elements.join(means, ["shot", "element_id"])


@query("dataset_states", f"""WITH {TRACK_SQL}, t AS (SELECT count(*) AS n FROM track)
SELECT 'published' AS state, true AS version_exists, true AS prefix_exists, n AS rows_written, n AS rows_read, 1 AS refusals FROM t
UNION ALL SELECT 'overwritten', true, true, n, n, 0 FROM t
UNION ALL SELECT 'half written', false, true, n, NULL, 0 FROM t
UNION ALL SELECT 'never written', false, false, 0, NULL, 0 FROM t""")
def dataset_states(spark, sf):
    """What readers see of a published, an overwritten, a half-written and an absent version; and who is refused."""
    points = track(spark, sf, "event_type", "value").selectExpr("event_type AS shot", "user_id AS element_id", "frame", "value")
    root, rows = work_dir(spark), []

    def seen(state, version, written, refusals):
        found = V.read_version(spark, root, version, "points")
        there = V.prefix_exists(spark, f"{root}/datasets/{version}")
        rows.append((state, V.version_exists(spark, root, version), there, written, None if found is None else found.count(), refusals))

    n = V.write_version({"points": points}, root, "v1")["tables"]["points"]["rows"]
    try:
        V.write_version({"points": points}, root, "v1")
        refused = 0
    except FileExistsError:
        refused = 1
    seen("published", "v1", n, refused)
    V.write_version({"points": points.limit(0)}, root, "v2")
    seen("overwritten", "v2", V.write_version({"points": points}, root, "v2", overwrite=True)["tables"]["points"]["rows"], 0)
    seen("half written", "v3", V.write_tables({"points": points}, f"{root}/datasets/v3/data/lost")["points"]["rows"], 0)
    seen("never written", "v4", 0, 0)
    return spark.createDataFrame(rows, "state string, version_exists boolean, prefix_exists boolean, rows_written long, rows_read long, refusals int")


@query("score_files", f"""WITH {SEEDS}, {LAYOUT_SQL}, agg AS (
  SELECT attempt, metric, avg(value) AS m, max(value) - min(value) AS s FROM long GROUP BY ALL), cells AS (
  SELECT a.attempt, section, ordinal, label, coalesce(CASE decimals WHEN 4 THEN printf('%.4f', m) ELSE printf('%.3f', m) END, '--') AS value,
         coalesce(CASE decimals WHEN 4 THEN printf('%.4f', s) ELSE printf('%.3f', s) END, '') AS spread
  FROM (SELECT DISTINCT attempt FROM long) a CROSS JOIN layout l LEFT JOIN agg g ON g.attempt = a.attempt AND g.metric = l.metric)
SELECT attempt, 'table' AS file, string_agg(rpad(label, 38, ' ') || ' ' || lpad(value, 10, ' ') || ' ' || lpad(spread, 9, ' ') || chr(10), '' ORDER BY section, ordinal) AS content
FROM cells GROUP BY 1
UNION ALL SELECT attempt, 'summary ' || run, printf('%.6f', mean_soft_iou) || ' ' || printf('%.6f', point_err_px) FROM seeds""")
def score_files(spark, sf):
    """Both attempts' summaries and rendered tables, written next to their runs and read back."""
    layout = spark.createDataFrame(LAYOUT, "section string, ordinal int, label string, metric string, decimals int")
    runs, root, out = seeds(spark, sf), work_dir(spark), []
    for attempt in "OF":
        own = runs.where(F.col("attempt") == attempt)
        V.write_scores(own, S.results_table(S.long_metrics(own, ["run"], SEED_METRICS), layout), f"{root}/runs/{attempt}")
        out.append(spark.read.text(f"{root}/runs/{attempt}/table", wholetext=True).selectExpr(
            f"'{attempt}' AS attempt", "'table' AS file", "value AS content"))
        out.append(spark.read.json(f"{root}/runs/{attempt}/summary").selectExpr(
            "attempt", "concat('summary ', run) AS file", "concat(format_string('%.6f', mean_soft_iou), ' ', format_string('%.6f', point_err_px)) AS content"))
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first
