"""Score roll-up queries: run = return flag, element = supplier, frame = order line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from .registry import query
from .tables import FRAME_SCORES_SQL, frame_scores, load

HELD_ELEMENTS = 5


def rounded(df, digits=6):
    """Round the floating columns once, at the end, so both engines print the same value."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


SUMMARY = f"""{FRAME_SCORES_SQL}, summary AS (
  SELECT run, element_id, count(*) AS frames, avg(soft_iou) AS mean_soft_iou,
         min(soft_iou) AS min_soft_iou, avg(iou) AS mean_iou,
         count(*) FILTER (soft_iou < 0.95::DOUBLE) AS frames_below_095,
         count(*) FILTER (soft_iou < 0.90::DOUBLE) AS frames_below_090,
         arg_min(frame, (soft_iou, frame)) AS worst_frame,
         avg(point_err) AS point_err_px, max(point_err) AS max_point_err_px,
         quantile_cont(soft_iou, 0.05) AS p05_soft_iou,
         quantile_cont(point_err, 0.95) AS p95_point_err_px,
         count(*) FILTER (coverage > 0) AS frames_onscreen,
         count(*) FILTER (coverage <= 0) AS frames_offscreen,
         avg(soft_iou) FILTER (coverage > 0) AS mean_soft_iou_onscreen,
         min(soft_iou) FILTER (coverage > 0) AS min_soft_iou_onscreen,
         count(*) FILTER (coverage > 0 AND soft_iou < 0.90::DOUBLE) AS frames_below_090_onscreen,
         avg(soft_iou) FILTER (held) AS held_soft_iou,
         CASE WHEN count(*) FILTER (held) > 0 THEN avg(soft_iou) FILTER (NOT held) END AS train_soft_iou,
         count(*) FILTER (held) AS held_frames,
         count(*) FILTER (artist_key) AS keys_artist, count(*) FILTER (pred_key) AS keys_predicted,
         coalesce(2.0::DOUBLE * count(*) FILTER (artist_key AND pred_key)
                  / nullif(count(*) FILTER (artist_key) + count(*) FILTER (pred_key), 0), 0::DOUBLE) AS key_f1,
         element_id % {HELD_ELEMENTS} <> 0 AS in_train
  FROM frame_scores GROUP BY run, element_id)"""


def summary(spark, sf):
    """Per-element rows with every block the roll-ups read, in one pass over the scores."""
    fs = frame_scores(spark, sf)
    rows = S.element_rows(fs, aggs=S.ELEMENT_AGGS + S.ONSCREEN_AGGS + S.SPLIT_AGGS + (
        "count_if(artist_key) AS keys_artist", "count_if(pred_key) AS keys_predicted",
        "coalesce(try_divide(2D * count_if(artist_key AND pred_key), "
        "count_if(artist_key) + count_if(pred_key)), 0D) AS key_f1"))
    return S.with_quantiles(rows, fs).withColumn(
        "in_train", F.expr(f"element_id % {HELD_ELEMENTS} <> 0"))


def _r(*cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@query("element_summary", f"""WITH {SUMMARY} SELECT run, element_id, frames, frames_below_095,
  frames_below_090, worst_frame, {_r('mean_soft_iou', 'min_soft_iou', 'mean_iou', 'point_err_px',
  'max_point_err_px', 'p05_soft_iou', 'p95_point_err_px')} FROM summary""")
def element_summary(spark, sf):
    return rounded(S.element_summary(frame_scores(spark, sf)))


@query("onscreen_summary", f"""WITH {SUMMARY} SELECT run, element_id, frames_onscreen, frames_offscreen,
  {_r('mean_soft_iou_onscreen', 'min_soft_iou_onscreen')}, frames_below_090_onscreen FROM summary""")
def onscreen_summary(spark, sf):
    return rounded(S.onscreen_summary(frame_scores(spark, sf)))


@query("split_summary", f"""WITH {SUMMARY} SELECT run, element_id, held_frames,
  {_r('held_soft_iou', 'train_soft_iou')}, round(train_soft_iou - held_soft_iou, 6) AS held_gap FROM summary""")
def split_summary(spark, sf):
    return rounded(S.split_summary(frame_scores(spark, sf)))


TOTALS_COLS = """count(*) AS elements, CAST(sum(frames) AS BIGINT) AS frames,
  sum(mean_soft_iou * frames) / sum(frames) AS mean_soft_iou,
  sum(mean_iou * frames) / sum(frames) AS mean_iou,
  min(mean_soft_iou) AS worst_element_soft_iou,
  arg_min(element_id, (mean_soft_iou, element_id)) AS worst_element,
  min(min_soft_iou) AS worst_frame_soft_iou,
  arg_min(worst_frame, (min_soft_iou, element_id)) AS worst_frame,
  arg_min(element_id, (min_soft_iou, element_id)) AS worst_frame_element,
  CAST(sum(frames_below_095) AS BIGINT) AS frames_below_095,
  CAST(sum(frames_below_090) AS BIGINT) AS frames_below_090,
  100.0::DOUBLE * sum(frames_below_095) / sum(frames) AS frames_below_095_pct,
  100.0::DOUBLE * sum(frames_below_090) / sum(frames) AS frames_below_090_pct,
  100.0::DOUBLE * max(frames_below_090 / frames) AS worst_element_below_090_pct,
  arg_max(element_id, (frames_below_090 / frames, -element_id)) AS worst_element_below_090,
  sum(point_err_px * frames) / sum(frames) AS point_err_px,
  sum(p95_point_err_px * frames) / sum(frames) AS p95_point_err_px,
  max(p95_point_err_px) AS p95_point_err_worst_element_px,
  max(max_point_err_px) AS max_point_err_px,
  CAST(sum(keys_artist) AS BIGINT) AS keys_artist, CAST(sum(keys_predicted) AS BIGINT) AS keys_predicted,
  sum(keys_predicted)::DOUBLE / greatest(1, sum(keys_artist)) AS key_ratio,
  sum(key_f1 * keys_artist) / sum(keys_artist) AS key_f1,
  sum(mean_soft_iou_onscreen * frames_onscreen)
    / sum(frames_onscreen) FILTER (mean_soft_iou_onscreen IS NOT NULL) AS mean_soft_iou_onscreen,
  min(mean_soft_iou_onscreen) AS worst_element_soft_iou_onscreen,
  arg_min(element_id, (mean_soft_iou_onscreen, element_id))
    FILTER (mean_soft_iou_onscreen IS NOT NULL) AS worst_element_onscreen,
  CAST(sum(frames_onscreen) AS BIGINT) AS frames_onscreen,
  CAST(sum(frames_offscreen) AS BIGINT) AS frames_offscreen,
  CAST(sum(frames_below_090_onscreen) AS BIGINT) AS frames_below_090_onscreen,
  sum(held_soft_iou * held_frames) / sum(held_frames) FILTER (held_soft_iou IS NOT NULL) AS held_soft_iou,
  sum(train_soft_iou * held_frames) / sum(held_frames) FILTER (train_soft_iou IS NOT NULL) AS train_soft_iou,
  CAST(sum(held_frames) AS BIGINT) AS held_frames"""

TOTALS_FLOATS = ("mean_soft_iou mean_iou worst_element_soft_iou worst_frame_soft_iou frames_below_095_pct "
                 "frames_below_090_pct worst_element_below_090_pct point_err_px p95_point_err_px "
                 "p95_point_err_worst_element_px max_point_err_px key_ratio key_f1 mean_soft_iou_onscreen "
                 "worst_element_soft_iou_onscreen held_soft_iou train_soft_iou").split()
TOTALS_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in TOTALS_FLOATS)
TOTALS_STAR = (f"* REPLACE ({TOTALS_OUT}), round(train_soft_iou - held_soft_iou, 6) AS held_gap")


@query("run_totals", f"WITH {SUMMARY}, totals AS (SELECT run, {TOTALS_COLS} FROM summary GROUP BY run) "
                     f"SELECT {TOTALS_STAR} FROM totals")
def run_totals(spark, sf):
    return rounded(S.run_totals(summary(spark, sf)))


@query("by_training_status", f"""WITH {SUMMARY}, totals AS (
  SELECT run, 'all' AS block, false AS headline, {TOTALS_COLS} FROM summary GROUP BY run
  UNION ALL SELECT run, 'trained', true, {TOTALS_COLS} FROM summary WHERE in_train GROUP BY run
  UNION ALL SELECT run, 'held', false, {TOTALS_COLS} FROM summary WHERE NOT in_train GROUP BY run)
SELECT {TOTALS_STAR} FROM totals""")
def by_training_status(spark, sf):
    return rounded(S.by_training_status(summary(spark, sf)))


LIFE = """life AS (
  SELECT l_returnflag AS run, l_suppkey AS element_id, count(*) AS frames,
         1 - avg(l_discount) AS mean_soft_iou, 1 - max(l_discount) AS min_soft_iou,
         1 - avg(l_tax) AS mean_iou, 0 AS worst_frame,
         count(*) FILTER (l_discount > 0.05) AS frames_below_095,
         count(*) FILTER (l_discount > 0.10) AS frames_below_090,
         count(*) * 7 AS lifespan_cells, 1 - avg(l_tax) / 2 AS lifespan_accuracy,
         avg(l_tax) / 8 AS lifespan_fp_rate, 3 * avg(l_tax) / 8 AS lifespan_fn_rate,
         count(*) FILTER (l_linenumber = 1) AS lifespan_transitions_pred,
         count(*) FILTER (l_linenumber = 2) AS lifespan_transitions_artist,
         1 - avg(l_tax) FILTER (l_linenumber = 3) AS held_lifespan_accuracy,
         1 - avg(l_tax) FILTER (l_linenumber <> 3) AS train_lifespan_accuracy,
         CASE WHEN l_suppkey % 4 <> 0 THEN avg(CASE WHEN l_quantity > 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END AS point_count_exact,
         count(*) FILTER (l_quantity > 40) AS point_count_over,
         count(*) FILTER (l_quantity <= 10) AS point_count_under,
         CASE WHEN l_suppkey % 3 <> 0 THEN count(DISTINCT l_linenumber) END AS shapes
  FROM lineitem GROUP BY l_returnflag, l_suppkey)"""


@query("lifespan_totals", f"""WITH {LIFE}
SELECT run, CAST(sum(lifespan_cells) AS BIGINT) AS lifespan_cells,
  round(sum(lifespan_accuracy * lifespan_cells) / sum(lifespan_cells), 6) AS lifespan_accuracy,
  round(sum(lifespan_fp_rate * lifespan_cells) / sum(lifespan_cells), 6) AS lifespan_fp_rate,
  round(sum(lifespan_fn_rate * lifespan_cells) / sum(lifespan_cells), 6) AS lifespan_fn_rate,
  round(max(lifespan_fn_rate), 6) AS lifespan_worst_fn_rate,
  round(sum(lifespan_transitions_pred)::DOUBLE / greatest(1, sum(lifespan_transitions_artist)), 6)
    AS lifespan_transition_ratio,
  round(sum(held_lifespan_accuracy * lifespan_cells) / sum(lifespan_cells) FILTER (held_lifespan_accuracy IS NOT NULL), 6)
    AS held_lifespan_accuracy,
  round(sum(train_lifespan_accuracy * lifespan_cells) / sum(lifespan_cells) FILTER (train_lifespan_accuracy IS NOT NULL), 6)
    AS train_lifespan_accuracy,
  round(sum(point_count_exact * coalesce(shapes, frames))
    / sum(coalesce(shapes, frames)) FILTER (point_count_exact IS NOT NULL), 6) AS point_count_exact,
  CAST(sum(point_count_over) FILTER (point_count_exact IS NOT NULL) AS BIGINT) AS point_count_over,
  CAST(sum(point_count_under) FILTER (point_count_exact IS NOT NULL) AS BIGINT) AS point_count_under
FROM life GROUP BY run""")
def lifespan_totals(spark, sf):
    """Cell-weighted lifespan block and shape-weighted point-count block; unmeasured stays null."""
    li = load(spark, sf, "lineitem")
    rows = li.groupBy(F.col("l_returnflag").alias("run"), F.col("l_suppkey").alias("element_id")).agg(
        *[F.expr(e) for e in (
            "count(1) AS frames", "1 - avg(l_discount) AS mean_soft_iou",
            "1 - max(l_discount) AS min_soft_iou", "1 - avg(l_tax) AS mean_iou", "0L AS worst_frame",
            "count_if(l_discount > 0.05) AS frames_below_095", "count_if(l_discount > 0.10) AS frames_below_090",
            "count(1) * 7 AS lifespan_cells", "1 - avg(l_tax) / 2 AS lifespan_accuracy",
            "avg(l_tax) / 8 AS lifespan_fp_rate", "3 * avg(l_tax) / 8 AS lifespan_fn_rate",
            "count_if(l_linenumber = 1) AS lifespan_transitions_pred",
            "count_if(l_linenumber = 2) AS lifespan_transitions_artist",
            "1 - avg(CASE WHEN l_linenumber = 3 THEN l_tax END) AS held_lifespan_accuracy",
            "1 - avg(CASE WHEN l_linenumber <> 3 THEN l_tax END) AS train_lifespan_accuracy",
            "CASE WHEN l_suppkey % 4 <> 0 THEN avg(CASE WHEN l_quantity > 10 THEN 1D ELSE 0D END) END AS point_count_exact",
            "count_if(l_quantity > 40) AS point_count_over", "count_if(l_quantity <= 10) AS point_count_under",
            "CASE WHEN l_suppkey % 3 <> 0 THEN count(DISTINCT l_linenumber) END AS shapes")])
    out = S.run_totals(rows)
    return rounded(out.select(
        "run", "lifespan_cells", "lifespan_accuracy", "lifespan_fp_rate", "lifespan_fn_rate",
        "lifespan_worst_fn_rate", "lifespan_transition_ratio", "held_lifespan_accuracy",
        "train_lifespan_accuracy", "point_count_exact", "point_count_over", "point_count_under"))


SEEDS = """seeds AS (
  SELECT l_returnflag AS run, l_linestatus AS attempt, avg(1 - l_discount) AS mean_soft_iou,
         min(1 - l_discount) AS worst_frame_soft_iou, avg(l_quantity / 10) AS point_err_px,
         avg(l_tax) AS key_ratio FROM lineitem GROUP BY ALL), long AS (
  SELECT attempt, run, unnest(['mean_soft_iou', 'worst_frame_soft_iou', 'point_err_px', 'key_ratio']) AS metric,
         unnest([mean_soft_iou, worst_frame_soft_iou, point_err_px, key_ratio]) AS value FROM seeds)"""
SEED_METRICS = ["mean_soft_iou", "worst_frame_soft_iou", "point_err_px", "key_ratio"]


def seeds(spark, sf):
    return load(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("attempt")).agg(*[F.expr(e) for e in (
            "avg(1 - l_discount) AS mean_soft_iou", "min(1 - l_discount) AS worst_frame_soft_iou",
            "avg(l_quantity / 10) AS point_err_px", "avg(l_tax) AS key_ratio")])


@query("spread", f"""WITH {SEEDS}
SELECT attempt, metric, count(*) AS n_runs, round(avg(value), 6) AS mean, round(min(value), 6) AS min,
       round(max(value), 6) AS max, round(max(value) - min(value), 6) AS range,
       round(CASE WHEN count(*) > 2 THEN stddev_samp(value) END, 6) AS sd
FROM long GROUP BY attempt, metric""")
def spread(spark, sf):
    return rounded(S.spread(seeds(spark, sf), SEED_METRICS, ["attempt"]))


# Fixed report layout: (section, ordinal, label, metric, decimals).
LAYOUT = [
    ("TRAINED ELEMENTS", 1, "soft IoU, mean", "mean_soft_iou", 4),
    ("TRAINED ELEMENTS", 2, "soft IoU, worst frame", "worst_frame_soft_iou", 4),
    ("TRAINED ELEMENTS", 3, "point error, mean px", "point_err_px", 3),
    ("TRAINED ELEMENTS", 4, "key ratio (x artist)", "key_ratio", 3),
    ("TRAINED ELEMENTS", 5, "jitter px", "jitter_px", 3),
]
LAYOUT_SQL = "layout(section, ordinal, label, metric, decimals) AS (VALUES " + ", ".join(
    f"('{s}', {o}, '{lb}', '{m}', {d})" for s, o, lb, m, d in LAYOUT) + ")"


@query("results_table", f"""WITH {SEEDS}, {LAYOUT_SQL}, agg AS (
  SELECT metric, avg(value) AS m, max(value) - min(value) AS s FROM long WHERE attempt = 'O' GROUP BY metric)
SELECT section, ordinal, label,
       coalesce(CASE decimals WHEN 4 THEN printf('%.4f', m) ELSE printf('%.3f', m) END, '--') AS value,
       coalesce(CASE decimals WHEN 4 THEN printf('%.4f', s) ELSE printf('%.3f', s) END, '') AS spread
FROM layout LEFT JOIN agg USING (metric)""")
def results_table(spark, sf):
    layout = spark.createDataFrame(LAYOUT, "section string, ordinal int, label string, metric string, decimals int")
    long = S.long_metrics(seeds(spark, sf).where("attempt = 'O'"), ["run"], SEED_METRICS)
    return S.results_table(long, layout)


# Sections of a report over blocks of line items: what was trained on and what was held out.
REPORT = [
    ("TRAINED ELEMENTS", 1, "soft IoU, mean", "trained", "mean_soft_iou", 4, None), ("TRAINED ELEMENTS", 2, "soft IoU, on screen", "trained", "onscreen", 4, None),
    ("TRAINED ELEMENTS", 3, "jitter px", "trained", "jitter_px", 3, None), ("LIFESPAN", 1, "cell accuracy", "trained", "lifespan_accuracy", 4, "lifespan_cells"),
    ("POINT COUNT", 1, "exact match", "trained", "point_count_exact", 4, "point_count_exact"),
    ("HELD-OUT ELEMENTS", 1, "soft IoU, mean", "held", "mean_soft_iou", 4, None), ("HELD-OUT ELEMENTS", 2, "cell accuracy", "held", "lifespan_accuracy", 4, None)]
REPORT_SQL = "layout(section, ordinal, label, block, metric, decimals, needs) AS (VALUES " + ", ".join(
    f"('{s}', {o}, '{lb}', '{b}', '{m}', {d}, {f'{chr(39)}{n}{chr(39)}' if n else 'NULL'})" for s, o, lb, b, m, d, n in REPORT) + ")"


@query("results_report", f"""WITH b AS (SELECT l_returnflag AS run, unnest(['all', CASE WHEN l_suppkey % 4 = 0 THEN 'held' ELSE 'trained' END]) AS block, * FROM lineitem), w AS (
  SELECT run, block, avg(1 - l_discount) AS mean_soft_iou, avg(CASE WHEN l_linestatus = 'O' THEN 1 - l_discount END) AS onscreen, count(*) AS lifespan_cells,
         1 - avg(l_tax) AS lifespan_accuracy, count(*) FILTER (l_linestatus = 'O') AS frames_onscreen, count(*) FILTER (l_linestatus <> 'O') AS frames_offscreen FROM b GROUP BY ALL), l AS (
  SELECT run, block, unnest(['mean_soft_iou', 'onscreen', 'lifespan_cells', 'lifespan_accuracy', 'frames_onscreen', 'frames_offscreen']) AS metric,
         unnest([mean_soft_iou, onscreen, lifespan_cells, lifespan_accuracy, frames_onscreen, frames_offscreen]::DOUBLE[]) AS value FROM w), agg AS (
  SELECT block, metric, avg(value) AS m, max(value) - min(value) AS s FROM l WHERE value IS NOT NULL GROUP BY ALL), {REPORT_SQL}
SELECT section, ordinal, label, coalesce(CASE decimals WHEN 4 THEN printf('%.4f', m) ELSE printf('%.3f', m) END, '--') AS value,
  coalesce(CASE decimals WHEN 4 THEN printf('%.4f', s) ELSE printf('%.3f', s) END, '') AS spread
FROM layout y LEFT JOIN agg a ON a.block = y.block AND a.metric = y.metric WHERE needs IS NULL OR EXISTS (SELECT 1 FROM agg n WHERE n.block = y.block AND n.metric = y.needs)
UNION ALL SELECT 'FRAMES', 1, 'on screen / layer absent', printf('%.0f / %.0f', o.m, f.m), printf('%.1f', 100 * f.m / (o.m + f.m)) || '%'
  FROM (SELECT m FROM agg WHERE block = 'all' AND metric = 'frames_onscreen') o, (SELECT m FROM agg WHERE block = 'all' AND metric = 'frames_offscreen') f
UNION ALL SELECT 'HELD-OUT SHOTS', CAST(row_number() OVER (ORDER BY shot) AS INTEGER), shot, els, '' FROM (
  SELECT 'shot' || s_nationkey AS shot, string_agg('e' || s_suppkey, ', ' ORDER BY 'e' || s_suppkey) AS els FROM supplier WHERE s_suppkey % 4 = 0 GROUP BY 1)""")
def results_report(spark, sf):
    """A report by blocks: a lifespan section that is there, a point-count section that is not, frames and held-out shots."""
    li = load(spark, sf, "lineitem").withColumn("block", F.explode(F.expr("array('all', CASE WHEN l_suppkey % 4 = 0 THEN 'held' ELSE 'trained' END)")))
    wide = li.groupBy(F.col("l_returnflag").alias("run"), "block").agg(*[F.expr(e) for e in (
        "avg(1 - l_discount) AS mean_soft_iou", "avg(CASE WHEN l_linestatus = 'O' THEN 1 - l_discount END) AS onscreen", "count(1) AS lifespan_cells",
        "1 - avg(l_tax) AS lifespan_accuracy", "count_if(l_linestatus = 'O') AS frames_onscreen", "count_if(l_linestatus <> 'O') AS frames_offscreen")])
    long = S.long_metrics(wide, ["run", "block"], ["mean_soft_iou", "onscreen", "lifespan_cells", "lifespan_accuracy", "frames_onscreen", "frames_offscreen"])
    layout = spark.createDataFrame(REPORT, "section string, ordinal int, label string, block string, metric string, decimals int, needs string")
    held = load(spark, sf, "supplier").where("s_suppkey % 4 = 0").selectExpr("concat('shot', s_nationkey) AS shot", "concat('e', s_suppkey) AS element_id")
    return S.results_report(long, layout, held)


@query("compare_runs", f"""WITH {SEEDS}, now AS (
  SELECT metric, avg(value) AS now, max(value) - min(value) AS spread FROM long WHERE attempt = 'O' GROUP BY 1),
prev AS (SELECT metric, avg(value) AS was FROM long WHERE attempt = 'F' GROUP BY 1),
d(metric, hib) AS (VALUES ('mean_soft_iou', true), ('worst_frame_soft_iou', true), ('point_err_px', false),
                          ('key_ratio', NULL))
SELECT metric, round(now, 6) AS now, round(spread, 6) AS spread, round(was, 6) AS was, round(now - was, 6) AS delta,
       CASE WHEN now - was IS NULL THEN 'new' WHEN abs(now - was) <= spread THEN 'same' WHEN hib IS NULL THEN 'moved'
            WHEN (now - was > 0) = hib THEN 'better' ELSE 'worse' END AS verdict
FROM now LEFT JOIN prev USING (metric) JOIN d USING (metric)""")
def compare_runs(spark, sf):
    s = seeds(spark, sf)
    now, prev = (S.long_metrics(s.where(f"attempt = '{a}'"), ["run"], SEED_METRICS) for a in "OF")
    directions = spark.createDataFrame(
        [("mean_soft_iou", True), ("worst_frame_soft_iou", True), ("point_err_px", False),
         ("key_ratio", None)], "metric string, higher_is_better boolean")
    return rounded(S.compare_runs(now, prev, directions))


@query("table_header", """WITH r AS (
  SELECT o_orderkey AS run, CASE WHEN o_orderstatus <> 'P' THEN 'staging' END AS environment,
         'fp' || o_orderpriority AS dataset_fingerprint FROM orders), g AS (
  SELECT count(DISTINCT run) AS n_runs,
         string_agg(DISTINCT coalesce(environment, 'unstamped'), '/' ORDER BY coalesce(environment, 'unstamped')) AS environments,
         count(DISTINCT dataset_fingerprint) AS n_fingerprints FROM r)
SELECT n_runs, environments, n_fingerprints, n_runs || ' seeds, mean and spread' AS header,
       'environment ' || environments || ', WARNING: ' || n_fingerprints || ' different dataset fingerprints' AS note
FROM g""")
def table_header(spark, sf):
    runs = load(spark, sf, "orders").selectExpr(
        "o_orderkey AS run", "CASE WHEN o_orderstatus <> 'P' THEN 'staging' END AS environment",
        "concat('fp', o_orderpriority) AS dataset_fingerprint")
    return S.table_header(runs)


@query("score_assembly", """WITH scores AS (
  SELECT source || '__' || lang AS element_id, avg(n_chars) AS mean_soft_iou FROM documents GROUP BY ALL),
declared AS (SELECT element_id FROM scores WHERE element_id LIKE 'src1%'),
known AS (SELECT element_id FROM scores WHERE element_id NOT LIKE '%fr'),
f AS (SELECT s.*, split_part(s.element_id, '__', 1) AS shot, s.element_id IN (SELECT * FROM declared) AS w,
             s.element_id IN (SELECT * FROM known) AS k FROM scores s)
SELECT element_id, round(mean_soft_iou, 6) AS mean_soft_iou, shot, NOT w AND k AS in_train,
       NOT (w OR NOT k) AS scored_with_real_queries, shot = 'src1' AS held_shot,
       (w OR NOT k) <> w AS disagrees FROM f""")
def score_assembly(spark, sf):
    scores = load(spark, sf, "documents").groupBy(
        F.expr("concat(source, '__', lang) AS element_id")).agg(F.expr("avg(n_chars) AS mean_soft_iou"))
    ids = scores.select("element_id")
    return rounded(S.score_assembly(
        scores, ids.where("element_id LIKE 'src1%'"), ids.where("element_id NOT LIKE '%fr'"),
        spark.createDataFrame([("src1",)], "shot string"), shared=False))


@query("balanced_logloss", """WITH c AS (
  SELECT element, event_type, event_type = 'purchase' AS target, (value - 40) / 20 AS logit, 2.14::DOUBLE AS w
  FROM (SELECT *, user_id % 10 AS element FROM events) WHERE event_type <> 'error')
SELECT element, count(*) AS cells,
  round(avg(CASE WHEN target THEN w * (greatest(-logit, 0) + ln(1 + exp(-abs(logit))))
       ELSE greatest(logit, 0) + ln(1 + exp(-abs(logit))) END), 6) AS logloss,
  round(coalesce(count(*) FILTER (logit > 0 AND target)::DOUBLE / nullif(count(*) FILTER (logit > 0), 0), 0), 6) AS precision,
  round(coalesce(count(*) FILTER (logit > 0 AND target)::DOUBLE / nullif(count(*) FILTER (target), 0), 0), 6) AS recall,
  round(count(*) FILTER (logit > 0 AND NOT target)::DOUBLE / count(*), 6) AS fp_rate,
  round(count(*) FILTER (NOT logit > 0 AND target)::DOUBLE / count(*), 6) AS fn_rate
FROM c GROUP BY element""")
def balanced_logloss(spark, sf):
    ev = load(spark, sf, "events").selectExpr(
        "user_id % 10 AS element", "event_type <> 'error' AS live", "event_type = 'purchase' AS target",
        "(value - 40) / 20 AS logit")
    return rounded(S.balanced_logloss(ev, ["element"], "logit", "target", "2.14D", mask="live"))


@query("count_ce", """WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * 10) AS z FROM embeddings), s AS (
  SELECT *, list_max(z) AS mx, list_sum(list_transform(z, lambda v: exp(v - list_max(z)))) AS tot FROM e)
SELECT vec_id, label, round(ln(tot) + mx - z[label + 1], 6) AS count_ce,
       round(list_sum(list_transform(z, lambda v, i: exp(v - mx) * (i - 1))) / tot, 6) AS expected_count,
       round(abs(list_sum(list_transform(z, lambda v, i: exp(v - mx) * (i - 1))) / tot - label) / greatest(label, 1), 6)
         AS count_deviation FROM s""")
def count_ce(spark, sf):
    e = load(spark, sf, "embeddings").selectExpr(
        "vec_id", "label", "transform(embedding, x -> CAST(x AS DOUBLE) * 10) AS z")
    return rounded(S.count_diagnostics(e, "z", "label").drop("z"))


@query("log_windows", """WITH s AS (SELECT user_id % 5 AS run, event_id + 1 AS step, value AS point_px FROM events)
SELECT run, ((step - 1) // 500 + 1) * 500 AS step_end, round(avg(point_px), 6) AS point_px FROM (
  SELECT row_number() OVER (PARTITION BY run ORDER BY step) AS step, run, point_px FROM s)
GROUP BY run, step_end HAVING max(step) = step_end""")
def log_windows(spark, sf):
    from ..functions.ordered import positions
    s = load(spark, sf, "events").selectExpr("user_id % 5 AS run", "event_id", "value AS point_px")
    s = positions(s, ["run"], ["event_id"], F.floor(F.col("event_id") / 65536), "pos")
    return rounded(S.log_windows(s.selectExpr("run", "pos + 1 AS step", "point_px"), 500, ["point_px"], ["run"]))
