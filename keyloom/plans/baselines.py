"""Baseline, ablation, split and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import chunk_id, positions
from ..operators import baselines as B
from ..operators import splits as S
from .coverage import ink
from .registry import query
from .scoring import rounded
from .tables import TRACK_SQL, load, track


@query("mode_baseline", """WITH s AS (SELECT o_custkey % 100 AS e, 3 + o_orderkey % 17 * (o_custkey % 3) AS v FROM orders), c AS (
  SELECT e, v, count(*) AS n FROM s GROUP BY ALL), g AS (SELECT arg_min(v, (-n, v)) AS gm FROM (
  SELECT v, sum(n) AS n FROM c GROUP BY 1)), l AS (SELECT e, arg_min(v, (-n, v)) AS lm FROM c GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(DISTINCT v) AS distinct_values, min(v) AS min, max(v) AS max, any_value(gm) AS global_mode,
  round(sum(n) FILTER (v = gm) / sum(n), 6) AS global_accuracy, round(sum(abs(v - gm) * n) / sum(n), 6) AS global_mae,
  round(sum(n) FILTER (v = lm) / sum(n), 6) AS group_accuracy, round(sum(abs(v - lm) * n) / sum(n), 6) AS group_mae
FROM c JOIN l USING (e), g""")
def mode_baseline(spark, sf):
    s = load(spark, sf, "orders").selectExpr("o_custkey % 100 AS e", "3 + o_orderkey % 17 * (o_custkey % 3) AS v")
    return rounded(B.mode_baseline(s, ["e"], "v"))


@query("histogram", "SELECT 3 + o_orderkey % 17 AS value, count(*) AS n FROM orders GROUP BY 1")
def histogram(spark, sf):
    return B.histogram(load(spark, sf, "orders").selectExpr("3 + o_orderkey % 17 AS v"), "v")


@query("always_true", """WITH c AS (SELECT user_id % 10 AS element, event_type IN ('purchase', 'view') AS live FROM events)
SELECT element, count(*) AS cells, count(*) FILTER (live) AS live_cells, round(avg(live::INT), 6) AS accuracy,
  round(avg(live::INT), 6) AS precision, 1.0::DOUBLE AS recall,
  round(2 * avg(live::INT) / greatest(1e-9, avg(live::INT) + 1), 6) AS f1 FROM c GROUP BY 1""")
def always_true(spark, sf):
    c = load(spark, sf, "events").selectExpr("user_id % 10 AS element", "event_type IN ('purchase', 'view') AS live")
    return rounded(B.always_true_baseline(c, ["element"], "live"))


PLAIN = ("exact", "always_alive", "coverage_alive", "dilate", "erode")
NOISE = (0.01, 0.03, 0.10)


def ablation_sql(noise=()):
    """Cells, pixels and soft IoU per variant (``sc``); noise flips the first cells in a seeded order."""
    flips = {}
    for rate in noise:
        hit = f"rk < round_even({rate}::DOUBLE * n, 0)"
        flips |= {f"fp_{round(rate * 100)}pct": f"live OR {hit}", f"fn_{round(rate * 100)}pct": f"live AND NOT ({hit})"}
    names = [*PLAIN, *flips]
    ranked = """, count(*) OVER (PARTITION BY element_id) AS n, row_number() OVER (PARTITION BY element_id, live ORDER BY
         md5(concat_ws(':', '7', element_id, shape_id, frame)), element_id, shape_id, frame) - 1 AS rk""" if noise else ""
    made = "".join(f", {e} AS {v}" for v, e in flips.items())
    drawn = ", ".join(f"coalesce(max(cov) FILTER ({v}), 0) AS {v}" for v in names)
    scored = ", ".join(f"coalesce(sum(least({v}, exact)) / nullif(sum(greatest({v}, exact)), 0), 1) AS {v}_" for v in names)
    return f"""cells AS (
  SELECT l_suppkey % 20 AS element_id, l_linenumber AS shape_id, l_orderkey % 16 AS frame, max(l_tax) > 0.06 AS live
  FROM lineitem GROUP BY ALL), px AS (
  SELECT l_suppkey % 20 AS element_id, l_linenumber AS shape_id, l_orderkey % 16 AS frame, l_partkey % 16 AS y, (l_partkey // 16) % 32 AS x,
         max(l_discount) * 10 AS cov FROM lineitem GROUP BY ALL), v0 AS (
  SELECT *, live AS exact, true AS always_alive, bool_or(live) OVER (PARTITION BY element_id, frame) AS coverage_alive,
         live OR lag(live, 1, false) OVER w OR lead(live, 1, false) OVER w AS dilate,
         live AND lag(live, 1, true) OVER w AND lead(live, 1, true) OVER w AS erode{ranked}
  FROM cells WINDOW w AS (PARTITION BY element_id, shape_id ORDER BY frame)), v AS (SELECT *{made} FROM v0), d AS (
  SELECT element_id, frame, y, x, {drawn} FROM px JOIN v USING (element_id, shape_id, frame) GROUP BY ALL), wide AS (
  SELECT element_id, frame, max(exact) > 0 AS on_screen, {scored} FROM d GROUP BY 1, 2), sc AS (
  SELECT element_id, frame, on_screen, unnest({names}) AS variant, unnest([{", ".join(f"{v}_" for v in names)}]) AS soft_iou FROM wide)"""


CELLS_SQL = ablation_sql()


def ablation_input(spark, sf):
    key = [F.expr(e) for e in ("l_suppkey % 20 AS element_id", "l_linenumber AS shape_id", "l_orderkey % 16 AS frame")]
    li = load(spark, sf, "lineitem")
    cells = li.groupBy(*key).agg(F.expr("max(l_tax) > 0.06 AS live"))
    px = li.groupBy(*key, F.expr("l_partkey % 16 AS y"), F.expr("(l_partkey div 16) % 32 AS x")).agg(
        F.expr("max(l_discount) * 10 AS cov"))
    return cells, px


@query("ablate", f"WITH {CELLS_SQL} SELECT element_id, frame, on_screen, variant, round(soft_iou, 6) AS soft_iou FROM sc")
def ablate(spark, sf):
    cells, px = ablation_input(spark, sf)
    wide, names = B.lifespan_variants(cells)
    return rounded(B.ablate(wide, px, names))


TOTALS_SQL = """, el AS (
  SELECT variant, element_id, count(*) AS frames, avg(soft_iou) AS mean, coalesce(avg(soft_iou) FILTER (on_screen), avg(soft_iou)) AS mean_on,
         count(*) FILTER (soft_iou < 0.9) AS below FROM sc GROUP BY ALL), t AS (
  SELECT variant, sum(mean * frames) / sum(frames) AS mean, sum(mean_on * frames) / sum(frames) AS mean_onscreen,
         arg_min(element_id, (mean_on, element_id)) AS worst_element, min(mean_on) AS worst_element_onscreen,
         CAST(sum(below) AS BIGINT) AS frames_below_090 FROM el GROUP BY 1)
SELECT variant, round(mean, 6) AS mean, round(mean_onscreen, 6) AS mean_onscreen, worst_element,
  round(worst_element_onscreen, 6) AS worst_element_onscreen, frames_below_090,
  round((SELECT mean_onscreen FROM t WHERE variant = 'exact') - mean_onscreen, 6) AS cost_vs_exact_onscreen FROM t"""


@query("ablation_totals", f"WITH {CELLS_SQL}{TOTALS_SQL}")
def ablation_totals(spark, sf):
    cells, px = ablation_input(spark, sf)
    wide, names = B.lifespan_variants(cells)
    return rounded(B.ablation_totals(B.ablate(wide, px, names)))


@query("ablate_noise", f"WITH {ablation_sql(NOISE)}{TOTALS_SQL}")
def ablate_noise(spark, sf):
    """Seeded one-direction noise at 1, 3 and 10 %."""
    cells, px = ablation_input(spark, sf)
    wide, names = B.lifespan_variants(cells, NOISE, 7)
    return rounded(B.ablation_totals(B.ablate(wide, px, names)))


@query("trace_totals", """WITH r AS (
  SELECT l_returnflag AS variant, l_suppkey AS element_id, l_suppkey % 4 <> 0 AS in_train, count(*) AS frames,
         1 - avg(l_discount) AS mean_onscreen, avg(l_linenumber) AS shapes_used FROM lineitem GROUP BY ALL)
SELECT variant, in_train, round(sum(mean_onscreen * frames) / sum(frames), 6) AS mean_onscreen, round(min(mean_onscreen), 6) AS worst_onscreen,
  arg_min(element_id, (mean_onscreen, element_id)) AS worst_element, round(sum(shapes_used * frames) / sum(frames), 6) AS shapes_used,
  count(*) AS elements FROM r GROUP BY ALL""")
def trace_totals(spark, sf):
    r = load(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("variant"), F.col("l_suppkey").alias("element_id"), F.expr("l_suppkey % 4 <> 0 AS in_train")).agg(
        F.expr("count(1) AS frames"), F.expr("1 - avg(l_discount) AS mean_onscreen"), F.expr("avg(l_linenumber) AS shapes_used"))
    return rounded(B.trace_totals(r))


# ---- splits ----------------------------------------------------------------------------------

SPLIT_SQL = f"""{TRACK_SQL}, sp AS (
  SELECT user_id, frame, frame % 7 = 3 AND frame > 0 AND frame < t - 1 AND t > 2 AS held
  FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS t FROM track))"""


@query("frame_split", f"WITH {SPLIT_SQL} SELECT user_id, frame, held FROM sp")
def frame_split(spark, sf):
    return S.frame_split(track(spark, sf).select("user_id", "frame"), ["user_id"])


@query("effective_split", f"""WITH {SPLIT_SQL}, rec AS (SELECT user_id, frame, event_type = 'error' AS held FROM track WHERE user_id % 4 = 0)
SELECT sp.user_id, sp.frame, coalesce(rec.held, sp.held) AS held, CASE WHEN rec.held IS NULL THEN 'rule' ELSE 'recorded' END AS source
FROM sp LEFT JOIN rec ON sp.user_id = rec.user_id AND sp.frame = rec.frame""")
def effective_split(spark, sf):
    t = track(spark, sf, "event_type")
    rec = t.where("user_id % 4 = 0").selectExpr("user_id", "frame", "event_type = 'error' AS held")
    return S.effective_split(t.select("user_id", "frame"), rec, ["user_id"])


@query("build_splits", """WITH e AS (SELECT source || '__' || lang AS element_id, source AS shot, count(*) AS n FROM documents GROUP BY ALL), h AS (
  SELECT *, shot IN ('src1', 'src2') AS hs, element_id IN ('src1__en', 'src5__fr') AS he,
         (SELECT count(*) FROM range(n) r(p) WHERE n > 2 AND p % 7 = 3 AND p > 0 AND p < n - 1) AS held FROM e)
SELECT element_id, shot, n AS n_frames, NOT hs AND NOT he AS in_train,
  concat_ws('|', CASE WHEN hs THEN 'shot ' || shot END, CASE WHEN he THEN 'element' END) AS held_because,
  n - held AS frames_train, held AS frames_held FROM h""")
def build_splits(spark, sf):
    e = load(spark, sf, "documents").groupBy(
        F.expr("concat(source, '__', lang) AS element_id"), F.col("source").alias("shot")).agg(F.expr("count(1) AS n_frames"))
    out = S.build_splits(e, ["src1", "src2"], ["src1__en", "src5__fr"])
    return out.withColumn("held_because", F.array_join("held_because", "|"))


@query("positive_rate", """WITH c AS (SELECT user_id % 10 AS element, event_type = 'purchase' AS k, event_type <> 'error' AS live FROM events)
SELECT element, count(*) FILTER (live) AS base_cells, count(*) FILTER (live AND k) AS hits,
  round(count(*) FILTER (live AND k)::DOUBLE / count(*) FILTER (live), 6) AS rate FROM c GROUP BY ROLLUP (element)""")
def positive_rate(spark, sf):
    c = load(spark, sf, "events").selectExpr("user_id % 10 AS element", "event_type = 'purchase' AS k", "event_type <> 'error' AS live")
    return rounded(S.positive_rate(c, ["element"], "k", "live"))


@query("slot_rate", f"""WITH {TRACK_SQL}, c AS (SELECT user_id % 10 AS element, frame, count(*) FILTER (event_type <> 'error') AS n FROM track GROUP BY ALL)
SELECT element, CAST(sum(n) AS BIGINT) AS hits, count(*) * 256 AS base_cells, round(sum(n) / (count(*) * 256), 6) AS rate FROM c GROUP BY 1""")
def slot_rate(spark, sf):
    c = track(spark, sf, "event_type").withColumn("element", F.expr("user_id % 10"))
    return rounded(S.slot_rate(c, ["element"], "event_type <> 'error'", 256))


@query("positive_weight", """WITH r AS (SELECT label, avg(CASE WHEN abs(embedding[1]) > 0.25 THEN 1 ELSE 0 END) AS rate FROM embeddings GROUP BY 1)
SELECT label, round(rate, 6) AS rate, round(CASE WHEN rate > 0 AND rate < 1 THEN (1 - rate) / rate ELSE 1 END, 6) AS pos_weight FROM r""")
def positive_weight(spark, sf):
    r = load(spark, sf, "embeddings").groupBy("label").agg(F.expr("avg(CASE WHEN abs(embedding[0]) > 0.25 THEN 1 ELSE 0 END) AS rate"))
    return rounded(S.positive_weight(r))


ELEMENTS_SQL = """el AS (SELECT l_suppkey AS element_id, count(DISTINCT l_orderkey) AS n_frames, count(DISTINCT l_linenumber) AS n_shapes,
  count(DISTINCT l_linenumber % 3) AS n_groups FROM lineitem GROUP BY 1)"""


def elements(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("element_id")).agg(
        F.expr("count(DISTINCT l_orderkey) AS n_frames"), F.expr("count(DISTINCT l_linenumber) AS n_shapes"),
        F.expr("count(DISTINCT l_linenumber % 3) AS n_groups"))


@query("element_weight", f"""WITH {ELEMENTS_SQL}
SELECT element_id, 'sqrt' AS mode, round(sqrt(n_frames * n_shapes) / sum(sqrt(n_frames * n_shapes)) OVER (), 8) AS weight FROM el
UNION ALL SELECT element_id, 'frames', round(n_frames::DOUBLE / sum(n_frames) OVER (), 8) FROM el""")
def element_weight(spark, sf):
    el = elements(spark, sf)
    rows = [S.element_weight(el, m).select("element_id", F.lit(m).alias("mode"), "weight") for m in ("sqrt", "frames")]
    return rounded(rows[0].unionByName(rows[1]), 8)


@query("block_offsets", f"""WITH {ELEMENTS_SQL}
SELECT element_id, n_frames, n_shapes, n_groups,
  CAST(coalesce(sum(n_shapes) OVER w, 0) AS BIGINT) AS shape_base, CAST(coalesce(sum(n_groups) OVER w, 0) AS BIGINT) AS group_base
FROM el WINDOW w AS (ORDER BY element_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def block_offsets(spark, sf):
    return S.block_offsets(elements(spark, sf))


NAMED_SQL = """named AS (SELECT source || '__' || lang AS element_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS frame,
  count(*) OVER (PARTITION BY source, lang) AS t, doc_id, n_chars FROM documents), pool AS (
  SELECT element_id, frame, row_number() OVER (PARTITION BY element_id ORDER BY frame) - 1 AS pos FROM named
  WHERE NOT (t > 2 AND frame % 7 = 3 AND frame > 0 AND frame < t - 1)), el AS (
  SELECT element_id, count(*) AS n_frames, length(element_id) % 7 + 1 AS n_shapes, length(element_id) % 3 + 1 AS n_groups FROM pool GROUP BY 1)"""


def named_frames(spark, sf):
    """Elements with names for ids: one per source and language, with its documents as frames."""
    d = load(spark, sf, "documents").selectExpr("concat(source, '__', lang) AS element_id", "doc_id", "n_chars")
    return positions(d, ["element_id"], ["doc_id"], chunk_id("doc_id"), "frame")


def named_pool(spark, sf):
    """The training pool of the named elements, and their sizes."""
    pool = S.frame_split(named_frames(spark, sf), ["element_id"]).where("NOT held").select("element_id", "frame")
    pool = positions(pool, ["element_id"], ["frame"], chunk_id("frame"), "pos")
    return pool, pool.groupBy("element_id").agg(
        F.expr("count(1) AS n_frames"), F.expr("CAST(length(element_id) % 7 + 1 AS BIGINT) AS n_shapes"),
        F.expr("CAST(length(element_id) % 3 + 1 AS BIGINT) AS n_groups"))


@query("block_offsets_named", f"""WITH {NAMED_SQL}
SELECT element_id, n_frames, n_shapes, n_groups, CAST(coalesce(sum(n_shapes) OVER w, 0) AS BIGINT) AS shape_base,
  CAST(coalesce(sum(n_groups) OVER w, 0) AS BIGINT) AS group_base
FROM el WINDOW w AS (ORDER BY element_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def block_offsets_named(spark, sf):
    return S.block_offsets(named_pool(spark, sf)[1])


def schedule_sql(mode: str, steps: str) -> str:
    """Weighted picks by hashed ticks, then Floyd's draws step by step; ``steps`` selects the column step."""
    draw = "CAST('0x' || substr(md5('1:{0}:' || step{1}), 1, 13) AS BIGINT)"
    paired, run = ("n > 2 AND a_n > 0" if mode == "pairs" else "false"), ("n > 2" if mode == "runs" else "false")
    return f"""{NAMED_SQL}, w AS (
  SELECT *, CAST(round(sqrt(n_frames * n_shapes) / sum(sqrt(n_frames * n_shapes)) OVER () * 4503599627370496) AS BIGINT) AS ticks FROM el), lanes AS (
  SELECT element_id, n_frames AS n, CAST(sum(ticks) OVER (ORDER BY element_id) - ticks AS BIGINT) AS lo FROM w WHERE ticks > 0), anchors AS (
  SELECT element_id, frame, row_number() OVER (PARTITION BY element_id ORDER BY pos) - 1 AS apos
  FROM (SELECT *, lead(frame) OVER (PARTITION BY element_id ORDER BY pos) AS nxt FROM pool) WHERE nxt = frame + 1), picks AS (
  SELECT step, CAST('0x' || substr(md5('1:' || step), 1, 13) AS BIGINT) AS tick FROM ({steps})), s AS (
  SELECT step, element_id, {paired} AS paired, {run} AS run, CASE WHEN {paired} THEN a_n ELSE n END AS m,
         CASE WHEN {paired} THEN least(3, a_n) ELSE least(6, n) END AS k
  FROM (SELECT step, element_id, n, coalesce(a_n, 0) AS a_n FROM picks ASOF JOIN lanes ON picks.tick >= lanes.lo
        LEFT JOIN (SELECT element_id, count(*) AS a_n FROM anchors GROUP BY 1) USING (element_id))), fl AS (
  SELECT *, m - k AS j, CAST([] AS BIGINT[]) AS acc FROM s WHERE NOT run
  UNION ALL SELECT step, element_id, paired, run, m, k, j + 1, list_append(acc, CASE WHEN list_contains(acc, h) THEN j ELSE h END)
  FROM (SELECT *, {draw.format("draw", " || ':' || j")} % (j + 1) AS h FROM fl WHERE j < m)), drawn AS (
  SELECT step, element_id, paired, unnest(acc) AS pos FROM fl WHERE j = m
  UNION ALL SELECT step, element_id, paired, {draw.format("start", "")} % (m - k + 1) + i FROM s, range(6) r(i) WHERE run AND i < k), schedule AS (
  SELECT step, element_id, frame FROM drawn JOIN pool USING (element_id, pos) WHERE NOT paired
  UNION ALL SELECT step, d.element_id, frame + o FROM drawn d JOIN anchors a ON a.element_id = d.element_id AND apos = pos, range(2) t(o) WHERE paired)"""


def _named_schedule(spark, sf, mode, steps):
    pool, el = named_pool(spark, sf)
    return S.batch_schedule(steps, S.element_weight(el, "sqrt"), pool, 6, mode, 1), el


for _mode in S.SAMPLING_MODES:
    query(f"batch_schedule_{_mode}", f"WITH RECURSIVE {schedule_sql(_mode, 'SELECT event_id + 1 AS step FROM events')} SELECT step, element_id, frame FROM schedule")(
        lambda spark, sf, _m=_mode: _named_schedule(spark, sf, _m, load(spark, sf, "events").selectExpr("event_id + 1 AS step"))[0])


@query("training_targets", f"""WITH RECURSIVE {schedule_sql("pairs", "SELECT page_id + 1 AS step FROM pages")}, based AS (
  SELECT *, coalesce(sum(n_shapes) OVER (ORDER BY element_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shape_base FROM el), slots AS (
  SELECT s.*, n_shapes, shape_base, slot, doc_id, n_chars, slot % 3 + 2 AS pc
  FROM schedule s JOIN based USING (element_id) JOIN named n USING (element_id, frame), range(8) r(slot))
SELECT step, element_id, frame, slot, slot AS query, slot < n_shapes AS exists, slot < n_shapes AND (doc_id + slot) % 3 <> 0 AS live,
  slot < n_shapes AND frame % n_shapes = slot AS is_key, CASE WHEN slot < n_shapes THEN pc END AS point_count,
  CASE WHEN slot < n_shapes THEN pc || '/4,' || slot END AS descriptor,
  CASE WHEN slot < n_shapes THEN array_to_string(list_transform(range(4), lambda i: CASE WHEN i < pc THEN (n_chars + i) || ',' || (frame * 10 + slot) ELSE '0,0' END), ',') END AS outline,
  CASE WHEN slot < n_shapes THEN array_to_string(list_transform(range(4), lambda i: CASE WHEN i < pc THEN 'true' ELSE 'false' END), ',') END AS point_mask
FROM slots""")
def training_targets(spark, sf):
    """Points, masks, descriptors and queries of every scheduled frame, padded to a bank of eight slots and four points."""
    sched, el = _named_schedule(spark, sf, "pairs", load(spark, sf, "pages").selectExpr("page_id + 1 AS step"))
    slots = named_frames(spark, sf).join(el.select("element_id", "n_shapes"), "element_id").select(
        "*", F.explode(F.expr("sequence(0, CAST(n_shapes AS INT) - 1)")).alias("slot"))
    cells = slots.selectExpr("element_id", "frame", "slot", "(doc_id + slot) % 3 <> 0 AS live", "frame % n_shapes = slot AS is_key")
    points = slots.select("element_id", "frame", "slot", "n_chars", F.explode(F.expr("sequence(0, slot % 3 + 1)")).alias("point_idx")).selectExpr(
        "element_id", "frame", "slot", "point_idx", "CAST(n_chars + point_idx AS DOUBLE) AS x", "CAST(frame * 10 + slot AS DOUBLE) AS y")
    shapes = el.select("element_id", F.explode(F.expr("sequence(0, CAST(n_shapes AS INT) - 1)")).alias("slot")).selectExpr(
        "element_id", "slot", "slot % 3 + 2 AS point_count", "array((slot % 3 + 2) / 4D, CAST(slot AS DOUBLE)) AS descriptor")
    rows = S.training_targets(sched, cells, points, shapes, S.block_offsets(el), n_slots=8, width=4)
    whole = "array_join(transform({0}, v -> CAST(CAST(v AS BIGINT) AS STRING)), ',')"
    return rows.selectExpr(
        "step", "element_id", "frame", "slot", "query", "exists", "live", "is_key", "point_count",
        "concat(CAST(descriptor[0] * 4 AS INT), '/4,', CAST(descriptor[1] AS INT)) AS descriptor",
        f"{whole.format('outline')} AS outline", "array_join(transform(point_mask, v -> CAST(v AS STRING)), ',') AS point_mask")


@query("training_groups", f"""WITH RECURSIVE {schedule_sql("random", "SELECT page_id + 1 AS step FROM pages")}, based AS (
  SELECT *, coalesce(sum(n_groups) OVER (ORDER BY element_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS group_base FROM el)
SELECT step, element_id, frame, g AS "group", CAST(group_base + g AS BIGINT) AS query, n_chars AS moved, (doc_id + g) % 2 = 0 AS live
FROM schedule JOIN based USING (element_id) JOIN named n USING (element_id, frame), range(3) r(g) WHERE g < n_groups""")
def training_groups(spark, sf):
    """Transforms of the groups of every scheduled frame, with their queries in the running table of groups."""
    sched, el = _named_schedule(spark, sf, "random", load(spark, sf, "pages").selectExpr("page_id + 1 AS step"))
    groups = named_frames(spark, sf).join(el.select("element_id", "n_groups"), "element_id").select(
        "*", F.explode(F.expr("sequence(0, CAST(n_groups AS INT) - 1)")).alias("group")).selectExpr(
        "element_id", "frame", "group", "array(1D, 0D, CAST(n_chars AS DOUBLE), 0D, 1D, 0D) AS transform", "(doc_id + group) % 2 = 0 AS live")
    return S.group_targets(sched, groups, S.block_offsets(el)).selectExpr(
        "step", "element_id", "frame", "group", "query", "CAST(transform[2] AS BIGINT) AS moved", "live")


@query("training_rows", f"""WITH RECURSIVE {schedule_sql("pairs", "SELECT page_id + 1 AS step FROM pages")}
SELECT step, element_id, frame, slot, slot < n_shapes AND (doc_id + slot) % 3 <> 0 AS live, slot < n_shapes AND frame % n_shapes = slot AS is_key, slot < n_shapes AS exists
FROM schedule JOIN el USING (element_id) JOIN named n USING (element_id, frame), range(8) r(slot)""")
def training_rows(spark, sf):
    """Scheduled frames with their real shapes, padded with non-existent slots to the bank size."""
    sched, el = _named_schedule(spark, sf, "pairs", load(spark, sf, "pages").selectExpr("page_id + 1 AS step"))
    cells = named_frames(spark, sf).join(el.select("element_id", "n_shapes"), "element_id").select(
        "*", F.explode(F.expr("sequence(0, CAST(n_shapes AS INT) - 1)")).alias("slot")).selectExpr(
        "element_id", "frame", "slot", "(doc_id + slot) % 3 <> 0 AS live", "frame % n_shapes = slot AS is_key")
    return S.training_rows(sched, cells, el, 8)
