"""Element queries: shapes are orders, keys are their lines, elements are customer groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import elements as E
from .registry import query
from .scoring import rounded
from .tables import load

SHAPE_TYPES = ("F", "O", "P")


def keys(spark, sf):
    return load(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS shape_id", "CASE WHEN l_linestatus = 'F' THEN 'path' ELSE 'opacity' END AS track",
        "CASE l_returnflag WHEN 'A' THEN 'linear' WHEN 'N' THEN 'hold' ELSE 'catmullrom' END AS interp",
        "l_linenumber AS frame")


def shapes(spark, sf):
    s = load(spark, sf, "orders").selectExpr(
        "o_custkey % 100 AS element_id", "o_orderkey AS shape_id", "o_orderstatus AS shape_type",
        "o_orderpriority < '3' AS closed", "3 + o_orderkey % 17 AS n_points",
        "CASE WHEN o_orderstatus = 'O' THEN 3 ELSE 1 END AS n_coords",
        "CAST(o_totalprice / 100000 AS INT) AS live_frames", "o_custkey % 7 AS group_id")
    facts = E.shape_facts(keys(spark, sf))
    counts = [c for c in facts.columns if c != "shape_id"]
    return E.shape_class(s.join(facts, "shape_id", "left").na.fill(0, counts))


def nodes(spark, sf):
    return load(spark, sf, "supplier").selectExpr(
        "s_suppkey % 100 AS element_id", "s_suppkey AS node_id", "s_nationkey % 4 AS transform_keys",
        "s_nationkey % 3 AS trs_keys")


SHAPES_SQL = """facts AS (
  SELECT l_orderkey AS shape_id, count(*) FILTER (l_linestatus = 'F') AS path_keys,
         count(*) FILTER (l_linestatus = 'O') AS opacity_keys,
         count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'A') AS interp_linear,
         count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'N') AS interp_hold,
         count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'R') AS interp_catmullrom
  FROM lineitem GROUP BY 1), shapes AS (
  SELECT o_custkey % 100 AS element_id, o_orderkey AS shape_id, o_orderstatus AS shape_type,
         o_orderpriority < '3' AS closed, 3 + o_orderkey % 17 AS n_points,
         CASE WHEN o_orderstatus = 'O' THEN 3 ELSE 1 END AS n_coords,
         CAST(trunc(o_totalprice / 100000) AS INT) AS live_frames, o_custkey % 7 AS group_id,
         coalesce(path_keys, 0) AS path_keys, coalesce(opacity_keys, 0) AS opacity_keys,
         coalesce(interp_linear, 0) AS interp_linear, coalesce(interp_hold, 0) AS interp_hold,
         coalesce(interp_catmullrom, 0) AS interp_catmullrom,
         coalesce(opacity_keys, 0) > 1 AND CAST(trunc(o_totalprice / 100000) AS INT) <= 2 AS ephemeral
  FROM orders LEFT JOIN facts ON o_orderkey = shape_id), stats AS (
  SELECT element_id, count(*) AS shapes, CAST(sum(n_points) AS BIGINT) AS points,
         CAST(sum(path_keys) AS BIGINT) AS keys, count(*) FILTER (NOT closed) AS open_strokes,
         count(*) FILTER (opacity_keys > 1) AS with_lifespan, count(*) FILTER (ephemeral) AS ephemeral,
         CAST(sum(live_frames) AS BIGINT) AS live_frames,
         count(*) FILTER (shape_type = 'F') AS "type_F", count(*) FILTER (shape_type = 'O') AS "type_O",
         count(*) FILTER (shape_type = 'P') AS "type_P", CAST(sum(interp_linear) AS BIGINT) AS interp_linear,
         CAST(sum(interp_hold) AS BIGINT) AS interp_hold, CAST(sum(interp_catmullrom) AS BIGINT) AS interp_catmullrom
  FROM shapes GROUP BY 1), nodestats AS (
  SELECT s_suppkey % 100 AS element_id, count(*) AS layers,
         count(*) FILTER (s_nationkey % 4 > 0 OR s_nationkey % 3 > 0) AS tracked_layers,
         count(*) FILTER (s_nationkey % 4 > 1 OR s_nationkey % 3 > 1) AS animated_transforms
  FROM supplier GROUP BY 1), full_stats AS (
  SELECT stats.*, coalesce(layers, 0) AS layers, coalesce(tracked_layers, 0) AS tracked_layers,
         coalesce(animated_transforms, 0) AS animated_transforms FROM stats LEFT JOIN nodestats USING (element_id))"""


def stats(spark, sf):
    return E.element_stats(shapes(spark, sf), nodes(spark, sf), SHAPE_TYPES)


@query("element_stats", f"WITH {SHAPES_SQL} SELECT * FROM full_stats")
def element_stats(spark, sf):
    return stats(spark, sf)


@query("element_tags", f"""WITH {SHAPES_SQL}
SELECT element_id, shapes, round_even(open_strokes / shapes, 4) AS open_fraction,
  round_even(ephemeral / shapes, 4) AS ephemeral_fraction,
  coalesce(round_even(keys / nullif(live_frames, 0), 4), 0) AS keys_per_live_frame,
  round_even(points / shapes, 2) AS points_per_shape, tracked_layers > 0 AS tracked,
  animated_transforms > 0 AS animated_transform, shapes <= 1 AS trivial, open_strokes / shapes > 0.9 AS paint_pass,
  coalesce(keys / nullif(live_frames, 0) > 0.75, false) AS over_keyed FROM full_stats""")
def element_tags(spark, sf):
    return E.element_tags(stats(spark, sf))


@query("shape_class", f"""WITH {SHAPES_SQL}
SELECT shape_class, count(*) AS n FROM (
  SELECT (CASE WHEN ephemeral THEN 'ephemeral' ELSE 'persistent' END) || '_' ||
         (CASE WHEN closed THEN 'fill' ELSE 'stroke' END) AS shape_class FROM shapes) GROUP BY 1""")
def shape_class(spark, sf):
    return shapes(spark, sf).groupBy("shape_class").agg(F.expr("count(1) AS n"))


@query("profile_quantiles", """SELECT user_id % 10 AS element, min(value) AS min, max(value) AS max,
  round(avg(value), 6) AS mean, count(DISTINCT value) AS distinct_values,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90
FROM events GROUP BY 1""")
def profile_quantiles(spark, sf):
    from ..functions.distribution import exact_quantiles
    ev = load(spark, sf, "events").selectExpr("user_id % 10 AS element", "value")
    q = exact_quantiles(ev, ["element"], "value", {"median": 0.5, "p90": 0.9})
    b = ev.groupBy("element").agg(F.expr("min(value) AS min"), F.expr("max(value) AS max"),
                                  F.expr("avg(value) AS mean"), F.expr("count(DISTINCT value) AS distinct_values"))
    return rounded(b.join(q, "element"))


@query("style_profile", """WITH c AS (SELECT element_id, v, count(*) AS n FROM s GROUP BY ALL), m AS (
  SELECT element_id, arg_min(v, (-n, v)) AS mode, max(n) AS mode_count FROM c GROUP BY 1)
SELECT element_id, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, count(DISTINCT v) AS distinct_values,
       round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90,
       any_value(mode) AS mode, any_value(mode_count) AS mode_count
FROM s JOIN m USING (element_id) GROUP BY 1""".replace(
    "WITH c", "WITH s AS (SELECT o_custkey % 100 AS element_id, 3 + o_orderkey % 17 AS v FROM orders), c"))
def style_profile(spark, sf):
    """Points per shape: distribution and mode per element."""
    s = load(spark, sf, "orders").selectExpr("o_custkey % 100 AS element_id", "3 + o_orderkey % 17 AS v")
    return rounded(E.profile(s, ["element_id"], "v"))


@query("shape_desc", f"""WITH {SHAPES_SQL}
SELECT element_id, shape_id, round(n_points / max(n_points) OVER w, 6) AS desc_points,
       CAST(closed AS DOUBLE) AS desc_closed, round(n_coords / max(n_coords) OVER w, 6) AS desc_coords
FROM shapes WINDOW w AS (PARTITION BY element_id)""")
def shape_desc(spark, sf):
    s = load(spark, sf, "orders").selectExpr(
        "o_custkey % 100 AS element_id", "o_orderkey AS shape_id", "o_orderpriority < '3' AS closed",
        "3 + o_orderkey % 17 AS n_points", "CASE WHEN o_orderstatus = 'O' THEN 3 ELSE 1 END AS n_coords")
    return rounded(E.shape_desc(s))


@query("padded_size", f"""WITH {SHAPES_SQL}
SELECT element_id, count(*) AS n_shapes, max(path_keys) AS max_keys, max(n_points) AS max_points,
       max(n_coords) AS max_coords, CAST(sum(path_keys * n_points * n_coords * 2) AS BIGINT) AS real_floats,
       count(*) * max(path_keys) * max(n_points) * max(n_coords) * 2 AS padded_floats FROM shapes GROUP BY 1""")
def padded_size(spark, sf):
    return E.padded_size(shapes(spark, sf), None)


CANON_SQL = """cells AS (
  SELECT l_suppkey AS element_id, l_linenumber AS shape_id, l_partkey % 8 AS frame,
         max(l_discount) > 0.06 AS live FROM lineitem GROUP BY ALL), pts AS (
  SELECT l_suppkey AS element_id, l_linenumber AS shape_id, l_partkey % 8 AS frame,
         l_quantity AS x, l_tax * 100 AS y FROM lineitem), shp AS (
  SELECT DISTINCT l_suppkey AS element_id, l_linenumber AS shape_id, l_linenumber % 3 AS group_id FROM lineitem),
ref AS (SELECT element_id, arg_min(frame, (-n, frame)) AS ref FROM (
  SELECT element_id, frame, count(*) FILTER (live) AS n FROM cells GROUP BY ALL) GROUP BY 1),
pick AS (SELECT s.*, coalesce(
    (SELECT c.frame FROM cells c JOIN ref r ON c.element_id = r.element_id AND c.frame = r.ref
     WHERE c.element_id = s.element_id AND c.shape_id = s.shape_id AND c.live),
    (SELECT min(c.frame) FROM cells c WHERE c.element_id = s.element_id AND c.shape_id = s.shape_id AND c.live), 0)
    AS frame FROM shp s),
cen AS (SELECT p.element_id, p.shape_id, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy
        FROM pick p JOIN pts USING (element_id, shape_id, frame) GROUP BY 1, 2),
slots AS (SELECT element_id, shape_id, row_number() OVER (PARTITION BY element_id
    ORDER BY group_id, coalesce(cy, 0), coalesce(cx, 0), shape_id) - 1 AS slot
  FROM pick LEFT JOIN cen USING (element_id, shape_id))"""


def _canonical(spark, sf):
    li = load(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS element_id", "l_linenumber AS shape_id", "l_partkey % 8 AS frame", "l_discount",
        "l_quantity AS x", "l_tax * 100 AS y")
    cells = li.groupBy("element_id", "shape_id", "frame").agg(F.expr("max(l_discount) > 0.06 AS live"))
    shp = li.select("element_id", "shape_id").distinct().withColumn("group_id", F.expr("shape_id % 3"))
    return cells, E.canonical_order(cells, li.select("element_id", "shape_id", "frame", "x", "y"), shp)


@query("canonical_order", f"WITH {CANON_SQL} SELECT element_id, shape_id, slot FROM slots")
def canonical_order(spark, sf):
    return _canonical(spark, sf)[1].select("element_id", "shape_id", "slot")


@query("apply_order", f"""WITH {CANON_SQL}
SELECT element_id, frame, slot, live FROM cells JOIN slots USING (element_id, shape_id)""")
def apply_order(spark, sf):
    cells, order = _canonical(spark, sf)
    return E.apply_order(cells, order).select("element_id", "frame", "slot", "live")


@query("element_order", """SELECT source AS shot, doc_id AS ordinal, lang,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS layer_index FROM documents""")
def element_order(spark, sf):
    return E.element_order(load(spark, sf, "documents").selectExpr("source AS shot", "doc_id AS ordinal", "lang"))


CATALOGUE = [("src0", "tier1", None), ("src1", "tier1", None), ("src2", "tier2", None),
             ("src3", "deferred", "too large for a first run"), ("src4", "excluded", "no usable reference")]


@query("subset", """WITH cat(shot, tier, reason) AS (VALUES ('src0', 'tier1', NULL), ('src1', 'tier1', NULL),
  ('src2', 'tier2', NULL), ('src3', 'deferred', 'too large for a first run'),
  ('src4', 'excluded', 'no usable reference'))
SELECT shot, n, coalesce(tier, 'unlisted') AS tier, reason, coalesce(tier IN ('tier1', 'tier2'), false) AS selected
FROM (SELECT source AS shot, count(*) AS n FROM documents GROUP BY 1) LEFT JOIN cat USING (shot)""")
def subset(spark, sf):
    shots = load(spark, sf, "documents").groupBy(F.col("source").alias("shot")).agg(F.expr("count(1) AS n"))
    cat = spark.createDataFrame(CATALOGUE, "shot string, tier string, reason string")
    return E.subset(shots, cat, ["tier1", "tier2"])


@query("dataset_counts", """WITH e AS (
  SELECT d.doc_id, source AS shot, CASE WHEN quality = 1 THEN 'gold' ELSE 'silver' END AS grade, n_chars AS shapes,
         coalesce(toxic, 0) = 0 AS in_train FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
f AS (SELECT turn % 7 = 3 AS held FROM conversations)
SELECT count(DISTINCT shot) AS shots, count(*) AS elements, count(*) FILTER (grade = 'gold') AS gold,
  count(*) FILTER (grade <> 'gold') AS silver, CAST(sum(shapes) AS BIGINT) AS shapes,
  count(*) FILTER (in_train) AS trained_elements, (SELECT count(*) FROM f) AS frames,
  (SELECT count(*) FILTER (held) FROM f) AS frames_held FROM e""")
def dataset_counts(spark, sf):
    els = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left").selectExpr(
        "source AS shot", "CASE WHEN quality = 1 THEN 'gold' ELSE 'silver' END AS grade", "n_chars AS shapes",
        "coalesce(toxic, 0) = 0 AS in_train")
    return E.dataset_counts(els, load(spark, sf, "conversations").selectExpr("turn % 7 = 3 AS held"))
