"""Geometry queries: each vector is 32 planar points, its head a matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import chunk_id, positions
from ..operators import geometry as G
from .registry import query
from .scoring import rounded
from .tables import HALVES_SQL, halves, POINTS_SQL, load, points

# Matrix of a vector: identity plus its first entries, rows and columns 2 left alone.
MAT_SQL = ("[1 + e[1], e[2], 0, e[3] / 10, e[4], 1 + e[5], 0, e[6] / 10, 0, 0, 1, 0, e[7], e[8], 0, 1 + e[9]]")
MATS_SQL = f"""mats AS (SELECT vec_id, label, {MAT_SQL} AS m FROM (
  SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings))"""
CROP = dict(width=2880, height=1978, x0=812.0, y0=433.0, scale=0.788, out_px=256)
CROP_COLS = [f"{v}{'D' if isinstance(v, float) else ''} AS {k}" for k, v in CROP.items()]


def mats(spark, sf):
    e = load(spark, sf, "embeddings").selectExpr(
        "vec_id", "label", "transform(embedding, v -> CAST(v AS DOUBLE)) AS e")
    cells = ("1 + e[0], e[1], 0D, e[2] / 10, e[3], 1 + e[4], 0D, e[5] / 10, 0D, 0D, 1D, 0D, e[6], e[7], 0D, 1 + e[8]")
    return e.selectExpr("vec_id", "label", f"array({cells}) AS matrix")


def cropped(spark, sf):
    p = points(spark, sf).join(mats(spark, sf).drop("label"), "vec_id")
    return G.local_to_crop(p.selectExpr("*", *CROP_COLS))


L2C_SQL = f"""{POINTS_SQL}, {MATS_SQL}, c AS (
  SELECT vec_id, point_idx, (((x*m[1] + y*m[5] + m[13]) / w) * 1978 + 1440 - 812) * 0.788::DOUBLE / 256 AS cx,
         (((x*m[2] + y*m[6] + m[14]) / w) * 1978 + 989 - 433) * 0.788::DOUBLE / 256 AS cy
  FROM (SELECT *, x*m[4] + y*m[8] + m[16] AS w FROM points JOIN mats USING (vec_id)))"""


@query("local_to_crop", f"WITH {L2C_SQL} SELECT vec_id, point_idx, round(cx, 6) AS cx, round(cy, 6) AS cy FROM c")
def local_to_crop(spark, sf):
    return rounded(cropped(spark, sf).select("vec_id", "point_idx", "cx", "cy"))


@query("crop_to_local", f"WITH {POINTS_SQL} SELECT vec_id, point_idx, round(x, 6) AS lx, round(y, 6) AS ly FROM points")
def crop_to_local(spark, sf):
    """The round trip gives the local points back."""
    return rounded(G.crop_to_local(cropped(spark, sf)).select("vec_id", "point_idx", "lx", "ly"))


@query("matmul", f"""WITH {MATS_SQL}, c AS (
  SELECT vec_id, m, [s, 0, 0, 0, 0, s, 0, 0, 0, 0, 1, 0, (1440 - 812) * 0.788::DOUBLE / 256,
                     (989 - 433) * 0.788::DOUBLE / 256, 0, 1] AS c
  FROM mats, (SELECT 1978 * 0.788::DOUBLE / 256 AS s))
SELECT vec_id, CAST(i AS INTEGER) AS cell, round(m[(i//4)*4+1]*c[i%4+1] + m[(i//4)*4+2]*c[i%4+5]
       + m[(i//4)*4+3]*c[i%4+9] + m[(i//4)*4+4]*c[i%4+13], 6) AS v FROM c, range(16) r(i)""")
def matmul(spark, sf):
    m = G.crop_matrix(mats(spark, sf).selectExpr("*", *CROP_COLS))
    out = G.matmul(m, "matrix", "crop_matrix", "p")
    return rounded(out.select("vec_id", F.posexplode("p").alias("cell", "v")))


@query("trs_matrix", """WITH n AS (
  SELECT c_custkey, c_custkey % 5 / 10 AS ax, c_custkey % 3 / 10 AS ay, c_acctbal / 10000 AS px, 0.0::DOUBLE AS py,
         1 + c_custkey % 4 / 10 AS sx, 1 + c_custkey % 7 / 10 AS sy, radians(c_custkey % 360) AS r FROM customer)
SELECT c_custkey, round(sx * cos(r), 6) AS m00, round(-sy * sin(r), 6) AS m10,
       round(-ax * sx * cos(r) + ay * sy * sin(r) + ax + px, 6) AS tx,
       round(-ax * sx * sin(r) - ay * sy * cos(r) + ay + py, 6) AS ty FROM n""")
def trs_matrix(spark, sf):
    n = load(spark, sf, "customer").selectExpr(
        "c_custkey", "c_custkey % 5 / 10 AS ax", "c_custkey % 3 / 10 AS ay", "c_acctbal / 10000 AS px", "0D AS py",
        "1 + c_custkey % 4 / 10 AS sx", "1 + c_custkey % 7 / 10 AS sy", "CAST(c_custkey % 360 AS DOUBLE) AS rot")
    return rounded(G.trs_matrix(n).selectExpr("c_custkey", "trs[0] AS m00", "trs[4] AS m10", "trs[12] AS tx", "trs[13] AS ty"))


@query("compose", """WITH chain AS (
  SELECT c_custkey, 1 + n_regionkey / 10 AS rs, n_regionkey / 5 AS rt, 1 + n_nationkey / 50 AS ns, n_nationkey / 9 AS nt,
         1 + c_custkey % 7 / 10 AS cs, c_acctbal / 1000 AS ct
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, round(cs * ns * rs, 6) AS m00, round((ct * ns + nt) * rs + rt, 6) AS tx FROM chain""")
def compose(spark, sf):
    """Customer under nation under region: three scale-and-shift layers, multiplied leaf first."""
    cust = load(spark, sf, "customer").join(
        load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    layers = "array(" + ", ".join(f"named_struct('depth', {d}, 's', {s}, 't', {t})" for d, s, t in (
        (0, "1 + n_regionkey / 10", "n_regionkey / 5"), (1, "1 + n_nationkey / 50", "n_nationkey / 9"),
        (2, "1 + c_custkey % 7 / 10", "c_acctbal / 1000"))) + ")"
    chain = cust.select("c_custkey", F.explode(F.expr(layers)).alias("l")).selectExpr(
        "c_custkey", "l.depth AS depth",
        "array(l.s, 0D, 0D, 0D, 0D, l.s, 0D, 0D, 0D, 0D, 1D, 0D, l.t, 0D, 0D, 1D) AS matrix")
    return rounded(G.compose(chain, ["c_custkey"]).selectExpr("c_custkey", "matrix[0] AS m00", "matrix[12] AS tx"))


@query("group_tracks", """WITH t AS (
  SELECT l_suppkey AS element_id, l_orderkey % 9 AS shape_id, l_linenumber AS frame, max(l_tax > 0.07) AS v
  FROM lineitem GROUP BY ALL), s AS (
  SELECT element_id, shape_id, string_agg(frame || ':' || v, ',' ORDER BY frame) AS sig FROM t GROUP BY ALL), f AS (
  SELECT element_id, sig, min(shape_id) AS first FROM s GROUP BY ALL), g AS (
  SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY first) - 1 AS group_id FROM f)
SELECT element_id, shape_id, group_id FROM s JOIN g USING (element_id, sig)""")
def group_tracks(spark, sf):
    t = load(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("element_id"), F.expr("l_orderkey % 9 AS shape_id"),
        F.col("l_linenumber").alias("frame")).agg(F.expr("max(l_tax > 0.07) AS v"))
    return G.group_tracks(t, ["element_id"], value="v")


PROJ_SQL = """proj AS (SELECT vec_id, label, [m[1]/m[16], m[2]/m[16], m[4]/m[16], m[5]/m[16], m[6]/m[16], m[8]/m[16],
  m[13]/m[16], m[14]/m[16]] AS p FROM mats)"""


@query("proj_encode", f"""WITH {MATS_SQL}, {PROJ_SQL}
SELECT vec_id, CAST(i AS INTEGER) AS entry, round(p[i+1], 6) AS v FROM proj, range(8) r(i)""")
def proj_encode(spark, sf):
    return rounded(G.proj_encode(mats(spark, sf)).select("vec_id", F.posexplode("proj").alias("entry", "v")))


@query("proj_affine_loss", f"""WITH {MATS_SQL}
SELECT vec_id, round(abs(m[4] / m[16]) + abs(m[8] / m[16]), 6) AS perspective_dropped,
       round(m[1] / m[16], 6) AS proj_m00, round(m[1], 6) AS affine_m00 FROM mats""")
def proj_affine_loss(spark, sf):
    """What the six-number form drops against the eight-number one."""
    m = G.proj_decode(G.proj_encode(mats(spark, sf)), name="exact")
    m = G.affine_decode(G.affine_encode(m), name="lossy")
    return rounded(m.selectExpr("vec_id", "abs(exact[3] - lossy[3]) + abs(exact[7] - lossy[7]) AS perspective_dropped",
                                "exact[0] AS proj_m00", "lossy[0] AS affine_m00"))


PROBES_SQL = """box AS (SELECT label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points
  WHERE point_idx % 5 <> 0 GROUP BY label), probes AS (
  SELECT label, CAST(k AS INTEGER) AS probe, [x0, x1, x1, x0, (x0 + x1) / 2][k + 1] AS px, [y0, y0, y1, y1, (y0 + y1) / 2][k + 1] AS py
  FROM box, range(5) r(k))"""


@query("group_probes", f"""WITH {POINTS_SQL}, {PROBES_SQL}
SELECT label, probe, round(px, 6) AS px, round(py, 6) AS py FROM probes""")
def group_probes(spark, sf):
    return rounded(G.group_probes(points(spark, sf), ["label"], "point_idx % 5 <> 0"))


def _applied(a):
    return (f"((px*{a}[1] + py*{a}[4] + {a}[7]) / (px*{a}[3] + py*{a}[6] + 1))",
            f"((px*{a}[2] + py*{a}[5] + {a}[8]) / (px*{a}[3] + py*{a}[6] + 1))")


_P, _T = _applied("p"), _applied("q")
TRUTH_LIST = "[1.0::DOUBLE, 0, 0, 0, 1, 0, 0, 0]"


@query("probe_error", f"""WITH {POINTS_SQL}, {MATS_SQL}, {PROJ_SQL}, {PROBES_SQL}
SELECT label, round(sum(abs({_P[0]} - {_T[0]}) + abs({_P[1]} - {_T[1]})) / (2 * count(*)) * 256, 6) AS probe_error
FROM (SELECT *, {TRUTH_LIST} AS q FROM proj) JOIN probes USING (label) WHERE vec_id % 3 <> 0 GROUP BY label""")
def probe_error(spark, sf):
    """Predicted map against the identity, over groups that are on screen."""
    probes = G.group_probes(points(spark, sf), ["label"], "point_idx % 5 <> 0")
    m = G.proj_encode(mats(spark, sf), name="pred").selectExpr(
        "vec_id", "label", "pred", "array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D) AS truth", "vec_id % 3 <> 0 AS live")
    return rounded(G.probe_error(m.join(probes, "label"), ["label"], 256.0, "live"))


def control(spark, sf):
    """Control polygons: each vector's points as two outlines of 4 to 32 points, the first closed."""
    return halves(spark, sf).selectExpr("vec_id", "label", "idx", "x", "y", "vec_id % 2 = 0 AS closed", "n")


CURVE_SQL = f"""{HALVES_SQL}, ctl AS (SELECT *, vec_id % 2 = 0 AS closed FROM halves), segs AS (
  SELECT DISTINCT vec_id, label, closed, n, unnest(range(CASE WHEN closed THEN n ELSE n + 1 END)) AS seg FROM ctl), smp AS (
  SELECT *, unnest(range(CASE WHEN NOT closed AND seg = n THEN 5 ELSE 4 END)) AS k FROM segs), wts AS (
  SELECT vec_id, label, seg, k, j, CASE WHEN closed THEN (seg + j - 1 + n) % n ELSE least(greatest(seg + j - 2, 0), n - 1) END AS idx,
         CASE j WHEN 0 THEN pow(1 - k/4, 3) / 6 WHEN 1 THEN (3*pow(k/4, 3) - 6*pow(k/4, 2) + 4) / 6
                WHEN 2 THEN (-3*pow(k/4, 3) + 3*pow(k/4, 2) + 3*(k/4) + 1) / 6 ELSE pow(k/4, 3) / 6 END AS b
  FROM smp, range(4) r(j))"""


@query("curve_points", f"""WITH {CURVE_SQL}
SELECT vec_id, CAST(seg * 4 + k AS INTEGER) AS sample, round(sum(b * x), 6) AS x, round(sum(b * y), 6) AS y
FROM wts JOIN ctl USING (vec_id, idx) GROUP BY 1, 2""")
def curve_points(spark, sf):
    return rounded(G.curve_points(control(spark, sf), ["vec_id"], 4))


@query("curve_error", f"""WITH {CURVE_SQL}, s AS (
  SELECT vec_id, ctl.label, seg, k, sum(b * (x * 0.9 - x)) AS dx, sum(b * (y + 0.01 - y)) AS dy
  FROM wts JOIN ctl USING (vec_id, idx) WHERE vec_id % 5 <> 0 GROUP BY ALL)
SELECT label, round(avg(abs(dx) + abs(dy)) / 2 * 256, 6) AS curve_error FROM s GROUP BY label""")
def curve_error(spark, sf):
    t = control(spark, sf).withColumn("live", F.expr("vec_id % 5 <> 0"))
    p = t.selectExpr("vec_id", "label", "idx", "x * 0.9D AS x", "y + 0.01D AS y")
    return rounded(G.curve_error(p, t, ["label"], ["label", "vec_id"], 4, 256.0))


@query("point_error", f"""WITH {POINTS_SQL}, e AS (
  SELECT label, sqrt(pow(x - y, 2) + pow(y - x / 2, 2)) * 256 AS err, (abs(x - y) + abs(y - x / 2)) / 2 * 256 AS l1
  FROM points WHERE point_idx % 4 <> 1)
SELECT label, round(avg(err), 6) AS mean_err, round(max(err), 6) AS max_err, round(avg(l1), 6) AS l1_err,
       round(quantile_cont(err, 0.95), 6) AS p95_err FROM e GROUP BY label""")
def point_error(spark, sf):
    p = points(spark, sf).selectExpr("label", "x AS px", "y AS py", "y AS tx", "x / 2 AS ty", "point_idx % 4 <> 1 AS live")
    return rounded(G.point_error(p, ["label"], 256.0))


BOX_SQL = """axis AS (
  SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY ok, ln, pk) - 1 AS frame FROM (
    SELECT l_suppkey AS element_id, l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, sum(l_quantity) AS q,
           max(l_extendedprice) AS e, max(l_tax) AS tx FROM lineitem GROUP BY ALL)), boxes AS (
  SELECT element_id, frame, CASE WHEN tx > 0.01 THEN pk / 3.0::DOUBLE END AS bx,
         CASE WHEN tx > 0.01 THEN ok / 90.0::DOUBLE END AS by_, CASE WHEN tx > 0.01 THEN q * 3.3::DOUBLE END AS bw,
         CASE WHEN tx > 0.01 THEN e / 700 END AS bh FROM axis), sized AS (
  SELECT *, CAST(round_even(greatest(max(greatest(bw, bh)) OVER (PARTITION BY element_id), 16) * 1.3::DOUBLE, 0) AS BIGINT) AS size
  FROM boxes), raw AS (
  SELECT *, CAST(round_even(bx + bw / 2 - size / 2.0::DOUBLE, 0) AS BIGINT) AS rx,
            CAST(round_even(by_ + bh / 2 - size / 2.0::DOUBLE, 0) AS BIGINT) AS ry FROM sized), plan AS (
  SELECT element_id, frame, size, coalesce(last_value(rx IGNORE NULLS) OVER w, first_value(rx IGNORE NULLS) OVER a) AS x0,
         coalesce(last_value(ry IGNORE NULLS) OVER w, first_value(ry IGNORE NULLS) OVER a) AS y0
  FROM raw WINDOW w AS (PARTITION BY element_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  a AS (PARTITION BY element_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def boxes(spark, sf):
    from ..functions.ordered import positions
    li = load(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("element_id"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk")).agg(F.expr("sum(l_quantity) AS q"), F.expr("max(l_extendedprice) AS e"),
                                            F.expr("max(l_tax) AS tx"))
    axis = positions(li, ["element_id"], ["ok", "ln", "pk"], F.floor(F.col("ok") / 4096), "frame")
    return axis.selectExpr("element_id", "frame", "CASE WHEN tx > 0.01 THEN pk / 3.0D END AS bx",
                           "CASE WHEN tx > 0.01 THEN ok / 90.0D END AS by_",
                           "CASE WHEN tx > 0.01 THEN q * 3.3D END AS bw", "CASE WHEN tx > 0.01 THEN e / 700 END AS bh")


@query("crop_plan", f"WITH {BOX_SQL} SELECT element_id, frame, size, x0, y0 FROM plan")
def crop_plan(spark, sf):
    return G.crop_plan(boxes(spark, sf), margin=0.15, min_px=16)


@query("off_source", f"""WITH {BOX_SQL}
SELECT element_id, count(*) FILTER (x0 < 0 OR y0 < 0 OR x0 + size > 700 OR y0 + size > 200) AS frames_off_source
FROM plan GROUP BY 1""")
def off_source(spark, sf):
    return G.off_source(G.crop_plan(boxes(spark, sf), margin=0.15, min_px=16), ["element_id"], 700, 200)


@query("resample_ring", f"""WITH {POINTS_SQL}, ring AS (
  SELECT vec_id, point_idx AS idx, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx,
         coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny
  FROM points WINDOW w AS (PARTITION BY vec_id ORDER BY point_idx)), e AS (
  SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS len FROM ring), c AS (
  SELECT *, sum(len) OVER (PARTITION BY vec_id ORDER BY idx) AS fin, sum(len) OVER (PARTITION BY vec_id) AS total FROM e)
SELECT vec_id, CAST(s AS INTEGER) AS sample, round(x + (nx - x) * least(greatest(s * total / 48 - fin + len, 0), len) / len, 6) AS x,
       round(y + (ny - y) * least(greatest(s * total / 48 - fin + len, 0), len) / len, 6) AS y
FROM c, range(48) r(s) WHERE round((fin - len) * 48 / total, 9) <= s AND s < round(fin * 48 / total, 9)""")
def resample_ring(spark, sf):
    p = points(spark, sf).selectExpr("vec_id", "point_idx AS idx", "32 AS cnt", "x", "y")
    return rounded(G.resample_ring(p, ["vec_id"], 48))


@query("decimate", f"""WITH {HALVES_SQL}, c AS (SELECT vec_id, idx, n, greatest(3, CAST(floor(n * 0.8) AS INTEGER)) AS k FROM halves)
SELECT vec_id, idx FROM c WHERE k >= n OR list_contains(list_transform(range(k), lambda i: round_even(i * (n - 1)::DOUBLE / (k - 1), 0)), idx)""")
def decimate(spark, sf):
    return G.decimate(control(spark, sf).select("vec_id", "idx", "n"), "floor(n * 0.8)").select("vec_id", "idx")


def _carried(spark, sf):
    """Shapes of every label under their carriers, and all matrices."""
    m = mats(spark, sf)
    anc = m.selectExpr("label AS element_id", "vec_id AS shape_id", "explode(array(" + ", ".join(
        f"named_struct('node_id', {n}, 'depth', {d}, 'has_transform', {h})" for n, d, h in (
            ("vec_id % 5", 0, "false"), ("100 + vec_id % 11", 1, "vec_id % 2 = 0"), ("200 + vec_id % 13", 2, "false")))
        + ")) AS a").selectExpr("element_id", "shape_id", "a.*")
    groups = m.selectExpr("label AS element_id", "vec_id AS shape_id", "vec_id % 4 AS group_id")
    gm = m.selectExpr("label AS element_id", "vec_id % 4 AS group_id", "vec_id AS frame", "matrix")
    out = G.apply_group_transforms(anc, groups, gm)
    return rounded(out.selectExpr("element_id", "carrier", "group_id", "frame", "shapes", "matrix[0] AS m00"))


@query("apply_group_transforms", f"""WITH {MATS_SQL}, anc AS (
  SELECT label AS element_id, vec_id AS shape_id, unnest([vec_id % 5, 100 + vec_id % 11, 200 + vec_id % 13]) AS node_id,
         unnest([0, 1, 2]) AS depth, unnest([false, vec_id % 2 = 0, false]) AS has_transform FROM embeddings), car AS (
  SELECT element_id, shape_id, arg_max(node_id, (has_transform, depth)) AS carrier FROM anc GROUP BY ALL), pairs AS (
  SELECT element_id, carrier, shape_id % 4 AS group_id, count(*) AS shapes FROM car GROUP BY ALL)
SELECT element_id, carrier, group_id, vec_id AS frame, shapes, round(m[1], 6) AS m00
FROM pairs JOIN mats ON label = element_id AND vec_id % 4 = group_id""", also="apply_group_transforms_all")
def apply_group_transforms(spark, sf):
    """Every matrix, on every carrier of its element and group."""
    return _carried(spark, sf)


@query("bezier_points", """WITH e AS (SELECT vec_id, vec_id % 2 = 0 AS closed, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), s AS (
  SELECT *, i, (i + 1) % 10 AS j, k / 4 AS t, i * 4 + k AS sample FROM e, range(10) a(i), range(5) b(k)
  WHERE (closed OR i < 9) AND (k < 4 OR (NOT closed AND i = 8)))
SELECT vec_id, CAST(sample AS INTEGER) AS sample,
  round(pow(1 - t, 3) * e[6*i+1] + 3 * (1 - t) * (1 - t) * t * e[6*i+5] + 3 * (1 - t) * t * t * e[6*j+3] + pow(t, 3) * e[6*j+1], 6) AS x,
  round(pow(1 - t, 3) * e[6*i+2] + 3 * (1 - t) * (1 - t) * t * e[6*i+6] + 3 * (1 - t) * t * t * e[6*j+4] + pow(t, 3) * e[6*j+2], 6) AS y FROM s""")
def bezier_points(spark, sf):
    """Ten anchors per vector, each followed by its in-handle and out-handle."""
    e = load(spark, sf, "embeddings").selectExpr("vec_id", "transform(embedding, v -> CAST(v AS DOUBLE)) AS e")
    p = e.selectExpr("vec_id", "e", "explode(sequence(0, 9)) AS idx").selectExpr(
        "vec_id", "idx", "10 AS n", "vec_id % 2 = 0 AS closed",
        *[f"e[6 * idx + {i}] AS {c}" for i, c in enumerate(("x", "y", "ix", "iy", "ox", "oy"))])
    return rounded(G.bezier_points(p, ["vec_id"], 4))


@query("probe_temporal_error", f"""WITH {POINTS_SQL}, {MATS_SQL}, {PROJ_SQL}, {PROBES_SQL}, e AS (
  SELECT label, probe, frame, vec_id % 3 <> 0 AS live, {_P[0]} - px AS ex, {_P[1]} - py AS ey
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM proj) JOIN probes USING (label)), l AS (
  SELECT *, lag(ex) OVER w AS lx, lag(ey) OVER w AS ly, lag(live) OVER w AS ll
  FROM e WINDOW w AS (PARTITION BY label, probe ORDER BY frame))
SELECT label, probe, round(coalesce((sum(abs(ex - lx) + abs(ey - ly)) FILTER (live AND ll))
  / nullif(2 * count(*) FILTER (live AND ll), 0), 0) * 256, 6) AS probe_temporal_error FROM l GROUP BY ALL""", also="probe_temporal_error_all")
def probe_temporal_error(spark, sf):
    """The maps of each label, in vector order, are the frames of its track; its own probes ride on them."""
    probes = G.group_probes(points(spark, sf), ["label"], "point_idx % 5 <> 0")
    m = positions(mats(spark, sf), ["label"], ["vec_id"], chunk_id("vec_id"), "frame")
    m = G.proj_encode(m, name="pred").selectExpr(
        "label", "frame", "pred", "array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D) AS truth", "vec_id % 3 <> 0 AS live")
    return rounded(G.probe_temporal_error(m.join(probes, "label"), ["label", "probe"], ["label", "probe"], 256.0))
