"""Quality-gate, provenance and run-tracking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from .registry import query
from .scoring import rounded
from .tables import load

PAIR_SQL = """el AS (
  SELECT l_suppkey % 10 AS shot, l_suppkey AS frame, l_linenumber AS element_id, l_partkey % 8 AS y, (l_partkey // 8) % 8 AS x,
         max(l_discount) * 10 AS cov FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL HAVING max(l_discount) > 0), ch AS (
  SELECT l_suppkey % 10 AS shot, l_suppkey AS frame, 'm:' || l_returnflag AS channel, l_partkey % 8 AS y, (l_partkey // 8) % 8 AS x,
         max(l_discount) * 10 AS cov FROM lineitem WHERE l_linestatus = 'F' AND (l_returnflag <> 'R' OR l_suppkey % 10 <> 3)
  GROUP BY ALL HAVING max(l_discount) > 0), te AS (
  SELECT shot, frame, element_id, sum(cov) AS a FROM el GROUP BY ALL), tc AS (
  SELECT shot, frame, channel, sum(cov) AS b FROM ch GROUP BY ALL), inter AS (
  SELECT el.shot, el.frame, element_id, channel, sum(least(el.cov, ch.cov)) AS i FROM el JOIN ch USING (shot, frame, y, x) GROUP BY ALL), sc AS (
  SELECT shot, element_id, channel, round(avg(coalesce(i, 0) / (a + b - coalesce(i, 0))), 9) AS score, count(*) AS evidence
  FROM te JOIN tc USING (shot, frame) LEFT JOIN inter USING (shot, frame, element_id, channel) GROUP BY ALL), best AS (
  SELECT *, row_number() OVER (PARTITION BY shot, element_id ORDER BY score DESC, channel) AS r FROM sc WHERE evidence >= 2), ids AS (
  SELECT DISTINCT l_suppkey % 10 AS shot, l_linenumber AS element_id FROM lineitem), anyb AS (
  SELECT shot, element_id, max(score) AS ms, arg_max(evidence, (score, evidence)) AS me FROM sc GROUP BY ALL), pairing AS (
  SELECT ids.shot, ids.element_id, CASE WHEN b.score >= 0.5 THEN channel END AS channel, coalesce(b.score, ms, 0) AS score,
         coalesce(b.evidence, me, 0) AS evidence, CASE WHEN b.score >= 0.5 THEN 'gold' ELSE 'silver' END AS grade,
         CASE WHEN b.score IS NULL THEN 'no channel with >= 2 evidence frames'
              WHEN b.score < 0.5 THEN 'unmatched: best ' || printf('%.4f', b.score) || ' < 0.5' END AS reason
  FROM ids LEFT JOIN best b ON b.shot = ids.shot AND b.element_id = ids.element_id AND r = 1
  LEFT JOIN anyb ON anyb.shot = ids.shot AND anyb.element_id = ids.element_id)"""


def pair_inputs(spark, sf):
    li = load(spark, sf, "lineitem")
    key = [F.expr(e) for e in ("l_suppkey % 10 AS shot", "l_suppkey AS frame", "l_partkey % 8 AS y", "(l_partkey div 8) % 8 AS x")]
    cov = F.expr("max(l_discount) * 10 AS cov")
    el = li.where("l_linestatus = 'O'").groupBy(*key, F.col("l_linenumber").alias("element_id")).agg(cov).where("cov > 0")
    ch = li.where("l_linestatus = 'F' AND (l_returnflag <> 'R' OR l_suppkey % 10 <> 3)").groupBy(
        *key, F.expr("concat('m:', l_returnflag) AS channel")).agg(cov).where("cov > 0")
    ids = li.select(F.expr("l_suppkey % 10 AS shot"), F.col("l_linenumber").alias("element_id")).distinct()
    return el, ch, ids


def pairings(spark, sf):
    el, ch, ids = pair_inputs(spark, sf)
    return Q.pair_elements(Q.pair_scores(el, ch, 64), ids), ch.select("shot", "channel").distinct()


@query("pair_elements", f"WITH {PAIR_SQL} SELECT shot, element_id, channel, round(score, 6) AS score, evidence, grade, reason FROM pairing")
def pair_elements(spark, sf):
    return rounded(pairings(spark, sf)[0])


@query("pair_usable", f"""WITH {PAIR_SQL}, bad AS (SELECT DISTINCT shot FROM pairing WHERE shot % 3 = 1)
SELECT shot, element_id, CASE WHEN bad.shot IS NULL THEN channel END AS channel, CASE WHEN bad.shot IS NULL THEN round(score, 6) ELSE 0 END AS score,
  CASE WHEN bad.shot IS NULL THEN evidence ELSE 0 END AS evidence, CASE WHEN bad.shot IS NULL THEN grade ELSE 'silver' END AS grade,
  CASE WHEN bad.shot IS NULL THEN reason ELSE 'no matte of this shot can be used' END AS reason FROM pairing LEFT JOIN bad USING (shot)""")
def pair_usable(spark, sf):
    """The same where every third shot delivered no usable matte."""
    el, ch, ids = pair_inputs(spark, sf)
    mattes = ids.select("shot").distinct().where("shot % 3 <> 1").withColumn("matte", F.lit("m"))
    return rounded(Q.pair_elements(Q.pair_scores(el, ch, 64), ids, mattes))


# Claims come from the orders: few shots, many claims per channel, some margins under 0.05.
CLAIM_SQL = """p AS (
  SELECT *, CASE WHEN score >= 0.5 THEN 'c' || CAST(element_id // 3 AS VARCHAR) END AS channel FROM (
    SELECT o_custkey % 50 AS shot, o_orderkey % 12 AS element_id, max(o_totalprice) / 500000 AS score, count(*) AS evidence
    FROM orders GROUP BY 1, 2)), pr AS (
  SELECT *, CASE WHEN channel IS NULL THEN 'silver' ELSE 'gold' END AS grade,
         CASE WHEN channel IS NULL THEN 'unmatched: best ' || printf('%.4f', score) END AS reason FROM p), c AS (
  SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nx, count(*) OVER (PARTITION BY shot, channel) AS n,
         first_value(element_id) OVER w AS winner FROM pr WHERE channel IS NOT NULL
  WINDOW w AS (PARTITION BY shot, channel ORDER BY score DESC, element_id)), m AS (
  SELECT *, max(CASE WHEN r = 1 THEN score - nx END) OVER (PARTITION BY shot, channel) AS margin FROM c), k AS (
  SELECT *, CASE WHEN n < 2 THEN 'single' WHEN round(margin, 9) < 0.05 THEN 'ambiguous' ELSE 'collision' END AS kind FROM m), fin AS (
  SELECT shot, element_id, CASE WHEN r = 1 THEN channel END AS channel, score, evidence,
         CASE WHEN r > 1 OR kind = 'ambiguous' THEN 'silver' ELSE grade END AS grade,
         CASE WHEN r > 1 THEN 'lost ' || channel || ' to ' || winner || ' by ' || printf('%.4f', margin)
              WHEN kind = 'ambiguous' THEN 'ambiguous claim on ' || channel ELSE reason END AS reason FROM k
  UNION ALL SELECT shot, element_id, channel, score, evidence, grade, reason FROM pr WHERE channel IS NULL), findings AS (
  SELECT shot, kind, channel AS subject, winner || ' wins by ' || printf('%.4f', margin) AS detail FROM k WHERE r = 1 AND n > 1
  UNION ALL SELECT shot, 'orphan', channel, 'claimed by no element' FROM (
    SELECT DISTINCT o_custkey % 50 AS shot, 'c' || CAST(o_orderkey % 5 AS VARCHAR) AS channel FROM orders
    EXCEPT SELECT shot, channel FROM pr)
  UNION ALL SELECT shot, 'unmatched', CAST(element_id AS VARCHAR), 'best ' || printf('%.4f', score) || ' on ' || evidence || 'f'
  FROM fin WHERE grade = 'silver' AND reason IS NOT NULL)"""


def claims(spark, sf):
    o = load(spark, sf, "orders")
    p = o.groupBy(F.expr("o_custkey % 50 AS shot"), F.expr("o_orderkey % 12 AS element_id")).agg(
        F.expr("max(o_totalprice) / 500000 AS score"), F.expr("count(1) AS evidence"))
    p = p.withColumn("channel", F.expr("CASE WHEN score >= 0.5 THEN concat('c', element_id div 3) END"))
    p = p.select("*", F.expr("CASE WHEN channel IS NULL THEN 'silver' ELSE 'gold' END AS grade"),
                 F.expr("CASE WHEN channel IS NULL THEN concat('unmatched: best ', format_string('%.4f', score)) END AS reason"))
    present = o.selectExpr("o_custkey % 50 AS shot", "concat('c', o_orderkey % 5) AS channel").distinct()
    return Q.resolve_claims(p, present)


@query("resolve_claims", f"WITH {CLAIM_SQL} SELECT shot, element_id, channel, round(score, 6) AS score, evidence, grade, reason FROM fin")
def resolve_claims(spark, sf):
    return rounded(claims(spark, sf)[0])


@query("claim_findings", f"WITH {CLAIM_SQL} SELECT * FROM findings")
def claim_findings(spark, sf):
    return claims(spark, sf)[1]


@query("apply_gate", f"""WITH {CLAIM_SQL}, bad AS (SELECT DISTINCT shot FROM findings WHERE kind = 'ambiguous')
SELECT shot, element_id, grade, CASE WHEN shot IN (SELECT shot FROM bad) THEN 'shot failed pairing QC' END AS why FROM fin""")
def apply_gate(spark, sf):
    final, findings = claims(spark, sf)
    kept, skipped = Q.apply_gate(final.select("shot", "element_id", "grade"), findings)
    return kept.withColumn("why", F.lit(None).cast("string")).unionByName(skipped)


@query("usable_inputs", """WITH f AS (
  SELECT source AS shot, lang AS matte, doc_id AS frame, CASE WHEN n_chars > 60 THEN n_chars % 40 END AS width, 20 AS height FROM documents), m AS (
  SELECT *, row_number() OVER (PARTITION BY shot, matte ORDER BY frame) - 1 AS p, count(*) OVER (PARTITION BY shot, matte) AS n FROM f)
SELECT shot, matte, CASE WHEN width IS NULL THEN 'unreadable' WHEN least(width, height) < 16 THEN 'degenerate'
  WHEN width <> 30 THEN 'resolution' END AS finding, width IS NOT NULL AND least(width, height) >= 16 AND width = 30 AS usable
FROM m WHERE p = n // 2""")
def usable_inputs(spark, sf):
    d = load(spark, sf, "documents")
    f = d.selectExpr("source AS shot", "lang AS matte", "doc_id AS frame", "CASE WHEN n_chars > 60 THEN n_chars % 40 END AS width", "20 AS height")
    docs = d.select(F.col("source").alias("shot")).distinct().selectExpr("shot", "30 AS width", "20 AS height")
    return Q.usable_inputs(f, docs)


@query("invariants", """SELECT 'fixed topology' AS item, count(*)::DOUBLE AS measured, CASE WHEN count(*) = 0 THEN 'GREEN' ELSE 'RED' END AS status
FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber % 2) > 1)
UNION ALL SELECT 'o_orderstatus vocabulary', count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P')), 'GREEN' FROM orders
UNION ALL SELECT 'l_discount range', count(*) FILTER (l_discount < 0 OR l_discount > 0.1), 'GREEN' FROM lineitem
UNION ALL SELECT 'line key', count(*), CASE WHEN count(*) = 0 THEN 'GREEN' ELSE 'RED' END FROM (
  SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'order key', count(*), 'GREEN' FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'frame completeness', count(*), CASE WHEN count(*) = 0 THEN 'GREEN' ELSE 'RED' END FROM (
  SELECT conv_id, count(DISTINCT turn) AS n, max(turn) - min(turn) + 1 AS e FROM conversations GROUP BY 1) WHERE n <> e""")
def invariants(spark, sf):
    li, o, c = (load(spark, sf, t) for t in ("lineitem", "orders", "conversations"))
    conv = c.select(F.col("conv_id").alias("element_id"), F.col("turn").alias("frame"))
    return Q.build_ledger([
        Q.check_topology(li.selectExpr("l_orderkey AS shape_id", "l_linenumber % 2 AS n_points")),
        Q.check_enum(o, "o_orderstatus", ["F", "O", "P"]), Q.check_range(li, "l_discount", 0.0, 0.1),
        Q.check_unique(li, ["l_orderkey", "l_linenumber"], "line key"), Q.check_unique(o, ["o_orderkey"], "order key"),
        Q.check_frames(conv, conv.groupBy("element_id").agg(F.expr("max(frame) - min(frame) + 1 AS n_frames"))),
    ]).select("item", "measured", "status")


def written_scene(spark, sf):
    """The typed documents of the conversations, and the same read back from their nested form."""
    from .sources import reread_scene, scene
    docs, nodes, keys = scene(spark, sf)
    return {"nodes": nodes, "keys": keys}, reread_scene(spark, sf)


@query("ledger", f"""WITH {CLAIM_SQL}, s AS (
  SELECT source || '__' || lang AS e, source, count(*) AS n FROM documents GROUP BY ALL)
SELECT 'scoring ceiling' AS item, 1.0::DOUBLE AS measured, 'GREEN' AS status
UNION ALL SELECT 'quantisation', 0, 'GREEN'
UNION ALL SELECT 'split record', 0, 'GREEN' UNION ALL SELECT 'held shots', 0, 'GREEN'
UNION ALL SELECT 'render conventions', 0, 'GREEN' UNION ALL SELECT 'round trip', 0, 'GREEN'
UNION ALL SELECT 'pairing QC', count(*) FILTER (kind = 'ambiguous'), CASE WHEN count(*) FILTER (kind = 'ambiguous') = 0 THEN 'GREEN' ELSE 'RED' END FROM findings""")
def ledger(spark, sf):
    from ..operators import coverage as C
    from ..operators import splits as S
    from .coverage import side_frames
    from ..functions.ordered import enough
    from .tables import pixels, track
    px = pixels(spark, sf)
    t = track(spark, sf).selectExpr("user_id AS element_id", "frame")
    split = S.frame_split(t, ["element_id"])
    els = load(spark, sf, "documents").groupBy(F.expr("concat(source, '__', lang) AS element_id"), F.col("source").alias("shot")).agg(
        F.expr("count(1) AS n_frames"))
    held = S.build_splits(els, ["src1"]).selectExpr("shot", "shot = 'src1' AS held_shot", "in_train")
    meta = load(spark, sf, "pages").selectExpr("page_id", "'measured' AS convention", "true AS stroke_open")
    sets = spark.createDataFrame([("measured", True), ("default", False)], "convention string, stroke_open boolean")
    return Q.build_ledger([
        Q.check_self_score(C.soft_iou(px, px, side_frames(spark, sf), ["side", "frame"], enough(px, 2 * load(spark, sf, "lineitem").count()))),
        Q.check_quantised(C.quantise(px)).withColumn("measured", F.round("measured", 9)),
        Q.check_split(split, t.groupBy("element_id").agg(F.expr("count(1) AS n_frames"))),
        Q.check_held_shots(held), Q.check_conventions(meta, sets, ["stroke_open"]),
        Q.check_round_trip(*written_scene(spark, sf)),
        Q.check_pairing(claims(spark, sf)[1])]).select("item", "measured", "status")


@query("tables_equal", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(s) AS BIGINT) AS excess FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, 1 AS s FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0.08 AND l_discount = 0.10 THEN l_partkey + 1 ELSE l_partkey END, -1 FROM lineitem)
GROUP BY 1, 2, 3 HAVING sum(s) <> 0""")
def tables_equal(spark, sf):
    """The rows on which a changed copy of the line items differs from the original."""
    a = load(spark, sf, "lineitem")
    b = a.withColumn("l_partkey", F.expr("CASE WHEN l_tax = 0.08 AND l_discount = 0.10 THEN l_partkey + 1 ELSE l_partkey END"))
    cols = ["l_orderkey", "l_linenumber", "l_partkey"]
    return Q.table_difference(a.select(*cols), b.select(*cols))


@query("fingerprint")
def fingerprint(spark, sf):
    """Content hash: checked for order independence in the tests."""
    return Q.fingerprint(load(spark, sf, "orders"))


PIECES = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT::HUGEINT * n) AS s{i}" for i in range(4))


@query("fingerprint_keys", f"""WITH h AS (SELECT sha256('{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"'
    || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}}') AS h FROM orders), c AS (SELECT h, count(*) AS n FROM h GROUP BY 1), p AS (
  SELECT substr(h, 1, 4) AS b, sum(n) AS n, {PIECES} FROM c GROUP BY 1)
SELECT substr(sha256('[' || string_agg('{{"b":"' || b || '","n":' || n || ',"s0":' || s0 || ',"s1":' || s1 || ',"s2":' || s2 || ',"s3":' || s3 || '}}',
    ',' ORDER BY b) || ']'), 1, 16) AS fingerprint, CAST(sum(n) AS BIGINT) AS rows FROM p""")
def fingerprint_keys(spark, sf):
    """Content hash of the columns that both engines write alike."""
    return Q.fingerprint(load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS rung, o_custkey % 9 AS seed,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  CASE WHEN o_custkey % 3 > 0 THEN 'staging' ELSE 'local' END AS environment, o_orderdate AS created FROM orders)"""


def runs(spark, sf):
    return load(spark, sf, "orders").selectExpr(
        "o_orderkey AS run_id", "o_orderpriority AS rung", "o_custkey % 9 AS seed",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status",
        "CASE WHEN o_custkey % 3 > 0 THEN 'staging' ELSE 'local' END AS environment", "o_orderdate AS created")


@query("list_runs", f"""WITH {RUNS_SQL}
SELECT run_id, rung, seed, status, environment, rung || '_seed' || seed AS name, status IN ('completed', 'failed', 'stopped') AS is_terminal
FROM runs WHERE environment = 'staging' AND status = 'completed' ORDER BY created DESC, run_id DESC LIMIT 50""")
def list_runs(spark, sf):
    return Q.run_view(Q.list_runs(runs(spark, sf), environment="staging", status="completed")).drop("created")


RUN_EVENTS_SQL = """ev AS (SELECT user_id AS run_id, event_id, ts, 'stage' || (event_id // 40) % 4 AS stage,
  CASE event_type WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'log' END AS kind FROM events)"""


def run_events(spark, sf):
    return load(spark, sf, "events").selectExpr(
        "user_id AS run_id", "event_id", "ts", "concat('stage', (event_id div 40) % 4) AS stage",
        "CASE event_type WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'log' END AS kind")


@query("stage_durations", f"""WITH {RUN_EVENTS_SQL}, g AS (
  SELECT run_id, stage, max(ts) FILTER (kind = 'started') AS s, max(ts) FILTER (kind = 'completed') AS c FROM ev GROUP BY ALL)
SELECT run_id, stage, round_even((epoch_us(c) - epoch_us(s)) / 1000000, 2) AS seconds FROM g""")
def stage_durations(spark, sf):
    return Q.stage_durations(run_events(spark, sf)).select("run_id", "stage", "seconds")


@query("latest_state", f"""WITH {RUN_EVENTS_SQL}
SELECT run_id, arg_max(stage, (ts, event_id)) AS stage, arg_max(kind, (ts, event_id)) AS kind, count(*) AS n_events,
       count(*) FILTER (kind = 'failed') AS failures FROM ev GROUP BY 1""")
def latest_state(spark, sf):
    return Q.latest_state(run_events(spark, sf))


@query("quotability", f"""WITH {RUNS_SQL}, r AS (SELECT run_id, CASE WHEN seed > 0 THEN environment END AS environment FROM runs)
SELECT run_id, coalesce(environment, 'unstamped') AS environment, coalesce(environment, 'unstamped') <> 'local' AS quotable FROM r""")
def quotability(spark, sf):
    return Q.quotability(runs(spark, sf).selectExpr("run_id", "CASE WHEN seed > 0 THEN environment END AS environment"))


@query("validate_requests", """WITH r AS (
  SELECT o_orderkey AS request_id, coalesce(CASE WHEN o_custkey % 5 > 0 THEN substr(o_orderpriority, 1, 1) END, '1') AS rung,
         CASE o_custkey % 4 WHEN 0 THEN 'staging' WHEN 1 THEN 'prod' WHEN 2 THEN 'local' ELSE 'staging' END AS environment,
         'src' || o_custkey % 25 AS dataset_version, coalesce(CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 7 END, 1) AS seed FROM orders)
SELECT request_id, rung || '_seed' || seed AS reference_id, rung, environment, dataset_version, seed,
  concat_ws('; ', CASE WHEN rung NOT IN ('1', '2', '3') THEN 'unknown rung ' || rung END,
    CASE WHEN environment NOT IN ('local', 'staging') THEN 'unknown environment ' || environment END,
    CASE WHEN dataset_version NOT IN (SELECT DISTINCT source FROM documents) THEN 'dataset ' || dataset_version || ' is not in storage' END) AS reasons
FROM r""")
def validate_requests(spark, sf):
    req = load(spark, sf, "orders").selectExpr(
        "o_orderkey AS request_id", "CASE WHEN o_custkey % 5 > 0 THEN substr(o_orderpriority, 1, 1) END AS rung",
        "CASE o_custkey % 4 WHEN 0 THEN 'staging' WHEN 1 THEN 'prod' WHEN 2 THEN 'local' ELSE '' END AS environment",
        "concat('src', o_custkey % 25) AS dataset_version", "CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 7 END AS seed",
        "CAST(NULL AS INT) AS steps", "'' AS reference_id")
    rungs = spark.createDataFrame([("1",), ("2",), ("3",)], "rung string")
    versions = load(spark, sf, "documents").select(F.col("source").alias("dataset_version"))
    return Q.validate_requests(req, rungs, versions, "1", "staging", "src0").drop("steps")


@query("resolve_configs", """WITH RECURSIVE n AS (
  SELECT 'r' || r_regionkey AS rung, NULL AS parent, 'steps' AS key, 'region' || r_regionkey AS value FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 'steps' ELSE 'batch' END, 'nation' || n_nationkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'seed', 'supp' || s_suppkey % 3 FROM supplier), chain AS (
  SELECT rung, rung AS at, 0 AS dist FROM n UNION ALL SELECT c.rung, n.parent, dist + 1 FROM chain c JOIN n ON n.rung = c.at WHERE n.parent IS NOT NULL),
base(key, b) AS (VALUES ('steps', '40000'), ('batch', '6'), ('seed', '1')), own AS (
  SELECT c.rung, n.key, arg_min(n.value, dist) AS v FROM chain c JOIN n ON n.rung = c.at GROUP BY ALL)
SELECT n.rung, base.key, coalesce(v, b) AS value, v IS NOT NULL AND v <> b AS changed
FROM n CROSS JOIN base LEFT JOIN own ON own.rung = n.rung AND own.key = base.key""")
def resolve_configs(spark, sf):
    """A three-level override chain: regions, nations, suppliers."""
    o = load(spark, sf, "region").selectExpr("concat('r', r_regionkey) AS rung", "CAST(NULL AS STRING) AS parent", "'steps' AS key",
                                             "concat('region', r_regionkey) AS value")
    o = o.unionByName(load(spark, sf, "nation").selectExpr(
        "concat('n', n_nationkey) AS rung", "concat('r', n_regionkey) AS parent",
        "CASE WHEN n_nationkey % 2 = 0 THEN 'steps' ELSE 'batch' END AS key", "concat('nation', n_nationkey) AS value"))
    o = o.unionByName(load(spark, sf, "supplier").selectExpr(
        "concat('s', s_suppkey) AS rung", "concat('n', s_nationkey) AS parent", "'seed' AS key", "concat('supp', s_suppkey % 3) AS value"))
    base = spark.createDataFrame([("steps", "40000"), ("batch", "6"), ("seed", "1")], "key string, value string")
    return Q.resolve_configs(base, o)


@query("project_scale", """SELECT source, count(*) AS shots, CAST(sum(n_chars) AS BIGINT) AS frames, round(count(*) * 2.1, 6) AS layers,
  round(count(*) * 2.1 * 0.905 / 1000, 6) AS disk_gb, round(count(*) * 2.1 * 36 / 1000, 6) AS ram_gb,
  round(240000::DOUBLE / sum(n_chars), 6) AS epochs FROM documents GROUP BY 1""".replace("count(*) * 2.1", "count(*)::DOUBLE * 2.1"))
def project_scale(spark, sf):
    s = load(spark, sf, "documents").groupBy("source").agg(F.expr("count(1) AS shots"), F.expr("sum(n_chars) AS frames"))
    return rounded(Q.project_scale(s))
