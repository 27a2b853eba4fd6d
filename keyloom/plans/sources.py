"""Source-side queries: candidates, names, probes, trees, nested documents, sync."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import element_name
from ..functions.lineage import work_dir
from ..sources import ir, listing as L, projects, tree
from ..sources.files import put_files
from .registry import query
from .tables import load

CAND_SQL = """cand AS (
  SELECT source AS shot, doc_id, 'p/' || source || '/' || CASE WHEN doc_id % 40 = 3 THEN 'project.sfx' WHEN doc_id % 3 = 0 THEN 'backup.' || doc_id || '.sfx'
         ELSE 'final_v' || doc_id || '.sfx' END AS path, n_chars AS size, lang <> 'de' AND source <> 'src7' AS parses,
         CASE WHEN source IN ('src1', 'src2', 'src3') THEN n_chars % 100 / 100 END AS agreement, n_chars % 50 AS n_shapes FROM documents)"""


def candidates(spark, sf):
    return load(spark, sf, "documents").selectExpr(
        "source AS shot", "doc_id", "concat('p/', source, '/', CASE WHEN doc_id % 40 = 3 THEN 'project.sfx' WHEN doc_id % 3 = 0 "
        "THEN concat('backup.', doc_id, '.sfx') ELSE concat('final_v', doc_id, '.sfx') END) AS path", "n_chars AS size",
        "lang <> 'de' AND source <> 'src7' AS parses",
        "CASE WHEN source IN ('src1', 'src2', 'src3') THEN n_chars % 100 / 100 END AS agreement", "n_chars % 50 AS n_shapes"
    ).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))


@query("pick_candidate", f"""WITH {CAND_SQL}, shots AS (SELECT DISTINCT source AS shot FROM documents UNION ALL SELECT 'src_empty'), b AS (
  SELECT shot, count(*) AS n, count(*) FILTER (parses) AS np, min(path) FILTER (parses AND path LIKE '%/project.sfx') AS r1,
         max((agreement, path)) FILTER (parses AND agreement IS NOT NULL) AS r2, arg_min((n_shapes, path), (-n_shapes, -size, path)) FILTER (parses) AS r3
  FROM cand GROUP BY 1)
SELECT shot, CASE WHEN r1 IS NOT NULL THEN r1 WHEN r2[1] > 0 THEN r2[2] ELSE r3[2] END AS path,
  CASE WHEN n IS NULL THEN 'no .sfx found' WHEN r1 IS NOT NULL THEN 'project.sfx (rung 1)' WHEN np = 0 THEN 'none of ' || n || ' candidates parse'
       WHEN r2[1] > 0 THEN 'best EXR agreement ' || printf('%.4f', r2[1]) || ' (rung 2)' ELSE 'most shapes, ' || r3[1] || ' (rung 3)' END AS reason,
  coalesce(n, 0) AS n_candidates FROM shots LEFT JOIN b USING (shot)""")
def pick_candidate(spark, sf):
    c = candidates(spark, sf)
    shots = c.select("shot").distinct().unionByName(spark.createDataFrame([("src_empty",)], "shot string"))
    return L.pick_candidate(shots, c)


def delivery(spark, sf):
    """Documents written as the files of a delivery: a project a document, or a frame of its source's mattes. The root."""
    root = work_dir(spark)
    rows = load(spark, sf, "documents").selectExpr(
        "concat(source, CASE WHEN doc_id % 5 = 0 THEN concat('/splines/silhouette/project.', doc_id, '.sfx') WHEN doc_id % 5 < 4 "
        "THEN concat('/mattes/', lang, '/m', doc_id % 3, '/x_V01.', 1000 + doc_id, '.exr') ELSE concat('/notes/', lang, '/', doc_id, '.txt') END) AS relpath",
        "CAST(text AS BINARY) AS content")
    put_files(rows, root).agg(F.sum("size")).collect()
    return root


@query("list_delivery", """SELECT source AS shot, CASE WHEN doc_id % 5 = 0 THEN 'project.' || doc_id || '.sfx' WHEN doc_id % 5 < 4 THEN 'x_V01.' || (1000 + doc_id) || '.exr'
    ELSE doc_id || '.txt' END AS name, strlen(coalesce(text, '')) AS size, CASE WHEN doc_id % 5 = 0 THEN 'project' WHEN doc_id % 5 < 4 THEN 'matte' ELSE 'other' END AS kind,
  CASE WHEN doc_id % 5 BETWEEN 1 AND 3 THEN lang ELSE '' END AS matte_kind, CASE WHEN doc_id % 5 BETWEEN 1 AND 3 THEN 'm' || doc_id % 3 ELSE '' END AS matte,
  CASE WHEN doc_id % 5 BETWEEN 1 AND 3 THEN 1000 + doc_id END AS frame FROM documents""")
def list_delivery(spark, sf):
    """Every file of a delivery, found by tasks that walk its folders, with what its name says."""
    files = L.classify_files(L.list_files(spark, delivery(spark, sf)))
    return files.select("shot", "name", "size", "kind", "matte_kind", "matte", "frame")


@query("classify_files", """WITH f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'autosave.' || page_id || '.sfx' WHEN 1 THEN 'project.sfx'
  WHEN 2 THEN 'x_V01.' || (1000 + page_id) || '.exr' WHEN 3 THEN 'x_V01_' || (1000 + page_id) || '.exr' ELSE regexp_extract(url, '([^/]*)$', 1) END AS name FROM pages)
SELECT page_id, name, regexp_matches(name, '^(project|backup|autosave)(\\.\\d+)?\\.sfx$') AS is_autosave, name = 'project.sfx' AS is_preferred,
  TRY_CAST(nullif(regexp_extract(name, '[._](\\d+)\\.exr$', 1), '') AS BIGINT) AS frame FROM f""")
def classify_files(spark, sf):
    f = load(spark, sf, "pages").select("page_id", F.expr(
        "CASE page_id % 5 WHEN 0 THEN concat('autosave.', page_id, '.sfx') WHEN 1 THEN 'project.sfx' WHEN 2 THEN concat('x_V01.', 1000 + page_id, '.exr') "
        "WHEN 3 THEN concat('x_V01_', 1000 + page_id, '.exr') ELSE regexp_extract(url, '([^/]*)$', 1) END AS name"))
    return L.classify_files(f)


@query("element_names", """SELECT page_id, 's' || page_id % 7 || '__' || coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_.\\-]+', '_', 'g'), '_'), ''), 'unnamed')
  AS element_id FROM pages""")
def element_names(spark, sf):
    return load(spark, sf, "pages").select("page_id", element_name(F.expr("concat('s', page_id % 7)"), F.col("url")).alias("element_id"))


@query("require_keys", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents WHERE n_chars > 20000)")
def require_keys(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return L.require_keys(d, d.where("n_chars > 20000"), "source", "shots").select("doc_id", "source")


@query("probe_frames", """WITH e AS (SELECT conv_id, count(*) AS d FROM conversations GROUP BY 1), f AS (
  SELECT conv_id, d, unnest(CASE WHEN d <= 2 THEN range(0, d) ELSE range(1, d - 1, greatest(1, (d - 2) // 3)) [1:3] END) AS frame FROM e)
SELECT conv_id, frame FROM f""")
def probe_frames(spark, sf):
    e = load(spark, sf, "conversations").groupBy("conv_id").agg(F.expr("count(1) AS duration"))
    return L.probe_frames(e, 3)


NODES_SQL = """nodes AS (SELECT 'r' || r_regionkey AS node_id, NULL AS parent_id, r_regionkey AS ordinal FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey FROM customer), chain AS (
  SELECT node_id, parent_id AS ancestor_id, 1 AS distance FROM nodes WHERE parent_id IS NOT NULL
  UNION ALL SELECT c.node_id, n.parent_id, distance + 1 FROM chain c JOIN nodes n ON n.node_id = c.ancestor_id WHERE n.parent_id IS NOT NULL)"""


def nodes(spark, sf):
    r = load(spark, sf, "region").selectExpr("concat('r', r_regionkey) AS node_id", "CAST(NULL AS STRING) AS parent_id", "CAST(r_regionkey AS BIGINT) AS ordinal")
    n = load(spark, sf, "nation").selectExpr("concat('n', n_nationkey) AS node_id", "concat('r', n_regionkey) AS parent_id", "CAST(n_nationkey AS BIGINT) AS ordinal")
    c = load(spark, sf, "customer").selectExpr("concat('c', c_custkey) AS node_id", "concat('n', c_nationkey) AS parent_id", "c_custkey AS ordinal")
    return r.unionByName(n).unionByName(c)


@query("ancestors", f"WITH RECURSIVE {NODES_SQL} SELECT node_id, ancestor_id, distance FROM chain")
def ancestors(spark, sf):
    return tree.ancestors(nodes(spark, sf))


@query("tree_walk", f"""WITH RECURSIVE {NODES_SQL}, o AS (
  SELECT node_id, 0 AS distance, ordinal FROM nodes UNION ALL SELECT c.node_id, distance, n.ordinal FROM chain c JOIN nodes n ON n.node_id = c.ancestor_id)
SELECT node_id, CAST(count(*) - 1 AS INTEGER) AS depth, string_agg(lpad(CAST(ordinal AS VARCHAR), 10, '0'), '/' ORDER BY distance DESC) AS order_key FROM o GROUP BY 1""")
def tree_walk(spark, sf):
    n = nodes(spark, sf)
    return tree.walk(n, tree.ancestors(n))


@query("isolate", f"""WITH RECURSIVE {NODES_SQL}, i AS (
  SELECT node_id FROM nodes WHERE node_id LIKE 'n%' AND ordinal >= 20 UNION SELECT c.node_id FROM chain c JOIN nodes n ON n.node_id = c.ancestor_id
  WHERE n.node_id LIKE 'n%' AND n.ordinal >= 20), s AS (
  SELECT DISTINCT ancestor_id AS node_id FROM chain WHERE node_id IN (SELECT node_id FROM nodes WHERE node_id LIKE 'n%' AND ordinal >= 20)
  AND ancestor_id NOT IN (SELECT node_id FROM i))
SELECT node_id, parent_id, 'content' AS role FROM nodes WHERE node_id IN (SELECT node_id FROM i)
UNION ALL SELECT node_id, parent_id, 'stub' FROM nodes WHERE node_id IN (SELECT node_id FROM s)""")
def isolate(spark, sf):
    n = nodes(spark, sf)
    return tree.isolate(n, tree.ancestors(n), n.where("node_id LIKE 'n%' AND ordinal >= 20")).select("node_id", "parent_id", "role")


@query("resolve_layers", """WITH l AS (SELECT source AS shot, 'u' || doc_id AS uuid, lang AS name, doc_id AS node_id FROM documents), n AS (
  SELECT shot, name, min(node_id) AS n FROM l GROUP BY ALL)
SELECT d.source AS shot, d.doc_id, coalesce(l.node_id, n.n) AS node_id, CASE WHEN l.node_id IS NOT NULL THEN 'uuid' ELSE 'name' END AS matched_by
FROM documents d LEFT JOIN l ON l.shot = d.source AND l.uuid = CASE WHEN d.doc_id % 2 = 0 THEN 'u' || d.doc_id ELSE 'x' || d.doc_id END
LEFT JOIN n ON n.shot = d.source AND n.name = d.lang""")
def resolve_layers(spark, sf):
    d = load(spark, sf, "documents")
    layers = d.selectExpr("source AS shot", "concat('u', doc_id) AS uuid", "lang AS name", "doc_id AS node_id", "doc_id AS ordinal")
    els = d.selectExpr("source AS shot", "doc_id", "concat(CASE WHEN doc_id % 2 = 0 THEN 'u' ELSE 'x' END, doc_id) AS uuid", "lang AS name")
    return tree.resolve(els, layers).select("shot", "doc_id", "node_id", "matched_by")


@query("nest_flatten", """SELECT conv_id AS doc_id, '0' AS node_id, NULL AS parent_id, 0 AS ordinal, 'layer' AS kind, 'root' AS label FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT conv_id, '0/' || o, '0', CAST(o AS INTEGER), CASE WHEN role = 'assistant' THEN 'layer' ELSE 'shape' END, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS o FROM conversations)""")
def nest_flatten(spark, sf):
    """Conversations nested to one JSON document each and flattened again: order and text survive."""
    from ..functions.ordered import positions
    c = positions(load(spark, sf, "conversations"), ["conv_id"], ["turn", "role", "text"], F.floor(F.col("turn") / 4096), "o")
    kids = c.selectExpr("conv_id AS doc_id", "concat('0/', o) AS node_id", "'0' AS parent_id", "CAST(o AS INT) AS ordinal", "1 AS depth",
                        "CASE WHEN role = 'assistant' THEN 'layer' ELSE 'shape' END AS kind", "text AS label",
                        "CAST(NULL AS STRING) AS uuid", "'Add' AS mode", "false AS invert")
    docs = load(spark, sf, "conversations").selectExpr("conv_id AS doc_id").distinct()
    root = docs.selectExpr("doc_id", "'0' AS node_id", "CAST(NULL AS STRING) AS parent_id", "0 AS ordinal", "0 AS depth", "'layer' AS kind",
                           "'root' AS label", "CAST(NULL AS STRING) AS uuid", "'Add' AS mode", "false AS invert")
    keys = kids.where("kind = 'shape'").selectExpr("doc_id", "node_id", "ordinal AS frame", "'linear' AS interp", "true AS closed",
                                                   "array(array(array(0D, 1D))) AS value")
    nested = ir.nest_ir(docs.withColumn("session", F.lit("{}")), root.unionByName(kids), keys)
    return ir.flatten_ir(nested)["nodes"].select("doc_id", "node_id", "parent_id", "ordinal", "kind", "label")


SCENE_SQL = """turns AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS o, turn, length(text) AS len, role, text
  FROM conversations), kids AS (SELECT doc_id, '0/' || o AS node_id, o, turn, len, text, role = 'assistant' AS is_layer FROM turns)"""


def scene(spark, sf):
    """Conversations as typed documents: assistants' turns are layers with transforms, the others' are shapes with paths."""
    from ..functions.ordered import positions
    c = positions(load(spark, sf, "conversations"), ["conv_id"], ["turn", "role", "text"], F.floor(F.col("turn") / 4096), "o")
    kids = c.selectExpr("conv_id AS doc_id", "concat('0/', o) AS node_id", "CAST(o AS INT) AS o", "CAST(turn AS INT) AS turn", "length(text) AS len",
                        "text", "role = 'assistant' AS is_layer")
    docs = kids.select("doc_id").distinct()
    nodes = docs.selectExpr("doc_id", "'0' AS node_id", "CAST(NULL AS STRING) AS parent_id", "0 AS ordinal", "0 AS depth", "'layer' AS kind", "'root' AS label",
                            "'r' AS uuid", "'Add' AS mode", "false AS invert", "CAST(NULL AS STRING) AS shape_type", "CAST(NULL AS DOUBLE) AS stroke_width")
    nodes = nodes.unionByName(kids.selectExpr(
        "doc_id", "node_id", "'0' AS parent_id", "o AS ordinal", "1 AS depth", "CASE WHEN is_layer THEN 'layer' ELSE 'shape' END AS kind", "text AS label",
        "concat('u', turn) AS uuid", "CASE WHEN o % 3 = 0 THEN 'Subtract' ELSE 'Add' END AS mode", "o % 4 = 1 AS invert",
        "CASE WHEN NOT is_layer THEN IF(len % 2 = 0, 'Xspline', 'Bspline') END AS shape_type", "CASE WHEN NOT is_layer THEN turn / 4D END AS stroke_width"))

    def key(track, ordinal, frame, interp, constant, value, closed="CAST(NULL AS BOOLEAN)", n="CAST(NULL AS INT)"):
        return (f"struct('{track}' AS track, {ordinal} AS ordinal, CAST({frame} AS INT) AS frame, '{interp}' AS interp, {constant} AS constant, "
                f"{closed} AS closed, {n} AS n_points, transform(array({value}), x -> CAST(x AS DOUBLE)) AS value)")
    grid = lambda f: ", ".join(f"{i} + {f}" for i in range(16))
    layer = [key("matrix", 0, "turn", "hold", "false", grid("o")), key("matrix", 1, "turn + 2", "linear", "false", grid("len")),
             key("trs.position", 0, 0, "hold", "true", "turn, o"), key("trs.rotate", 0, "turn", "linear", "false", "len"),
             key("trs.rotate", 1, "turn + 7", "catmullrom", "false", "len / 4D"), key("opacity", 0, 0, "hold", "true", "len % 101")]
    shape = [key("path", 0, "turn", "linear", "false", "len, turn, o, 3, 1, 2, 5, 8", "o % 2 = 0", "2"),
             key("path", 1, "turn + 3", "hold", "false", "turn, len, o, 4, 1, 2, 5, 9", "o % 2 = 0", "2"),
             key("opacity", 0, "turn", "hold", "false", "100"), key("opacity", 1, "turn + 1", "linear", "false", "len % 101"),
             key("feather", 0, 0, "hold", "true", "o / 2D, turn")]
    keys = kids.select("doc_id", "node_id", F.explode(F.expr(f"CASE WHEN is_layer THEN array({', '.join(layer)}) ELSE array({', '.join(shape)}) END")).alias("k")
                       ).select("doc_id", "node_id", "k.*")
    keys = keys.unionByName(docs.select("doc_id", F.lit("0").alias("node_id"), F.expr(key("matrix", 0, 0, "hold", "true", grid("doc_id"))).alias("k")).select(
        "doc_id", "node_id", "k.*"))
    about = docs.selectExpr(
        "doc_id", "struct(CAST(100 + doc_id AS INT) AS width, 50 AS height, 1001 AS startFrame, CAST(doc_id % 90 AS INT) AS duration, 23.5D AS frameRate) AS session",
        "'3' AS schema_version", "IF(doc_id % 2 = 0, concat('a ', char(34), 'quoted', char(34), ' dialect'), NULL) AS dialect", "'plate' AS source_label", "concat('/p/', doc_id) AS source_path",
        "CAST(doc_id AS STRING) AS source_file")
    return about, nodes, keys


def reread_scene(spark, sf):
    """The scene as nested documents, read again."""
    return ir.flatten_ir(ir.nest_ir(*scene(spark, sf)))


@query("nest_nodes", f"""WITH {SCENE_SQL}
SELECT doc_id, '0' AS node_id, NULL AS parent_id, 0 AS ordinal, 'layer' AS kind, 'root' AS label, 'r' AS uuid, 'Add' AS mode, false AS invert, NULL AS shape_type,
  NULL::DOUBLE AS stroke_width FROM (SELECT DISTINCT doc_id FROM kids)
UNION ALL SELECT doc_id, node_id, '0', CAST(o AS INTEGER), CASE WHEN is_layer THEN 'layer' ELSE 'shape' END, text, 'u' || turn, CASE WHEN o % 3 = 0 THEN 'Subtract' ELSE 'Add' END,
  o % 4 = 1, CASE WHEN NOT is_layer THEN CASE WHEN len % 2 = 0 THEN 'Xspline' ELSE 'Bspline' END END, CASE WHEN NOT is_layer THEN turn / 4.0::DOUBLE END FROM kids""")
def nest_nodes(spark, sf):
    return reread_scene(spark, sf)["nodes"].drop("depth")


def _key_sql(kind: str, track: str, ordinal: int, frame: str, interp: str, constant: str, value: str, closed="NULL::BOOLEAN", n="NULL::INTEGER") -> str:
    return (f"SELECT doc_id, node_id, '{track}' AS track, {ordinal} AS ordinal, CAST({frame} AS INTEGER) AS frame, '{interp}' AS interp, {constant} AS constant, "
            f"{closed} AS closed, {n} AS n_points, [{value}] AS v FROM kids WHERE {kind}")


_GRID = lambda f: ", ".join(f"{i} + {f}" for i in range(16))
SCENE_KEYS_SQL = " UNION ALL ".join([
    _key_sql("is_layer", "matrix", 0, "turn", "hold", "false", _GRID("o")), _key_sql("is_layer", "matrix", 1, "turn + 2", "linear", "false", _GRID("len")),
    _key_sql("is_layer", "trs.position", 0, "0", "hold", "true", "turn, o"), _key_sql("is_layer", "trs.rotate", 0, "turn", "linear", "false", "len"),
    _key_sql("is_layer", "trs.rotate", 1, "turn + 7", "catmullrom", "false", "len / 4"), _key_sql("is_layer", "opacity", 0, "0", "hold", "true", "len % 101"),
    _key_sql("NOT is_layer", "path", 0, "turn", "linear", "false", "len, turn, o, 3, 1, 2, 5, 8", "o % 2 = 0", "2"),
    _key_sql("NOT is_layer", "path", 1, "turn + 3", "hold", "false", "turn, len, o, 4, 1, 2, 5, 9", "o % 2 = 0", "2"),
    _key_sql("NOT is_layer", "opacity", 0, "turn", "hold", "false", "100"), _key_sql("NOT is_layer", "opacity", 1, "turn + 1", "linear", "false", "len % 101"),
    _key_sql("NOT is_layer", "feather", 0, "0", "hold", "true", "o / 2, turn"),
    "SELECT DISTINCT doc_id, '0', 'matrix', 0, 0, 'hold', true, NULL::BOOLEAN, NULL::INTEGER, [" + _GRID("doc_id") + "] FROM kids"])


@query("nest_keys", f"""WITH {SCENE_SQL} SELECT doc_id, node_id, track, ordinal, frame, interp, constant, closed, n_points,
  array_to_string(list_transform(v, lambda x: CAST(CAST(x * 4 AS BIGINT) AS VARCHAR)), ',') AS quarters FROM ({SCENE_KEYS_SQL})""")
def nest_keys(spark, sf):
    """Every key of every track: paths, matrices, transforms, opacity and feather."""
    return reread_scene(spark, sf)["keys"].withColumn("quarters", F.expr(
        "array_join(transform(value, x -> CAST(CAST(x * 4 AS BIGINT) AS STRING)), ',')")).drop("value")


@query("nest_docs", f"""WITH {SCENE_SQL} SELECT DISTINCT doc_id, CAST(100 + doc_id AS INTEGER) AS width, 50 AS height, 1001 AS start_frame, CAST(doc_id % 90 AS INTEGER) AS duration,
  23.5::DOUBLE AS frame_rate, '3' AS schema_version, CASE WHEN doc_id % 2 = 0 THEN 'a "quoted" dialect' END AS dialect, 'plate' AS source_label,
  '/p/' || doc_id AS source_path, CAST(doc_id AS VARCHAR) AS source_file FROM kids""")
def nest_docs(spark, sf):
    return reread_scene(spark, sf)["docs"].selectExpr(
        "doc_id", "session.width", "session.height", "session.startFrame AS start_frame", "session.duration", "session.frameRate AS frame_rate",
        "schema_version", "dialect", "source_label", "source_path", "source_file")


@query("sync_plan", """WITH s AS (SELECT doc_id, source || '/' || doc_id AS relpath, n_chars AS size FROM documents)
SELECT relpath, size, CASE WHEN doc_id % 5 = 0 THEN 'copy: missing' WHEN doc_id % 7 = 0 THEN 'copy: changed' ELSE 'current' END AS action FROM s""")
def sync_plan(spark, sf):
    s = load(spark, sf, "documents").selectExpr("doc_id", "concat(source, '/', doc_id) AS relpath", "n_chars AS size",
                                                "timestamp_seconds(1700000000 + doc_id) AS mtime")
    d = s.where("doc_id % 5 > 0").selectExpr("relpath", "CASE WHEN doc_id % 7 = 0 THEN size + 1 ELSE size END AS size",
                                             "mtime + INTERVAL 0.25 SECOND AS mtime")
    return L.sync_plan(s.drop("doc_id"), d)


@query("run_path", """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'runs/local/u' || o_custkey || '/' || o_orderpriority
  ELSE 'runs/staging/' || o_orderpriority END AS run_path, 'datasets/v' || o_custkey % 4 AS dataset_path FROM orders""")
def run_path(spark, sf):
    o = load(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_custkey % 3 = 0 THEN 'local' ELSE 'staging' END AS environment", "concat('u', o_custkey) AS user",
        "o_orderpriority AS run", "concat('v', o_custkey % 4) AS dataset_version")
    return L.run_path(o).select("o_orderkey", "run_path", "dataset_path")


def project_files(spark, sf, n=4):
    """One project a vector: a layer with opacity and a shape of two outlines of ``n`` points; every tenth lacks a point in the second."""
    def outline(frame, first, n):
        pts = f"transform(sequence(0, {n} - 1), i -> concat('<Point>(', v[{first} + 2 * i], ',', v[{first} + 1 + 2 * i], ')</Point>'))"
        return f"'<Key frame=\"{frame}\" interp=\"hold\"><Path closed=\"True\">', array_join({pts}, ''), '</Path></Key>'"
    e = load(spark, sf, "embeddings").selectExpr("vec_id", "label", "transform(embedding, x -> CAST(round(100 * CAST(x AS DOUBLE)) AS INT)) AS v")
    second = outline(1, 2 * n, f"CASE WHEN vec_id % 10 = 7 THEN {n - 1} ELSE {n} END")
    return e.selectExpr("CAST(vec_id AS STRING) AS path", f"""encode(concat('<!-- p --><P><Source width="', 100 + label, '" height="50"/><Node type="RotoNode">',
      '<Properties><Property id="objects"><Object type="Layer" label="L', vec_id, '"><Properties><Property id="opacity"><Key frame="', label, '">',
      vec_id % 101, '</Key></Property><Property id="objects"><Object type="Shape" label="S"><Properties><Property id="path">', {outline(5, 0, n)}, {second},
      '</Property></Properties></Object></Property></Properties></Object></Property></Properties></Node></P>'), 'UTF-8') AS content""")


@query("project_ingest", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(round(100 * x::DOUBLE) AS INTEGER)) AS v
  FROM embeddings WHERE vec_id % 10 <> 7)
SELECT CAST(vec_id AS VARCHAR) AS path, '0' AS node_id, 'opacity' AS track, label AS frame, 'linear' AS interp, 1 AS n_points, (vec_id % 101)::DOUBLE AS total FROM e
UNION ALL SELECT CAST(vec_id AS VARCHAR), '0/0', 'path', 5, 'hold', 16, list_sum(v[1:32])::DOUBLE FROM e
UNION ALL SELECT CAST(vec_id AS VARCHAR), '0/0', 'path', 1, 'hold', 16, list_sum(v[33:64])::DOUBLE FROM e""", also="project_ingest_all")
def project_ingest(spark, sf):
    """Whole vectors: all 32 points over the two outlines."""
    keys = projects.ingest_projects(projects.parse_projects(project_files(spark, sf, 16)))["keys"]
    return keys.selectExpr("path", "node_id", "track", "frame", "interp", "n_points", "aggregate(value, 0D, (a, x) -> a + x) AS total")


@query("project_nodes", """SELECT CAST(vec_id AS VARCHAR) AS path, '0' AS node_id, 'layer' AS kind, 'L' || vec_id AS name, 100 + label AS width
  FROM embeddings WHERE vec_id % 10 <> 7 UNION ALL SELECT CAST(vec_id AS VARCHAR), '0/0', 'shape', 'S', 100 + label FROM embeddings WHERE vec_id % 10 <> 7""")
def project_nodes(spark, sf):
    t = projects.ingest_projects(projects.parse_projects(project_files(spark, sf)))
    return t["nodes"].join(t["docs"].select("path", "width"), "path").select("path", "node_id", "kind", "name", "width")


@query("project_quarantine", "SELECT CAST(vec_id AS VARCHAR) AS path, 'point_count' AS error FROM embeddings WHERE vec_id % 10 = 7")
def project_quarantine(spark, sf):
    return projects.ingest_projects(projects.parse_projects(project_files(spark, sf)))["quarantine"]
