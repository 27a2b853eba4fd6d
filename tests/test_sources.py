"""Listings, project files, nested documents and versions on generated fixtures."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from keyloom.sources import ir, listing, projects, tree, versions

XML = """<!-- project --><Project version="7"><Source label="plate" width="2880" height="1978"/>
<Session><Properties><Property id="duration"><Value>40</Value></Property><Property id="startFrame"><Value>1001</Value></Property></Properties></Session>
<Node type="RotoNode"><Properties><Property id="objects">
<Object type="Layer" label="Hero" uuid="u1"><Properties>
 <Property id="transform.position"><Value>(0,0)</Value></Property>
 <Property id="opacity"><Key frame="0" interp="hold">100</Key><Key frame="5" interp="hold">0</Key></Property>
 <Property id="objects"><Object type="Shape" label="A" shape_type="Bspline"><Properties><Property id="path">
   <Key frame="3" interp="linear"><Path closed="True" type="Bspline"><Point>(0,0)</Point><Point>(1,0)</Point><Point>(1,1)</Point></Path></Key>
   <Key frame="1" interp="hold"><Path closed="True" type="Bspline"><Point>(0,0)</Point><Point>(2,0)</Point><Point>(2,2)</Point></Path></Key>
 </Property></Properties></Object>
 <Object type="Layer" label="Inner"/></Property></Properties></Object>
</Property></Properties></Node></Project>"""


@pytest.fixture()
def delivery(tmp_path):
    d = tmp_path / "shotA" / "splines" / "silhouette"
    d.mkdir(parents=True)
    (d / "project.sfx").write_text(XML)
    body = XML.encode()
    (d / "backup.1.sfx").write_bytes(struct.pack(">I", len(body)) + zlib.compress(body))
    (d / "broken.sfx").write_bytes(struct.pack(">I", 9) + zlib.compress(body))
    (d / "mixed.sfx").write_text(XML.replace("<Point>(2,2)</Point>", ""))
    m = tmp_path / "shotA" / "mattes" / "hard" / "m1"
    m.mkdir(parents=True)
    (m / "x_V01.1030.exr").write_bytes(b"0")
    (m / "x_V01_1001.exr").write_bytes(b"0")
    return tmp_path


def test_listing_and_names(spark, delivery):
    files = listing.classify_files(listing.list_files(spark, str(delivery))).collect()
    by = {r["name"]: r for r in files}
    assert by["project.sfx"]["kind"] == "project" and by["project.sfx"]["is_preferred"] and by["project.sfx"]["shot"] == "shotA"
    assert by["backup.1.sfx"]["is_autosave"] and not by["broken.sfx"]["is_autosave"]
    assert {by["x_V01.1030.exr"]["frame"], by["x_V01_1001.exr"]["frame"]} == {1030, 1001}
    assert by["x_V01_1001.exr"]["matte"] == "m1" and by["x_V01_1001.exr"]["matte_kind"] == "hard"


def test_project_ingest_quarantines(spark, delivery):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sfx").load(str(delivery))
    t = projects.ingest_projects(projects.parse_projects(files))
    assert sorted(r["container"] for r in t["docs"].collect()) == ["plain", "zlib"]
    assert all((r["duration"], r["start_frame"], r["width"]) == (40, 1001, 2880) for r in t["docs"].collect())
    bad = {r["path"].rsplit("/", 1)[1]: r["error"] for r in t["quarantine"].collect()}
    assert bad == {"broken.sfx": "length_mismatch", "mixed.sfx": "point_count"}
    one = t["nodes"].where("path LIKE '%project.sfx'").orderBy("node_id").collect()
    assert [(r["node_id"], r["kind"], r["name"]) for r in one] == [("0", "layer", "Hero"), ("0/0", "shape", "A"), ("0/1", "layer", "Inner")]
    k = t["keys"].where("path LIKE '%project.sfx'").collect()
    assert {(r["track"], r["frame"]) for r in k} == {("path", 1), ("path", 3), ("opacity", 0), ("opacity", 5)}


def test_project_details(spark):
    shape = ('<Object type="Shape" label="{0}"><Properties><Property id="path"><Key frame="2"><Path closed="False"><Point>(1,2)</Point></Path></Key></Property>'
             '<Property id="strokeWidth"><Value>2.5 px</Value></Property><Property id="feather"><Key frame="1">4 5</Key></Property>'
             '<Property id="invert"><Value> True</Value></Property></Properties></Object>')
    layer = ('<Object type="Layer" id="L9"><Properties><Property id="transform.scale"><Value>1.000001 1</Value></Property>'
             '<Property id="transform.rotate"><Value>30</Value></Property><Property id="feather"><Key frame="1">4</Key></Property>'
             '<Property id="objects"><Object type="Shape" label="none"/>' + shape.format("in") + '</Property></Properties></Object>')
    xml = ('<!-- p --><P><Source/><Source width="10" height="20"/><Node type="RotoNode"><Properties><Property id="objects">'
           + shape.format("top") + layer + "</Property></Properties></Node></P>")
    bad = {"short": b"abc", "noise": b"abcdefgh", "xml": b"<!-- --><P><Q></P>", "size": b"<!-- --><P/>",
           "type": xml.replace('"Shape" label="none"', '"Disc"').encode(), "frame": xml.replace('frame="2"', "").encode(),
           "kind": xml.replace('label="in"', 'label="in" shape_type="oval"').encode(), "width": xml.replace("<Point>(1,2)", "<Point>(1,2,3,4)</Point><Point>(1,2)").encode()}
    t = projects.ingest_projects(projects.parse_projects(spark.createDataFrame([("ok", xml.encode()), *bad.items()], "path string, content binary")))
    assert {r["path"]: r["error"] for r in t["quarantine"].collect()} == {
        "short": "too_short", "noise": "not_zlib", "xml": "not_xml", "size": "no_source_size", "type": "object_type", "frame": "key_frame",
        "kind": "shape_type", "width": "point_width"}
    assert [tuple(r) for r in t["docs"].collect()] == [("ok", "plain", 10, 20, 0, 24.0, 1001)]
    nodes = [(r["node_id"], r["parent_id"], r["ordinal"], r["kind"], r["name"], r["closed"], r["invert"], r["stroke_width"]) for r in t["nodes"].orderBy("node_id").collect()]
    assert nodes == [("0", None, 0, "layer", "<bare:top>", None, False, None), ("0/0", "0", 0, "shape", "top", False, True, 2.5),
                     ("1", None, 1, "layer", "L9", None, False, None), ("1/0", "1", 0, "shape", "in", False, True, 2.5)]
    keys = sorted((r["node_id"], r["track"], r["frame"], r["interp"], r["n_points"], r["value"]) for r in t["keys"].collect())
    assert keys == [("0/0", "feather", 1, "linear", 1, [4.0]), ("0/0", "path", 2, "linear", 1, [1.0, 2.0]), ("1", "rotate", 0, "hold", 1, [30.0]),
                    ("1/0", "feather", 1, "linear", 1, [4.0]), ("1/0", "path", 2, "linear", 1, [1.0, 2.0])]


def test_pick_candidate_ladder(spark):
    c = spark.createDataFrame([
        ("a", "a/project.sfx", "project.sfx", 5, True, None, 1), ("a", "a/z.sfx", "z.sfx", 9, True, 0.9, 9),
        ("b", "b/project.sfx", "project.sfx", 5, False, None, 0), ("b", "b/x.sfx", "x.sfx", 9, True, 0.5, 1), ("b", "b/y.sfx", "y.sfx", 2, True, 0.5, 2),
        ("c", "c/x.sfx", "x.sfx", 9, True, 0.0, 3), ("c", "c/y.sfx", "y.sfx", 2, True, 0.0, 3),
        ("d", "d/x.sfx", "x.sfx", 9, False, None, 3)], "shot string, path string, name string, size long, parses boolean, agreement double, n_shapes int")
    shots = spark.createDataFrame([(s,) for s in "abcde"], "shot string")
    got = {r["shot"]: (r["path"], r["reason"]) for r in listing.pick_candidate(shots, c).collect()}
    assert got == {"a": ("a/project.sfx", "project.sfx (rung 1)"), "b": ("b/y.sfx", "best EXR agreement 0.5000 (rung 2)"),
                   "c": ("c/x.sfx", "most shapes, 3 (rung 3)"), "d": (None, "none of 1 candidates parse"), "e": (None, "no .sfx found")}


def test_require_keys_names_the_missing(spark):
    df = spark.createDataFrame([("a",), ("b",)], "shot string")
    many = spark.range(200).selectExpr("concat('m', id) AS shot")
    with pytest.raises(ValueError) as info:
        listing.require_keys(df, many, "shot", "shots")
    assert info.value.args[0].count("'m") == 200
    with pytest.raises(ValueError, match=r"\['x', 'y'\]"):
        listing.require_keys(df, spark.createDataFrame([("y",), ("a",), ("x",)], "shot string"), "shot", "shots")


def test_ir_round_trip_keeps_interleaving(spark):
    shape = lambda n: {"label": n, "uuid": "", "mode": "Subtract", "invert": True,
                       "path_keys": [[2, "hold", False, [[[0.5, 1.0]], [[2.0, 3.0]]]], [5, "linear", False, [[[1.5, 1.0]], [[2.0, 3.0]]]]]}
    leaf = {"label": "leaf \"q\"", "uuid": "u2", "shapes": [shape("s3")], "children": []}
    doc = {"session": {}, "layers": [{"label": "root", "uuid": "u1", "shapes": [shape("s1"), shape("s2")], "children": [leaf],
                                      "order": [["shape", 0], ["layer", 0], ["shape", 1]]}]}
    docs = spark.createDataFrame([(1, json.dumps(doc))], "doc_id int, json string")
    flat = ir.flatten_ir(docs)
    got = [(r["node_id"], r["kind"], r["label"]) for r in flat["nodes"].orderBy("node_id").collect()]
    assert got == [("0", "layer", "root"), ("0/0", "shape", "s1"), ("0/1", "layer", 'leaf "q"'), ("0/1/0", "shape", "s3"), ("0/2", "shape", "s2")]
    nested = ir.nest_ir(docs.withColumn("session", F.lit("{}")), flat["nodes"], flat["path_keys"])
    again = ir.flatten_ir(nested)
    for t in ("nodes", "path_keys"):
        assert sorted(map(str, flat[t].collect())) == sorted(map(str, again[t].collect()))


def test_tree_depth_guard(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "node_id string, parent_id string")
    with pytest.raises(ValueError, match="cycle"):
        tree.ancestors(loop)
    deep = spark.createDataFrame([(i, i - 1 if i else None) for i in range(70)], "node_id int, parent_id int")
    assert tree.ancestors(deep).agg(F.max("distance")).first()[0] == 69


def test_resolve_raises_with_both_names(spark):
    els = spark.createDataFrame([("s", "u9", "gone")], "shot string, uuid string, name string")
    layers = spark.createDataFrame([("s", "u1", "n", 1, 0)], "shot string, uuid string, name string, node_id int, ordinal int")
    with pytest.raises(Exception, match="u9 or name gone"):
        tree.resolve(els, layers).collect()


def test_resolve_takes_the_first_of_a_repeated_uuid(spark):
    els = spark.createDataFrame([("s", "u1", "n"), ("s", "", "n")], "shot string, uuid string, name string")
    layers = spark.createDataFrame([("s", "u1", "a", 7, 1), ("s", "u1", "b", 5, 0), ("s", "", "c", 9, 3), ("s", None, "n", 6, 2)],
                                   "shot string, uuid string, name string, node_id int, ordinal int")
    assert sorted((r["uuid"], r["node_id"], r["matched_by"]) for r in tree.resolve(els, layers).collect()) == [("", 6, "name"), ("u1", 5, "uuid")]


def test_listing_root_is_literal(spark, tmp_path):
    root = tmp_path / "a+b (1)"
    (root / "shotX").mkdir(parents=True)
    (root / "shotX" / "f.txt").write_text("x")
    assert [r["shot"] for r in listing.list_files(spark, str(root)).collect()] == ["shotX"]


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "shot string, element_id int, frame int")
    assert not versions.version_exists(spark, root, "v1")
    versions.write_version({"element": df}, root, "v1")
    assert versions.version_exists(spark, root, "v1")
    with pytest.raises(FileExistsError):
        versions.write_version({"element": df}, root, "v1")
    versions.write_version({"element": df}, root, "v1", overwrite=True)
    assert versions.read_version(spark, root, "v1", "element").count() == 2
    assert versions.read_version(spark, root, "v1", "splits") is None
    with pytest.raises(versions.StorageUnavailable):
        versions.version_exists(spark, "nosuchfs://bucket", "v1")


def test_score_sink(spark, tmp_path):
    table = spark.createDataFrame([("A", 2, "second", "0.5000", "0.0100"), ("A", 1, "first", "--", "")],
                                  "section string, ordinal int, label string, value string, spread string")
    summary = spark.createDataFrame([("r", 0.5)], "run string, mean_soft_iou double")
    versions.write_scores(summary, table, str(tmp_path / "s"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "s" / "table")).collect()]
    assert [line.split()[0] for line in lines] == ["first", "second"] and "--" in lines[0]
    assert spark.read.json(str(tmp_path / "s" / "summary")).first()["mean_soft_iou"] == 0.5
