"""Nested documents with every kind of track, both ways; listings that tasks walk."""

import json

from keyloom.sources import ir, listing
from keyloom.sources.files import put_files

EYE = [float(i % 5 == 0) for i in range(16)]
DOC = {
    "session": {"width": 2880, "height": 1978, "startFrame": 1001, "duration": 40, "frameRate": 23.976}, "schema_version": 3, "dialect": "d", "source_label": "plate",
    "layers": [{
        "label": "root", "uuid": "u", "mode": "Add", "invert": False, "opacity": {"keys": [[0, "hold", "100.0"], [5, "linear", "(0.5)"]]},
        "matrix": {"keys": [[1, EYE], [2, [1.0]], [3, [2 * x for x in EYE]]]}, "matrix_interp": ["hold", "catmullrom"],
        "trs": {"position": {"const": "(1.5,-2e-3)"}, "rotate": {"keys": [[4, "", "90"]]}, "anchor": None, "scale": {"const": [1, 2]}},
        "shapes": [{"label": "s", "shape_type": "Xspline", "strokeWidth": {"const": "1.25"}, "mode": "Subtract", "invert": True,
                    "path_keys": [[3, "hold", False, [[[0, 1], [2, 3], [4, 5]], [[6, 7], [8, 9], [10, 11]]]]], "feather": {"keys": [[0, "linear", "(1,2)"]]},
                    "opacity": {"const": "100.0"}}, {"label": "bare", "path_keys": []}],
        "children": [{"label": None, "matrix": {"const": EYE}, "shapes": [], "children": []}], "order": [["shape", 1], ["layer", 0], ["shape", 0]]}]}


def flat(spark, texts):
    return ir.flatten_ir(spark.createDataFrame(list(enumerate(texts)), "doc_id int, json string"))


def rows(df):
    return sorted(str(r.asDict(True)) for r in df.collect())


def test_every_track_is_read(spark):
    got = flat(spark, [json.dumps(DOC)])
    keys = {(r.node_id, r.track, r.ordinal): r for r in got["keys"].collect()}
    assert set(keys) == {("0", "opacity", 0), ("0", "opacity", 1), ("0", "matrix", 0), ("0", "matrix", 1), ("0", "trs.position", 0), ("0", "trs.rotate", 0),
                         ("0", "trs.scale", 0), ("0/1", "matrix", 0), ("0/2", "path", 0), ("0/2", "feather", 0), ("0/2", "opacity", 0)}
    assert [keys["0", "matrix", i][k] for i in (0, 1) for k in ("frame", "interp")] == [1, "hold", 3, "catmullrom"]
    assert keys["0", "trs.position", 0].value == [1.5, -0.002] and keys["0", "trs.position", 0].constant and keys["0", "trs.scale", 0].value == [1.0, 2.0]
    assert (keys["0", "trs.rotate", 0].interp, keys["0", "trs.rotate", 0].frame) == ("linear", 4)
    path = keys["0/2", "path", 0]
    assert path.value == [float(i) for i in range(12)] and path.n_points == 2 and path.closed is False
    nodes = {r.node_id: r for r in got["nodes"].collect()}
    assert (nodes["0/2"].shape_type, nodes["0/2"].stroke_width, nodes["0/0"].shape_type, nodes["0"].shape_type) == ("Xspline", 1.25, "Bspline", None)
    doc = got["docs"].first()
    assert (doc.session.width, doc.session.frameRate, doc.schema_version, doc.dialect, doc.source_path) == (2880, 23.976, "3", "d", None)


def test_round_trip_keeps_everything(spark):
    one = flat(spark, [json.dumps(DOC), json.dumps({"session": {}, "layers": []}), json.dumps({"layers": [{"label": "only"}]})])
    two = ir.flatten_ir(ir.nest_ir(one["docs"], one["nodes"], one["keys"]))
    for t in ("docs", "nodes", "keys", "path_keys"):
        assert rows(one[t]) == rows(two[t]), t
    again = json.loads(ir.nest_ir(one["docs"], one["nodes"], one["keys"]).where("doc_id = 0").first().json)
    root = again["layers"][0]
    assert root["order"] == [["shape", 0], ["layer", 0], ["shape", 1]] and [s["label"] for s in root["shapes"]] == ["bare", "s"]
    assert root["shapes"][1]["path_keys"] == DOC["layers"][0]["shapes"][0]["path_keys"] and root["children"][0]["label"] is None


def test_listing_is_walked_by_tasks(spark, tmp_path):
    files = spark.createDataFrame([(f"s{i % 3}/a/b{i % 4}/f{i}.{'exr' if i % 2 else 'txt'}", bytes(i)) for i in range(60)] + [("top.txt", b"x"), ("s1/m.txt", None)],
                                  "relpath string, content binary")
    assert put_files(files.repartition(3), str(tmp_path)).count() == 62
    for depth in (0, 1, 2, 7):
        got = sorted((r.path.removeprefix(f"{tmp_path}/"), r["size"], r.shot) for r in listing.list_files(spark, str(tmp_path), depth=depth).collect())
        assert got == sorted((r.relpath, len(r.content or b""), r.relpath.split("/")[0]) for r in files.collect())
    assert listing.list_files(spark, str(tmp_path), "*.exr").count() == 30
    (tmp_path / "none").mkdir()
    assert listing.list_files(spark, str(tmp_path / "none")).count() == 0
