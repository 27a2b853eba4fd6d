"""Bulk project ingest: files to long element rows, then tables by column expressions.

Python only opens the container and lists XML elements: one row per element with its attributes, its text and the
chain of elements around it. What a project means (objects, tracks, identity transforms, refusals) is
decided by Spark columns over those rows, so a large project is spread like any other data. A file with any
problem goes to quarantine with a code and takes no part in the other tables.

Codes: ``too_short``, ``not_zlib``, ``length_mismatch``, ``not_xml`` (container); ``no_source_size``, ``object_type``,
``shape_type``, ``key_frame``, ``point_width``, ``point_count`` (content).
"""

from __future__ import annotations

import io
import sys
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import cut

# The reader travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
# Element names of the format, shape types, and the identity of each transform track.
LISTED = ("Source", "Session", "Node", "Object", "Property", "Value", "Key", "Path", "Point")
SHAPE_TYPES = {"bspline": "bspline", "b-spline": "bspline", "xspline": "xspline", "x-spline": "xspline", "bezier": "bezier"}
IDENTITY = {"position": (0.0, 0.0), "anchor": (0.0, 0.0), "scale": (1.0, 1.0), "rotate": (0.0,)}
SESSION = {"duration": ("duration", "int", 0), "frame_rate": ("frameRate", "double", 24.0), "start_frame": ("startFrame", "int", 1001)}

_AROUND = pa.list_(pa.struct([("eid", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("type", pa.string())]))
_ELEMENT = pa.schema([("path", pa.string()), ("container", pa.string()), ("problem", pa.string()), ("eid", pa.int32()),
                      ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("around", _AROUND)])
SCHEMA = ("path string, container string, problem string, eid int, tag string, attrs map<string,string>, text string, "
          "around array<struct<eid:int,tag:string,id:string,type:string>>")
ROWS = 2048


def opened(raw: bytes) -> tuple[str, bytes]:
    """Container and XML of a file, or ("problem", code)."""
    if raw.startswith(b"<!--"):
        return "plain", raw
    if len(raw) <= 4:
        return "problem", b"too_short"
    stream = zlib.decompressobj()
    try:
        body = stream.decompress(raw[4:])
    except zlib.error:
        return "problem", b"not_zlib"
    if not stream.eof:
        return "problem", b"not_zlib"
    return ("zlib", body) if len(body) == int.from_bytes(raw[:4], "big") else ("problem", b"length_mismatch")


def listed(path: str, raw: bytes) -> Iterator[dict]:
    """Rows of one file in document order; the first stands for the file itself."""
    container, body = opened(raw)
    if container == "problem":
        yield {"path": path, "container": None, "problem": body.decode(), "eid": 0}
        return
    yield {"path": path, "container": container, "problem": None, "eid": 0}
    around: list[dict] = []
    count = 0
    try:
        for event, el in ET.iterparse(io.BytesIO(body), events=("start", "end")):
            if event == "start":
                count += 1
                around.append({"eid": count, "tag": el.tag, "id": el.get("id"), "type": el.get("type")})
                continue
            own = around.pop()
            if el.tag in LISTED:
                yield {"path": path, "container": container, "problem": None, "eid": own["eid"], "tag": el.tag,
                       "attrs": list(el.attrib.items()), "text": el.text, "around": list(around)}
            el.clear()
    except ET.ParseError:
        yield {"path": path, "container": container, "problem": "not_xml", "eid": 0}


def parse_projects(files: DataFrame) -> DataFrame:
    """``(path, content)`` rows to element rows; a file is read alone and its rows leave in small batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                for row in listed(path.as_py(), content.as_py() or b""):
                    held.append(row)
                    if len(held) >= ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema=_ELEMENT)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ELEMENT)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def _up(steps: int, field: str) -> Column:
    """A field of the element ``steps`` levels above."""
    return F.expr(f"try_element_at(around, -{steps}).{field}")


def _attr(name: str) -> Column:
    return F.expr(f"nullif(attrs['{name}'], '')")


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.cast("double"))


def _objects(elements: DataFrame) -> DataFrame:
    """Objects with the object or node that lists them."""
    rows = elements.where((F.col("tag") == "Object") & (_up(1, "id") == "objects") & (_up(2, "tag") == "Properties"))
    inside = (_up(3, "tag") == "Object") & (_up(3, "type") == "Layer")
    top = (_up(3, "tag") == "Node") & (_up(3, "type") == "RotoNode")
    return rows.where(inside | top).select(
        "path", "eid", F.col("attrs")["type"].alias("type"), F.coalesce(_attr("label"), _attr("id"), F.lit("?")).alias("name"),
        F.col("attrs")["uuid"].alias("uuid"), _attr("shape_type").alias("declared"), F.when(inside, _up(3, "eid")).alias("parent"),
        F.expr("transform(filter(around, a -> a.tag = 'Object'), a -> a.eid)").alias("above"))


def _tracks(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numeric keys and constant values of every property, with the element that owns it."""
    of = [_up(3, "eid").alias("owner"), _up(3, "tag").alias("owner_tag"), _up(1, "id").alias("property")]
    inside = (_up(1, "tag") == "Property") & (_up(2, "tag") == "Properties")
    keys = elements.where((F.col("tag") == "Key") & inside).select(
        "path", *of, "eid", F.expr("try_cast(attrs['frame'] AS INT)").alias("frame"), F.coalesce(_attr("interp"), F.lit("linear")).alias("interp"),
        _numbers(F.col("text")).alias("value"))
    values = elements.where((F.col("tag") == "Value") & inside).select("path", *of, F.coalesce("text", F.lit("")).alias("text"))
    return keys, values


def _outlines(elements: DataFrame) -> DataFrame:
    """Keys of ``path`` properties: their points as one list, in document order."""
    rows = elements.where((F.col("tag") == "Point") & (_up(1, "tag") == "Path") & (_up(2, "tag") == "Key") & (_up(3, "id") == "path"))
    points = rows.select("path", _up(5, "eid").alias("owner"), _up(2, "eid").alias("key"), "eid", _numbers(F.col("text")).alias("v")).where("size(v) > 0")
    return points.groupBy("path", "owner", "key").agg(
        F.count(F.lit(1)).cast("int").alias("n_points"), F.count_distinct(F.size("v")).alias("widths"),
        F.expr("flatten(transform(array_sort(collect_list(struct(eid, v))), p -> p.v))").alias("value"))


def _near_identity(track: Column, value: Column) -> Column:
    """A transform value that does nothing, up to rounding."""
    out = F.lit(False)
    for name, identity in IDENTITY.items():
        same = [F.abs(F.try_element_at(value, F.lit(i + 1)) - v) <= 1e-8 + 1e-5 * abs(v) for i, v in enumerate(identity)]
        every = same[0]
        for s in same[1:]:
            every = every & s
        out = F.when(track == name, F.coalesce(every, F.lit(False))).otherwise(out)
    return out


def ingest_projects(parsed: DataFrame) -> dict[str, DataFrame]:
    """Documents, nodes, keys and quarantine. The element rows are written once and read by every table."""
    elements = cut(parsed)
    files = elements.where("eid = 0").groupBy("path").agg(F.max("container").alias("container"), F.max("problem").alias("problem"))
    keys, values = _tracks(elements)
    objects = _objects(elements)

    outlines = _outlines(elements).join(
        elements.where("tag = 'Key'").select("path", F.col("eid").alias("key"), F.expr("try_cast(attrs['frame'] AS INT)").alias("frame"),
                                             F.coalesce(_attr("interp"), F.lit("linear")).alias("interp")), ["path", "key"])
    first = elements.where("tag = 'Path'").select("path", _up(4, "eid").alias("owner"), _up(1, "eid").alias("key"),
                                                  (F.col("attrs")["closed"] == "True").alias("closed"), F.col("attrs")["type"].alias("path_type"))
    drawn = outlines.join(first, ["path", "owner", "key"], "left").groupBy("path", "owner").agg(
        F.min_by("closed", "key").alias("closed"), F.min_by("path_type", "key").alias("path_type"),
        F.count_distinct("n_points").alias("counts"), F.max("widths").alias("widths"), F.max(F.col("frame").isNull()).alias("no_frame"))

    setting = values.where("owner_tag = 'Object' AND property IN ('mode', 'invert', 'strokeWidth')").groupBy("path", "owner").agg(
        *[F.max(F.when(F.col("property") == p, F.col("text"))).alias(p) for p in ("mode", "invert", "strokeWidth")])
    known = F.create_map(*[F.lit(x) for pair in SHAPE_TYPES.items() for x in pair])
    full = (objects.join(drawn.withColumnRenamed("owner", "eid"), ["path", "eid"], "left")
            .join(setting.withColumnRenamed("owner", "eid"), ["path", "eid"], "left")
            .withColumn("shape_type", F.try_element_at(known, F.lower(F.coalesce("declared", "path_type", F.lit("bspline"))))))

    shape, layer = F.col("type") == "Shape", F.col("type") == "Layer"
    wrong = full.select("path", F.when(F.col("parent").isNotNull() & ~F.coalesce(shape | layer, F.lit(False)), "object_type")
                        .when(shape & F.col("counts").isNotNull(), F.when(F.col("widths") > 1, "point_width").when(F.col("counts") > 1, "point_count")
                              .when(F.col("no_frame"), "key_frame").when(F.col("shape_type").isNull(), "shape_type")).alias("code"))
    wrong = wrong.unionByName(keys.where("owner_tag = 'Object' AND property <> 'path' AND frame IS NULL AND size(value) > 0")
                              .select("path", F.lit("key_frame").alias("code"))).where("code IS NOT NULL")
    sized = elements.where("tag = 'Source'").where(_attr("width").isNotNull()).groupBy("path").agg(
        F.max_by(F.expr("struct(try_cast(attrs['width'] AS INT) AS width, try_cast(attrs['height'] AS INT) AS height)"), "eid").alias("s"))
    per_file = (files.join(sized, "path", "left").join(wrong.groupBy("path").agg(F.min("code").alias("code")), "path", "left")
                .withColumn("error", F.coalesce("problem", F.when(F.col("s.width").isNull(), "no_source_size"), "code")))

    session = values.where("owner_tag = 'Session'").groupBy("path").agg(*[
        F.max(F.when(F.col("property") == p, F.try_element_at(_numbers(F.col("text")), F.lit(1)))).alias(n) for n, (p, _, _) in SESSION.items()])
    docs = per_file.where("error IS NULL").join(session, "path", "left").select(
        "path", "container", F.col("s.width").alias("width"), F.col("s.height").alias("height"),
        *[F.coalesce(F.col(n).cast(t), F.lit(d).cast(t)).alias(n) for n, (_, t, d) in SESSION.items()])
    good = docs.select("path")

    # Shapes without an outline are not drawn and take no place among their siblings.
    kept = full.where(layer | (shape & F.col("counts").isNotNull())).join(good, "path", "left_semi")
    place = Window.partitionBy("path", "parent").orderBy("eid")
    kept = kept.withColumn("ordinal", F.row_number().over(place) - 1).withColumn("bare", shape & F.col("parent").isNull())
    steps = kept.select("path", "eid", F.explode(F.concat("above", F.array("eid"))).alias("step")).join(
        kept.select("path", F.col("eid").alias("step"), F.col("ordinal").alias("o")), ["path", "step"])
    named = steps.groupBy("path", "eid").agg(F.expr(
        "array_join(transform(array_sort(collect_list(struct(step, o))), s -> CAST(s.o AS STRING)), '/')").alias("at"))
    kept = kept.join(named, ["path", "eid"]).withColumn("node_id", F.when(F.col("bare"), F.concat("at", F.lit("/0"))).otherwise(F.col("at")))
    none = F.lit(None)
    nodes = kept.select(
        "path", "node_id", F.when(F.col("bare"), F.col("at")).otherwise(F.expr("nullif(regexp_replace(at, '/?[0-9]+$', ''), '')")).alias("parent_id"),
        F.when(F.col("bare"), 0).otherwise(F.col("ordinal")).alias("ordinal"), F.lower("type").alias("kind"), "name", "uuid",
        F.when(shape, F.col("shape_type")).alias("shape_type"), F.when(shape, F.coalesce("closed", F.lit(True))).alias("closed"),
        F.coalesce(F.expr("nullif(trim(mode), '')"), F.lit("Add")).alias("blend"),
        F.coalesce(F.lower(F.trim("invert")) == "true", F.lit(False)).alias("invert"),
        F.when(shape, F.coalesce(F.try_element_at(_numbers(F.col("strokeWidth")), F.lit(1)), F.lit(0.0))).alias("stroke_width"))
    wraps = kept.where("bare").select(
        "path", F.col("at").alias("node_id"), none.cast("string").alias("parent_id"), "ordinal", F.lit("layer").alias("kind"),
        F.format_string("<bare:%s>", "name").alias("name"), none.cast("string").alias("uuid"), none.cast("string").alias("shape_type"),
        none.cast("boolean").alias("closed"), F.lit("Add").alias("blend"), F.lit(False).alias("invert"), none.cast("double").alias("stroke_width"))

    owner = kept.select("path", F.col("eid").alias("owner"), "node_id", "type")
    name = F.when(F.col("property") == "transform.matrix", "matrix").otherwise(F.regexp_replace("property", r"^transform\.", ""))
    lead = F.slice("value", 1, 1)
    numeric = keys.where("owner_tag = 'Object' AND property <> 'path' AND size(value) > 0").join(owner, ["path", "owner"]).withColumn("track", name)
    constant = values.where("owner_tag = 'Object'").join(owner, ["path", "owner"]).withColumn("track", name).select(
        "path", "owner", "node_id", "type", "track", _numbers(F.col("text")).alias("value")).where(F.col("track").isin(*IDENTITY) & (F.size("value") > 0))
    moving = numeric.where(F.col("track").isin(*IDENTITY) & (F.col("type") == "Layer"))
    still = constant.where(F.col("type") == "Layer").join(moving.select("path", "owner", "track").distinct(), ["path", "owner", "track"], "left_anti")
    moving = moving.select("path", "node_id", "track", "frame", "interp", "value").unionByName(
        still.select("path", "node_id", "track", F.lit(0).alias("frame"), F.lit("hold").alias("interp"), "value"))
    only = Window.partitionBy("path", "node_id", "track")
    moving = moving.withColumn("n", F.count(F.lit(1)).over(only)).where(~((F.col("n") == 1) & _near_identity(F.col("track"), F.col("value")))).drop("n")
    simple = numeric.where("track = 'matrix' AND size(value) = 16 AND type = 'Layer'").select("path", "node_id", "track", "frame", "interp", "value").unionByName(
        numeric.where("track = 'opacity' OR (track = 'feather' AND type = 'Shape')").select("path", "node_id", "track", "frame", "interp", lead.alias("value")))
    flat = moving.unionByName(simple).withColumn("n_points", F.lit(1))
    paths = outlines.join(owner.where("type = 'Shape'"), ["path", "owner"]).select(
        "path", "node_id", F.lit("path").alias("track"), "frame", "interp", "value", "n_points")
    every = flat.unionByName(paths).select("path", "node_id", "track", "frame", "interp", "n_points", "value")
    return {"docs": docs, "nodes": nodes.unionByName(wraps), "keys": every,
            "quarantine": per_file.where("error IS NOT NULL").select("path", "error")}
