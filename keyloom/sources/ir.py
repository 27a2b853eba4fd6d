"""Nested JSON documents to long rows and back.

A document is ``{session, layers: [...], schema_version, dialect, ...}``; a layer is ``{label, uuid, mode, invert, matrix, matrix_interp, trs,
opacity, shapes, children, order}`` and a shape ``{label, uuid, mode, invert, shape_type, strokeWidth, path_keys, opacity, feather}``. The
``order`` list restores how shapes and layers interleave. Both directions work level by level, to whatever depth the documents
have: one round a level, each written to reliable storage. A nested document is one row, so it must fit a task.

Every track of a node becomes rows of one shape, ``keys``: (doc_id, node_id, track, ordinal, frame, interp, constant, closed, n_points,
value ARRAY<DOUBLE>). ``track`` is path, opacity, feather, matrix or ``trs.<name>`` (position, scale, rotate, anchor, ...). A constant is a
hold at frame 0; a path's value is its points one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import cut

_LIST = "array<variant>"
NUMBER = r"[-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?"
SESSION = {"width": "int", "height": "int", "startFrame": "int", "duration": "int", "frameRate": "double"}
ABOUT = {"schema_version": "string", "dialect": "string", "source_label": "string", "source_path": "string", "source_file": "string"}
KEYS = ("doc_id", "node_id", "track", "ordinal", "frame", "interp", "constant", "closed", "n_points", "value")


def _get(path: str, kind: str, of: str = "v") -> str:
    return f"try_variant_get({of}, '$.{path}', '{kind}')"


def _numbers(text: str) -> str:
    """All numbers of ``(a,b)``, ``[a, b]`` or a bare ``a``."""
    return f"transform(regexp_extract_all({text}, '({NUMBER})', 1), x -> CAST(x AS DOUBLE))"


def _levels(docs: DataFrame, json: str) -> DataFrame:
    """All nodes of all documents: ids are ordinal paths, ``v`` is the node's own object."""
    parsed = docs.select("doc_id", F.parse_json(json).alias("v"))
    level = parsed.select("doc_id", F.posexplode(F.variant_get("v", "$.layers", _LIST)).alias("ordinal", "v")).select(
        "doc_id", F.col("ordinal").cast("string").alias("node_id"), F.lit(None).cast("string").alias("parent_id"),
        "ordinal", F.lit(0).alias("depth"), F.lit("layer").alias("kind"), "v")
    every = level
    while True:
        inside = level.where("kind = 'layer'").select(
            "doc_id", F.col("node_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"),
            F.expr(f"coalesce({_get('shapes', _LIST)}, array())").alias("s"), F.expr(f"coalesce({_get('children', _LIST)}, array())").alias("c"),
            F.expr(_get("order", "array<array<string>>")).alias("o"))
        # No order recorded: shapes first, then child layers.
        default = ("concat(transform(s, (x, i) -> array('shape', CAST(i AS STRING))), "
                   "transform(c, (x, i) -> array('layer', CAST(i AS STRING))))")
        slots = inside.select("doc_id", "parent_id", "depth", "s", "c", F.posexplode(F.expr(
            f"CASE WHEN size(o) > 0 THEN o ELSE {default} END")).alias("ordinal", "e"))
        level = cut(slots.select(
            "doc_id", F.expr("concat(parent_id, '/', ordinal)").alias("node_id"), "parent_id", "ordinal", "depth",
            F.expr("CASE WHEN e[0] = 'shape' THEN 'shape' ELSE 'layer' END").alias("kind"),
            F.expr("CASE WHEN e[0] = 'shape' THEN s[CAST(e[1] AS INT)] ELSE c[CAST(e[1] AS INT)] END").alias("v")))
        if level.isEmpty():
            return every
        every = every.unionByName(level)


def _simple_keys(tracks: DataFrame) -> DataFrame:
    """Rows (doc_id, node_id, track, t) of constant or keyed scalars and vectors."""
    const = tracks.where(f"{_get('keys', _LIST, 't')} IS NULL").select(
        "doc_id", "node_id", "track", F.lit(0).alias("ordinal"), F.lit(0).alias("frame"), F.lit("hold").alias("interp"),
        F.lit(True).alias("constant"), F.expr(_numbers(_get("const", "string", "t"))).alias("value")).where("size(value) > 0")
    keyed = tracks.select("doc_id", "node_id", "track", F.posexplode(F.expr(_get("keys", _LIST, "t"))).alias("ordinal", "k")).select(
        "doc_id", "node_id", "track", "ordinal", F.expr("variant_get(k, '$[0]', 'int')").alias("frame"),
        F.expr("coalesce(nullif(try_variant_get(k, '$[1]', 'string'), ''), 'linear')").alias("interp"), F.lit(False).alias("constant"),
        F.expr(_numbers("try_variant_get(k, '$[2]', 'string')")).alias("value"))
    return const.unionByName(keyed)


def _matrix_keys(layers: DataFrame) -> DataFrame:
    """Matrices of 16 numbers; their modes lie in a list of their own."""
    const = layers.select("doc_id", "node_id", F.expr(_get("matrix.const", "array<double>")).alias("value")).where("value IS NOT NULL").select(
        "doc_id", "node_id", F.lit("matrix").alias("track"), F.lit(0).alias("ordinal"), F.lit(0).alias("frame"), F.lit("hold").alias("interp"),
        F.lit(True).alias("constant"), "value")
    full = f"filter({_get('matrix.keys', _LIST)}, k -> size(variant_get(k, '$[1]', 'array<double>')) = 16)"
    keyed = layers.select("doc_id", "node_id", F.expr(_get("matrix_interp", "array<string>")).alias("m"), F.posexplode(F.expr(full)).alias("ordinal", "k"))
    return const.unionByName(keyed.select(
        "doc_id", "node_id", F.lit("matrix").alias("track"), "ordinal", F.expr("variant_get(k, '$[0]', 'int')").alias("frame"),
        F.expr("coalesce(get(m, ordinal), 'linear')").alias("interp"), F.lit(False).alias("constant"),
        F.expr("variant_get(k, '$[1]', 'array<double>')").alias("value")))


def flatten_ir(docs: DataFrame, json: str = "json") -> dict[str, DataFrame]:
    """``(doc_id, json)`` to ``docs``, ``nodes``, ``keys`` and, of those, the paths with their points as lists: ``path_keys``."""
    every = _levels(docs, json)
    layer, shape = every.where("kind = 'layer'"), every.where("kind = 'shape'")
    nodes = every.select(
        "doc_id", "node_id", "parent_id", "ordinal", "depth", "kind", F.expr(_get("label", "string")).alias("label"),
        F.expr(f"nullif({_get('uuid', 'string')}, '')").alias("uuid"), F.expr(f"coalesce({_get('mode', 'string')}, 'Add')").alias("mode"),
        F.expr(f"coalesce({_get('invert', 'boolean')}, false)").alias("invert"),
        F.expr(f"CASE WHEN kind = 'shape' THEN coalesce({_get('shape_type', 'string')}, 'Bspline') END").alias("shape_type"),
        F.expr(f"CASE WHEN kind = 'shape' THEN coalesce({_numbers(_get('strokeWidth.const', 'string'))}[0], 0D) END").alias("stroke_width"))
    drawn = shape.select("doc_id", "node_id", F.posexplode(F.expr(_get("path_keys", _LIST))).alias("ordinal", "k")).select(
        "doc_id", "node_id", "ordinal", F.variant_get("k", "$[0]", "int").alias("frame"),
        F.expr("coalesce(nullif(variant_get(k, '$[1]', 'string'), ''), 'linear')").alias("interp"),
        F.variant_get("k", "$[2]", "boolean").alias("closed"), F.variant_get("k", "$[3]", "array<array<array<double>>>").alias("points"))
    tracks = every.select("doc_id", "node_id", F.explode(F.expr(
        f"array(struct('opacity' AS track, {_get('opacity', 'variant')} AS t), struct('feather' AS track, {_get('feather', 'variant')} AS t))")).alias("e")
    ).select("doc_id", "node_id", "e.*").where("t IS NOT NULL AND NOT is_variant_null(t)")
    moving = layer.select("doc_id", "node_id", F.explode(F.expr(_get("trs", "map<string,variant>"))).alias("name", "t")).select(
        "doc_id", "node_id", F.concat(F.lit("trs."), "name").alias("track"), "t").where("t IS NOT NULL AND NOT is_variant_null(t)")
    plain = _simple_keys(tracks.unionByName(moving)).unionByName(_matrix_keys(layer)).select(
        "doc_id", "node_id", "track", "ordinal", "frame", "interp", "constant", F.lit(None).cast("boolean").alias("closed"),
        F.lit(None).cast("int").alias("n_points"), "value")
    paths = drawn.select("doc_id", "node_id", F.lit("path").alias("track"), "ordinal", "frame", "interp", F.lit(False).alias("constant"),
                         "closed", F.size("points").alias("n_points"), F.expr("flatten(flatten(points))").alias("value"))
    parsed = docs.select("doc_id", F.parse_json(json).alias("v"))
    about = parsed.select("doc_id", F.expr("struct(" + ", ".join(f"{_get('session.' + c, k)} AS {c}" for c, k in SESSION.items()) + ")").alias("session"),
                          *[F.expr(_get(c, k)).alias(c) for c, k in ABOUT.items()])
    return {"docs": about, "nodes": nodes, "keys": paths.unionByName(plain),
            "path_keys": drawn.select("doc_id", "node_id", "frame", "interp", "closed", F.col("points").alias("value"))}


def _quoted(text: str) -> str:
    """A string as JSON, ``null`` for none."""
    whole = f"to_json(named_struct('x', {text}))"
    return f"CASE WHEN {text} IS NULL THEN 'null' ELSE substr({whole}, 6, length({whole}) - 6) END"


def _list(of: str) -> str:
    return f"concat('[', array_join({of}, ','), ']')"


def _vector(of: str) -> str:
    """A key's value as JSON text: a string, bare for one number and in parentheses for more."""
    return f"""concat('"', CASE WHEN size({of}) = 1 THEN CAST({of}[0] AS STRING) ELSE concat('(', array_join(transform({of}, x -> CAST(x AS STRING)), ','), ')') END, '"')"""


def _track_fields(keys: DataFrame) -> DataFrame:
    """(doc_id, node_id, fields): the JSON fields that a node's keys make, each ending in a comma."""
    per = keys.groupBy("doc_id", "node_id", "track").agg(F.expr(
        "array_sort(collect_list(struct(ordinal, frame, interp, constant, closed, n_points, value))) AS ks"))
    numbers = lambda of: _list(f"transform({of}, x -> CAST(x AS STRING))")
    pairs = "transform(sequence(0, size(k.value) div 2 - 1), i -> concat('[', k.value[2 * i], ',', k.value[2 * i + 1], ']'))"
    # A point is one pair, or several: its own coordinates and those of its handles.
    point = f"transform(sequence(0, k.n_points - 1), p -> {_list(f'slice({pairs}, p * (size(k.value) div 2 div k.n_points) + 1, size(k.value) div 2 div k.n_points)')})"
    path = _list(f"transform(ks, k -> concat('[', k.frame, ',', {_quoted('k.interp')}, ',', coalesce(k.closed, true), ',', "
                 f"CASE WHEN k.n_points > 0 THEN {_list(point)} ELSE '[]' END, ']'))")
    matrix = f"""CASE WHEN ks[0].constant THEN concat('{{"const":', {numbers('ks[0].value')}, '}}') ELSE concat('{{"keys":', {
        _list(f"transform(ks, k -> concat('[', k.frame, ',', {numbers('k.value')}, ']'))")}, '}}') END"""
    modes = f"""CASE WHEN NOT ks[0].constant AND exists(ks, k -> k.interp <> 'linear') THEN concat(',"matrix_interp":', {
        _list('transform(ks, k -> ' + _quoted('k.interp') + ')')}) ELSE '' END"""
    plain = f"""CASE WHEN ks[0].constant THEN concat('{{"const":', {_vector('ks[0].value')}, '}}') ELSE concat('{{"keys":', {
        _list(f"transform(ks, k -> concat('[', k.frame, ',', {_quoted('k.interp')}, ',', {_vector('k.value')}, ']'))")}, '}}') END"""
    text = per.select("doc_id", "node_id", "track", F.expr(
        f"CASE WHEN track = 'path' THEN {path} WHEN track = 'matrix' THEN concat({matrix}, {modes}) ELSE {plain} END").alias("j"))
    grouped = text.groupBy("doc_id", "node_id").agg(F.expr("array_sort(collect_list(struct(track, j))) AS ts"))
    named = "transform(filter(ts, t -> NOT startswith(t.track, 'trs.')), t -> concat('\"', CASE WHEN t.track = 'path' THEN 'path_keys' ELSE t.track END, '\":', t.j, ','))"
    trs = f"transform(filter(ts, t -> startswith(t.track, 'trs.')), t -> concat({_quoted('substr(t.track, 5)')}, ':', t.j))"
    return grouped.select("doc_id", "node_id", F.expr("exists(ts, t -> t.track = 'path')").alias("has_path"), F.expr(
        f"concat(array_join({named}, ''), CASE WHEN exists(ts, t -> startswith(t.track, 'trs.')) THEN concat('\"trs\":{{', array_join({trs}, ','), '}},') ELSE '' END)"
    ).alias("fields"))


def _as_keys(path_keys: DataFrame) -> DataFrame:
    """Paths given with their points as lists, as rows of ``keys``; in order of frame."""
    return path_keys.select(
        "doc_id", "node_id", F.lit("path").alias("track"), F.col("frame").alias("ordinal"), "frame", "interp", F.lit(False).alias("constant"), "closed",
        F.size("value").alias("n_points"), F.expr("flatten(flatten(value))").alias("value"))


def nest_ir(docs: DataFrame, nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Long rows back to one JSON document per ``doc_id``, deepest level first. ``keys`` may also be ``path_keys``."""
    keys = keys if "track" in keys.columns else _as_keys(keys)
    have = set(nodes.columns)
    text = (f"concat('\"label\":', {_quoted('label')}, ',\"uuid\":', {_quoted('coalesce(uuid, \"\")')}, "
            f"',\"mode\":', {_quoted('mode')}, ',\"invert\":', invert, ',')")
    own = [f"concat('\"shape_type\":', {_quoted('shape_type')}, ',')"] if "shape_type" in have else []
    own += ["concat('\"strokeWidth\":{\"const\":\"', coalesce(stroke_width, 0D), '\"},')"] if "stroke_width" in have else []
    drawn = f"concat({', '.join([*own, chr(39) * 2])})"
    full = cut(nodes.join(_track_fields(keys), ["doc_id", "node_id"], "left").withColumn("fields", F.expr("coalesce(fields, '')")))
    deepest = full.agg(F.max("depth")).first()[0]
    if deepest is None:
        raise ValueError("no nodes")
    done = None
    for d in range(deepest, -1, -1):
        at = full.where(F.col("depth") == d)
        paths = "CASE WHEN has_path THEN '' ELSE '\"path_keys\":[],' END"
        sh = at.where("kind = 'shape'").select("doc_id", "parent_id", "ordinal", "kind", F.expr(
            f"concat('{{', rtrim(',', concat({text}, {drawn}, fields, {paths})), '}}') AS j"))
        ly = at.where("kind = 'layer'")
        if done is None:
            ly = ly.withColumn("kids", F.lit(None).cast("array<struct<ordinal:int,kind:string,j:string>>"))
        else:
            kids = done.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.expr(
                "array_sort(collect_list(struct(ordinal, kind, j))) AS kids"))
            ly = ly.join(kids, ["doc_id", "node_id"], "left")
        ly = ly.withColumn("kids", F.expr("coalesce(kids, array())"))
        part = lambda k: _list(f"transform(filter(kids, e -> e.kind = '{k}'), e -> e.j)")
        order = _list("transform(kids, (e, i) -> concat('[\"', e.kind, '\",', size(filter(slice(kids, 1, i), p -> p.kind = e.kind)), ']'))")
        ly = ly.select("doc_id", "parent_id", "ordinal", "kind", F.expr(
            f"concat('{{', {text}, fields, '\"shapes\":', {part('shape')}, ',\"children\":', {part('layer')}, ',\"order\":', {order}, '}}') AS j"))
        done = sh.unionByName(ly)
    roots = done.groupBy("doc_id").agg(F.expr(
        "array_join(transform(array_sort(collect_list(struct(ordinal, j))), e -> e.j), ',') AS layers"))
    return docs.join(roots, "doc_id", "left").select("doc_id", F.concat(
        F.lit('{"session":'), _session(docs), *_about(docs), F.expr("concat(',\"layers\":[', coalesce(layers, ''), ']}')")).alias("json"))


def _session(docs: DataFrame) -> Column:
    """A session given as JSON text is taken as it is."""
    return F.col("session") if dict(docs.dtypes)["session"] == "string" else F.to_json("session")


def _about(docs: DataFrame) -> list[Column]:
    return [F.expr(f"concat(',\"{c}\":', {_quoted(c)})") for c in ABOUT if c in docs.columns]
