"""Held-out splits, class balance and batch sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expr import hashed
from ..functions.lineage import cut
from ..functions.ordered import chunk_id, last_known, lookup, positions, range_chunks, running_sum, stencil, with_totals

DEFAULT_HOLDOUT_EVERY = 7
SAMPLING_MODES = ("random", "pairs", "runs")
HELD_RULE = "{n} > 1 AND {t} > 2 AND {p} % {n} = {n} div 2 AND {p} > 0 AND {p} < {t} - 1"


def frame_split(frames: DataFrame, by: Sequence[str], every: int = DEFAULT_HOLDOUT_EVERY,
                position: str = "frame") -> DataFrame:
    """``held`` per position: the middle of each period, never the first or last frame.

    ``position`` is the dense 0-based position; the group's length is attached per chunk.
    """
    sized = with_totals(frames, by, {"_t": ("count", F.lit(1))}, chunk_id(position))
    rule = HELD_RULE.format(n=every, t="_t", p=position)
    return sized.select(*frames.columns, F.expr(rule).alias("held"))


def require_known(wanted: Sequence[str], table: DataFrame, column: str, what: str) -> None:
    """Refuse unknown names, listing them sorted. ``wanted`` is a short caller-given list."""
    if not wanted:
        return
    found = {r[0] for r in table.where(F.col(column).isin(*wanted)).select(column).distinct()
             .take(len(set(wanted)))}
    missing = sorted(set(wanted) - found)
    if missing:
        raise ValueError(f"{what} not in the dataset: {missing}")


def build_splits(elements: DataFrame, held_shots: Sequence[str] = (),
                 held_elements: Sequence[str] = (), every: int = DEFAULT_HOLDOUT_EVERY) -> DataFrame:
    """Per element ``(element_id, shot, n_frames)``: membership, reasons and frame counts."""
    require_known(held_shots, elements, "shot", "held shots")
    require_known(held_elements, elements, "element_id", "held elements")
    by_shot = F.col("shot").isin(*held_shots) if held_shots else F.lit(False)
    by_name = F.col("element_id").isin(*held_elements) if held_elements else F.lit(False)
    why = F.array_compact(F.array(F.when(by_shot, F.concat(F.lit("shot "), "shot")),
                                  F.when(by_name, F.lit("element"))))
    # Held positions are n//2, n//2 + n, ... strictly inside (0, T-1).
    half = every // 2
    held = (F.expr(f"CASE WHEN n_frames > 2 AND n_frames - 2 >= {half} THEN "
                   f"(n_frames - 2 - {half}) div {every} + 1 - {1 if half == 0 else 0} ELSE 0 END")
            if every > 1 else F.lit(0))
    out = elements.select("element_id", "shot", "n_frames", why.alias("held_because"),
                          held.cast("long").alias("frames_held"))
    return out.select("element_id", "shot", "n_frames", (F.size("held_because") == 0).alias("in_train"),
                      "held_because", (F.col("n_frames") - F.col("frames_held")).alias("frames_train"),
                      "frames_held")


def effective_split(frames: DataFrame, recorded: DataFrame, by: Sequence[str],
                    every: int = DEFAULT_HOLDOUT_EVERY) -> DataFrame:
    """The recorded role when there is one, else the rule."""
    ruled = frame_split(frames, by, every).withColumnRenamed("held", "_rule")
    stored = recorded.select(*by, "frame", F.col("held").alias("_stored"))
    return ruled.join(stored, [*by, "frame"], "left").select(
        *frames.columns, F.coalesce("_stored", "_rule").alias("held"),
        F.when(F.col("_stored").isNull(), "rule").otherwise("recorded").alias("source"))


def positive_rate(cells: DataFrame, by: Sequence[str], hit: str, base: str = "true") -> DataFrame:
    """Rate per group and overall (null group): hits on base cells / base cells."""
    return cells.rollup(*by).agg(
        F.expr(f"count_if({base}) AS base_cells"), F.expr(f"count_if(({base}) AND ({hit})) AS hits"),
        F.expr(f"coalesce(try_divide(count_if(({base}) AND ({hit})), count_if({base})), 0D) AS rate"))


def slot_rate(cells: DataFrame, by: Sequence[str], live: str, n_slots: int) -> DataFrame:
    """Live rate when every element has ``n_slots`` shared slots: denominator frames x slots."""
    per = cells.groupBy(*by, "frame").agg(F.expr(f"count_if({live}) AS n"))
    return per.groupBy(*by).agg(F.expr("sum(n) AS hits"),
                                F.expr(f"count(1) * {n_slots} AS base_cells")).withColumn(
        "rate", F.expr("hits / base_cells"))


def positive_weight(rates: DataFrame, rate: str = "rate") -> DataFrame:
    """``(1 - r) / r``, pinned to 1 where only one class exists."""
    return rates.withColumn("pos_weight", F.expr(
        f"CASE WHEN {rate} > 0 AND {rate} < 1 THEN (1 - {rate}) / {rate} ELSE 1D END"))


def element_weight(elements: DataFrame, mode: str) -> DataFrame:
    """Sampling weight per element, normalised to sum to one."""
    if mode not in ("sqrt", "frames"):
        raise ValueError(f"unknown sample_weight {mode!r}")
    raw = "sqrt(n_frames * n_shapes)" if mode == "sqrt" else "CAST(n_frames AS DOUBLE)"
    sized = elements.withColumn("_w", F.expr(raw))
    total = sized.agg(F.sum("_w").alias("_total"))
    return sized.crossJoin(F.broadcast(total)).select(
        *elements.columns, F.expr("_w / _total").alias("weight"))


TICKS = 1 << 52
"""The whole of all weights, in whole numbers, so that pick ranges meet without gaps."""


def block_offsets(elements: DataFrame, order: str = "element_id") -> DataFrame:
    """Exclusive running sums in the order of a unique key of any type: where each element's block of shapes and groups starts."""
    keyed = range_chunks(cut(elements).withColumn("_all", F.lit(0)), [order])
    out = running_sum(keyed, ["_all"], [order], F.col("_range"),
                      {"shape_base": F.col("n_shapes"), "group_base": F.col("n_groups")}, inclusive=False)
    return out.drop("_all", "_range")


def cumulative_weights(elements: DataFrame) -> DataFrame:
    """Half-open pick ranges ``[lo, hi)`` over 0 .. ``TICKS`` in element order; without those that weigh nothing."""
    ticks = elements.select("element_id", "n_frames", F.round(F.col("weight") * TICKS).cast("long").alias("_w"), F.lit(0).alias("_all"))
    out = running_sum(range_chunks(cut(ticks.where("_w > 0")), ["element_id"]), ["_all"], ["element_id"], F.col("_range"), {"hi": F.col("_w")})
    return out.select("element_id", "n_frames", (F.col("hi") - F.col("_w")).alias("lo"), "hi")


def weighted_picks(steps: DataFrame, lanes: DataFrame, seed: int) -> DataFrame:
    """``(step, own)``: for every step the columns of the lane whose range holds the step's draw.

    Draws and lanes are merged on one axis, cut where the rows are, and each draw looks back to the last lane before it; so
    neither a heavy lane nor many light ones make a large group.
    """
    own = F.struct(*lanes.columns)
    # A draw beyond the last range, by rounding, belongs to it.
    marks = lanes.select((F.col("lo") * 2).alias("at"), own.alias("own"), F.lit(None).cast(steps.schema["step"].dataType).alias("step"))
    asks = steps.select((hashed(seed, "step") * 2 + 1).alias("at"), F.lit(None).cast(marks.schema["own"].dataType).alias("own"), "step")
    axis = range_chunks(marks.unionByName(asks).withColumn("_all", F.lit(0)), ["at"])
    return last_known(axis, ["_all"], "at", {"_own": F.col("own")}, keep=["step"], chunk=F.col("_range")).where(
        "step IS NOT NULL").select("step", F.col("_own").alias("own"))


def batch_schedule(steps: DataFrame, elements: DataFrame, frames: DataFrame, batch: int,
                   mode: str, seed: int) -> DataFrame:
    """``(step, element_id, frame)``: one weighted element per step, then ``batch`` positions.

    Draws are hashes that any engine can compute. ``frames`` holds the training pool with a dense ``pos`` per
    element, so picking positions is arithmetic on the pool size and then an equi-join, never a scan of the pool per
    step. ``random`` draws distinct positions, every subset of the pool alike; ``pairs``
    anchors on positions whose successor frame is also kept; ``runs`` takes one contiguous run.
    """
    if mode not in SAMPLING_MODES:
        raise ValueError(f"unknown sampling mode {mode!r}, want one of {SAMPLING_MODES}")
    if batch < 1:
        raise ValueError("batch must be positive")
    pool = frames.select("element_id", "frame", "pos")
    sizes = pool.groupBy("element_id").agg(F.expr("count(1) AS n"))
    if mode == "pairs":
        nxt = stencil(pool, ["element_id"], "pos", {"_n": lambda w: F.lead("frame").over(w)}, 1)
        anchors = nxt.where("_n = frame + 1").select("element_id", "frame", "pos")
        anchors = positions(anchors, ["element_id"], ["pos"], chunk_id("pos"), "apos")
        a_size = anchors.groupBy("element_id").agg(F.expr("count(1) AS a_n"))
        sizes = sizes.join(a_size, "element_id", "left").na.fill(0, ["a_n"]).withColumn("_pairs", F.expr("n > 2 AND a_n > 0"))
    else:
        sizes = sizes.select("*", F.lit(0).alias("a_n"), F.lit(False).alias("_pairs"))
    # Pool sizes travel with the pick ranges, so an often-picked element needs no join by element. Elements are written
    # once, as their order and ranges read them several times.
    lanes = cut(cumulative_weights(elements).join(sizes, "element_id").select("lo", "element_id", "n", "a_n", "_pairs"))
    sched = weighted_picks(steps, lanes, seed).select("step", "own.element_id", "own.n", "own.a_n", "own._pairs")
    contiguous = F.expr("n > 2") if mode == "runs" else F.lit(False)
    sched = sched.select(
        "*", contiguous.alias("_run"), F.expr("CASE WHEN _pairs THEN a_n ELSE n END").alias("m"),
        F.expr(f"CASE WHEN _pairs THEN least(greatest(1, {batch} div 2), a_n) ELSE least({batch}, n) END")
        .alias("k"))
    # Distinct draws by Floyd's rule: for j = m - k .. m - 1 take a hashed position of 0..j, or j itself if that was
    # taken, so that every k-subset is equally likely; a run is a hashed start that keeps it inside the pool.
    def draw(*key: str) -> str:
        text = ", ".join(f"CAST({k} AS STRING)" for k in (str(seed), *key))
        return f"CAST(conv(substr(md5(concat_ws(':', {text})), 1, 13), 16, 10) AS BIGINT)"
    own = f"({draw(chr(39) + 'draw' + chr(39), 'step', 'j')} % (j + 1))"
    sched = sched.withColumn("_pos", F.expr(
        f"CASE WHEN _run THEN transform(sequence(0L, k - 1L), i -> {draw(chr(39) + 'start' + chr(39), 'step')} % (m - k + 1) + i) ELSE "
        f"aggregate(sequence(CAST(m - k AS BIGINT), CAST(m - 1 AS BIGINT)), CAST(array() AS ARRAY<BIGINT>), (acc, j) -> "
        f"array_append(acc, CASE WHEN array_contains(acc, {own}) THEN j ELSE {own} END)) END"))
    drawn = sched.select("step", "element_id", "_pairs", F.explode("_pos").alias("pos"))
    plain = drawn.where("NOT _pairs").join(pool, ["element_id", "pos"]).select(
        "step", "element_id", "frame")
    if mode != "pairs":
        return plain
    paired = drawn.where("_pairs").withColumnRenamed("pos", "apos").join(
        anchors, ["element_id", "apos"]).select(
        "step", "element_id", F.explode(F.expr("array(frame, frame + 1)")).alias("frame"))
    return plain.unionByName(paired)


def training_rows(schedule: DataFrame, cells: DataFrame, elements: DataFrame, n_slots: int
                  ) -> DataFrame:
    """One row per (step, element, frame, slot): real shapes then padding up to ``n_slots``.

    ``cells`` carries ``(element_id, frame, slot, live, is_key)``. A bank narrower than the
    widest element is an error, checked by one aggregate.
    """
    widest = elements.agg(F.max("n_shapes")).first()[0]
    if n_slots < (widest or 0):
        raise ValueError(f"n_slots {n_slots} is below the widest element ({widest} shapes)")
    wide = lookup(schedule, elements.select("element_id", "n_shapes"), ["element_id"], ["step"]).select(
        "step", "element_id", "frame", (F.col("n_shapes")).alias("_n"),
        F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))).alias("slot"))
    no = F.lit(False)
    return wide.join(cells.select("element_id", "frame", "slot", "live", "is_key"),
                     ["element_id", "frame", "slot"], "left").select(
        "step", "element_id", "frame", "slot", F.coalesce("live", no).alias("live"),
        F.coalesce("is_key", no).alias("is_key"), (F.col("slot") < F.col("_n")).alias("exists"))


def training_targets(schedule: DataFrame, cells: DataFrame, points: DataFrame, shapes: DataFrame, elements: DataFrame,
                     n_slots: int = 0, width: int = 0) -> DataFrame:
    """The targets of every scheduled frame, one row per (step, element, frame, slot), ragged parts as arrays.

    ``cells`` (element_id, frame, slot, live, is_key), ``points`` (element_id, frame, slot, point_idx, x, y), ``shapes``
    (element_id, slot, point_count, descriptor ARRAY<DOUBLE>) and ``elements`` (element_id, n_shapes, shape_base) meet the schedule on
    their own keys, so no element is gathered: the largest group is one outline at one frame.

    With a bank of ``n_slots`` shared slots, rows are padded up to it, a slot's query is its number, and only ``live`` has
    something to say about padding (False). Without one every element has its own ``n_shapes`` slots and a shape's query is
    ``shape_base + slot``. ``outline`` is x0, y0, x1, ... in point order; with ``width`` it is padded with zeros to that many points and
    ``point_mask`` tells the real ones. A bank or width that is too narrow is an error when read.
    """
    size = lookup(schedule, elements.select("element_id", "n_shapes", "shape_base"), ["element_id"], ["step"])
    last = F.lit(n_slots) if n_slots else F.col("n_shapes")
    fits = F.when(F.col("n_shapes") <= last, last).otherwise(F.raise_error(F.concat(
        F.lit(f"n_slots {n_slots} is below the shapes of "), F.col("element_id").cast("string"))).cast("int"))
    wide = size.select("step", "element_id", "frame", "n_shapes", "shape_base", F.explode(F.sequence(F.lit(0), fits.cast("int") - 1)).alias("slot"))
    wide = wide.where(F.col("n_shapes") > 0) if not n_slots else wide
    drawn = points.groupBy("element_id", "frame", "slot").agg(F.array_sort(F.collect_list(F.struct("point_idx", "x", "y"))).alias("_p"))
    outline = drawn.select("element_id", "frame", "slot", F.flatten(F.transform("_p", lambda p: F.array(p.x, p.y))).alias("outline"))
    rows = (wide.join(cells.select("element_id", "frame", "slot", "live", "is_key"), ["element_id", "frame", "slot"], "left")
            .join(outline, ["element_id", "frame", "slot"], "left"))
    rows = lookup(rows, shapes.select("element_id", "slot", "point_count", "descriptor"), ["element_id", "slot"], ["step"], "left")
    no, real = F.lit(False), F.col("slot") < F.col("n_shapes")
    flat, n = F.coalesce("outline", F.array().cast("array<double>")), F.coalesce("point_count", F.lit(0)).cast("int")
    if width:
        few = F.when(n <= width, n).otherwise(F.raise_error(F.lit(f"width {width} is below the points of a shape")).cast("int"))
        flat = F.concat(flat, F.array_repeat(F.lit(0.0), F.lit(2 * width) - F.size(flat)))
        mask = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i < few)
    else:
        mask = F.array_repeat(F.lit(True), n)
    return rows.select(
        "step", "element_id", "frame", "slot", (F.col("slot") if n_slots else F.col("shape_base") + F.col("slot")).cast("long").alias("query"),
        real.alias("exists"), F.coalesce(F.col("live") & real, no).alias("live"), F.coalesce("is_key", no).alias("is_key"),
        F.when(real, F.col("point_count")).alias("point_count"), F.when(real, F.col("descriptor")).alias("descriptor"),
        F.when(real, flat).alias("outline"), F.when(real, mask).alias("point_mask"))


def group_targets(schedule: DataFrame, groups: DataFrame, elements: DataFrame) -> DataFrame:
    """The group side of a scheduled frame: ``groups`` (element_id, frame, group, transform, live) with each group's query."""
    based = lookup(schedule, elements.select("element_id", "group_base"), ["element_id"], ["step"])
    return based.join(groups, ["element_id", "frame"]).select(
        "step", "element_id", "frame", "group", (F.col("group_base") + F.col("group")).cast("long").alias("query"), "transform", "live")
