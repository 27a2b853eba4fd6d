"""Quality gates, provenance and run tracking."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from itertools import count

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import cut
from ..functions.ordered import chunk_id, positions, with_totals

MATCH_MIN = 0.50
AMBIGUOUS_MARGIN = 0.05
MIN_EVIDENCE = 2
EMPTY_MAX = 1e-6
MIN_MATTE_PX = 16

# Fixed vocabularies.
ENVIRONMENTS = ("local", "staging")
RUN_STATUSES = ("pending", "running", "completed", "failed", "stopped")
TERMINAL_STATUSES = ("completed", "failed", "stopped")
ENV_VAR = "KEYLOOM_ENVIRONMENT"
NAMED = 100
"""Names in an error text; the rest is counted."""


def pair_scores(elements: DataFrame, channels: DataFrame, area: int) -> DataFrame:
    """Mean soft IoU and evidence per (shot, element, channel).

    Inputs are sparse pixels ``(shot, frame, element_id | channel, y, x, cov)``. Only frames both
    sides draw on count. ``max + min = a + b``, so the union needs per-frame totals only and
    pixels meet in an inner join.
    """
    def totals(px, name, out):
        return px.groupBy("shot", "frame", name).agg(F.sum("cov").alias(out)).where(
            F.col(out) / area > EMPTY_MAX)
    te, tc = totals(elements, "element_id", "_a"), totals(channels, "channel", "_b")
    e = elements.select("shot", "frame", "element_id", "y", "x", F.col("cov").alias("a"))
    c = channels.select("shot", "frame", "channel", "y", "x", F.col("cov").alias("b"))
    inter = e.join(c, ["shot", "frame", "y", "x"]).groupBy("shot", "frame", "element_id", "channel").agg(
        F.expr("sum(least(a, b)) AS _i"))
    both = te.join(tc, ["shot", "frame"]).join(inter, ["shot", "frame", "element_id", "channel"], "left")
    per_frame = both.select("shot", "element_id", "channel", F.expr(
        "coalesce(_i, 0D) / (_a + _b - coalesce(_i, 0D)) AS s"))
    return per_frame.groupBy("shot", "element_id", "channel").agg(
        F.expr("round(avg(s), 9) AS score"), F.expr("count(1) AS evidence"))


def pair_elements(scores: DataFrame, elements: DataFrame, usable: DataFrame | None = None) -> DataFrame:
    """Best viable channel per element with its grade and reason.

    Fewer than two evidence frames is not viable; a best score under 0.50 is unmatched. With ``usable`` (shot, matte), the
    mattes that passed ``usable_inputs``, an element of a shot that has none is told so.
    """
    if usable is not None:
        have = usable.select("shot").distinct()
        none = elements.select("shot", "element_id").join(have, "shot", "left_anti")
        return pair_elements(scores, elements.join(have, "shot", "left_semi")).unionByName(none.select(
            "shot", "element_id", F.lit(None).cast("string").alias("channel"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("evidence"),
            F.lit("silver").alias("grade"), F.lit("no matte of this shot can be used").alias("reason")))
    viable = f"evidence >= {MIN_EVIDENCE}"
    best = scores.groupBy("shot", "element_id").agg(
        F.expr(f"min_by(struct(channel, score, evidence), struct(-score, channel)) FILTER (WHERE {viable}) AS v"),
        F.expr("max(struct(score, evidence)) AS a"))
    out = elements.select("shot", "element_id").join(best, ["shot", "element_id"], "left")
    ok = f"v IS NOT NULL AND v.score >= {MATCH_MIN}"
    return out.select(
        "shot", "element_id", F.expr(f"CASE WHEN {ok} THEN v.channel END AS channel"),
        F.expr("coalesce(v.score, a.score, 0D) AS score"), F.expr("coalesce(v.evidence, a.evidence, 0L) AS evidence"),
        F.expr(f"CASE WHEN {ok} THEN 'gold' ELSE 'silver' END AS grade"),
        F.expr(f"CASE WHEN v IS NULL THEN 'no channel with >= {MIN_EVIDENCE} evidence frames' WHEN NOT ({ok}) THEN "
               f"concat('unmatched: best ', format_string('%.4f', v.score), ' < {MATCH_MIN}') END AS reason"))


def resolve_claims(pairings: DataFrame, channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pairings, findings)`` after several elements claimed one channel.

    The winner is the best score. A margin under 0.05 is ambiguous: the winner keeps the channel
    but is graded silver and the shot fails. Losers lose the channel. Present channels nobody
    claimed are orphans. Claims per channel are at most the elements of one shot.
    """
    w = Window.partitionBy("shot", "channel").orderBy(F.desc("score"), "element_id")
    every = Window.partitionBy("shot", "channel")
    c = pairings.where("channel IS NOT NULL").select(
        "*", F.row_number().over(w).alias("_r"), F.lead("score").over(w).alias("_next"),
        F.count(F.lit(1)).over(every).alias("_n"),
        F.first("element_id").over(every.orderBy(F.desc("score"), "element_id")
                                   .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_winner"))
    c = c.withColumn("_margin", F.max(F.expr("CASE WHEN _r = 1 THEN score - _next END")).over(every))
    c = c.withColumn("_kind", F.expr(
        f"CASE WHEN _n < 2 THEN 'single' WHEN round(_margin, 9) < {AMBIGUOUS_MARGIN} THEN 'ambiguous' ELSE 'collision' END"))
    by = "format_string('%.4f', _margin)"
    settled = c.select(
        "shot", "element_id", F.expr("CASE WHEN _r = 1 THEN channel END AS channel"), "score", "evidence",
        F.expr("CASE WHEN _r > 1 OR _kind = 'ambiguous' THEN 'silver' ELSE grade END AS grade"),
        F.expr(f"CASE WHEN _r > 1 THEN concat('lost ', channel, ' to ', _winner, ' by ', {by}) "
               "WHEN _kind = 'ambiguous' THEN concat('ambiguous claim on ', channel) ELSE reason END AS reason"))
    final = settled.unionByName(pairings.where("channel IS NULL").select(settled.columns))
    claims = c.where("_r = 1 AND _n > 1").select(
        "shot", F.col("_kind").alias("kind"), F.col("channel").alias("subject"),
        F.expr(f"concat(_winner, ' wins by ', {by}) AS detail"))
    orphans = channels.select("shot", "channel").distinct().join(
        pairings.where("channel IS NOT NULL").select("shot", "channel").distinct(), ["shot", "channel"], "left_anti").select(
        "shot", F.lit("orphan").alias("kind"), F.col("channel").alias("subject"), F.lit("claimed by no element").alias("detail"))
    unmatched = final.where("grade = 'silver' AND reason IS NOT NULL").select(
        "shot", F.lit("unmatched").alias("kind"), F.col("element_id").cast("string").alias("subject"),
        F.expr("concat('best ', format_string('%.4f', score), ' on ', evidence, 'f') AS detail"))
    return final, claims.unionByName(orphans).unionByName(unmatched)


def usable_inputs(frames: DataFrame, docs: DataFrame) -> DataFrame:
    """Judge each sequence on its middle frame against the document's raster.

    ``frames`` (shot, matte, frame, width, height; null width = unreadable). The middle row is
    position ``n div 2`` in frame order.
    """
    by = ["shot", "matte"]
    p = positions(frames, by, ["frame"], chunk_id("frame"), "_pos")
    p = with_totals(p, by, {"_n": ("count", F.lit(1))}, chunk_id("frame")).where("_pos = _n div 2")
    p = p.join(docs.selectExpr("shot", "width AS dw", "height AS dh"), "shot", "left")
    return p.select("shot", "matte", F.expr(
        f"CASE WHEN width IS NULL THEN 'unreadable' WHEN least(width, height) < {MIN_MATTE_PX} THEN 'degenerate' "
        "WHEN width <> dw OR height <> dh THEN 'resolution' END AS finding")).withColumn(
        "usable", F.col("finding").isNull())


def apply_gate(elements: DataFrame, findings: DataFrame, gates: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(kept, skipped)``: elements of shots with an ambiguous claim are skipped when gating."""
    failed = findings.where("kind = 'ambiguous'").select("shot").distinct()
    if not gates:
        return elements, elements.join(failed, "shot", "left_semi").where("false").withColumn("why", F.lit(None).cast("string"))
    return (elements.join(failed, "shot", "left_anti"),
            elements.join(failed, "shot", "left_semi").withColumn("why", F.lit("shot failed pairing QC")))


def ledger_row(df: DataFrame, item: str, requirement: str, measured: str, passed: str) -> DataFrame:
    """One pass/fail row from one aggregate over ``df``. Nothing measured is RED, not green."""
    return df.groupBy().agg(F.expr(f"CAST({measured} AS DOUBLE) AS measured"), F.expr(f"{passed} AS _ok")).select(
        F.lit(item).alias("item"), F.lit(requirement).alias("requirement"), "measured",
        F.expr("CASE WHEN coalesce(_ok, false) THEN 'GREEN' ELSE 'RED' END AS status"))


def check_topology(keys: DataFrame) -> DataFrame:
    """Point count is fixed across a shape's keys."""
    per = keys.groupBy("shape_id").agg(F.expr("count(DISTINCT n_points) AS n"))
    return ledger_row(per, "fixed topology", "one point count per shape", "count_if(n > 1)", "count_if(n > 1) = 0")


def check_enum(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    names = ", ".join(f"'{a}'" for a in allowed)
    return ledger_row(df, f"{column} vocabulary", f"in ({', '.join(allowed)})", f"count_if({column} NOT IN ({names}))",
                      f"count_if({column} NOT IN ({names})) = 0")


def check_range(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    bad = f"count_if({column} < {lo} OR {column} > {hi})"
    return ledger_row(df, f"{column} range", f"{lo} to {hi}", bad, f"{bad} = 0")


def check_unique(df: DataFrame, key: Sequence[str], item: str) -> DataFrame:
    per = df.groupBy(*key).agg(F.expr("count(1) AS n"))
    return ledger_row(per, item, "one row per key", "count_if(n > 1)", "count_if(n > 1) = 0")


def check_split(split: DataFrame, n_frames: DataFrame) -> DataFrame:
    """Train and held frames are disjoint and sum to the element's frames; held shots whole."""
    per = split.groupBy("element_id").agg(
        F.expr("count(DISTINCT frame) AS frames"), F.expr("count(1) AS rows")).join(n_frames, "element_id", "full")
    bad = "count_if(frames IS NULL OR n_frames IS NULL OR rows <> frames OR frames <> n_frames)"
    return ledger_row(per, "split record", "disjoint, complete", bad, f"{bad} = 0")


def check_held_shots(elements: DataFrame) -> DataFrame:
    per = elements.where("held_shot").groupBy("shot").agg(F.expr("count_if(in_train) AS leaks"))
    return ledger_row(per, "held shots", "fully withheld", "coalesce(sum(leaks), 0)", "coalesce(sum(leaks), 0) = 0")


def check_frames(frames: DataFrame, expected: DataFrame) -> DataFrame:
    """Every element has every frame from its first to its last."""
    per = frames.groupBy("element_id").agg(F.expr("count(DISTINCT frame) AS n")).join(expected, "element_id", "full")
    bad = "count_if(n IS NULL OR n_frames IS NULL OR n <> n_frames)"
    return ledger_row(per, "frame completeness", "no frame missing", bad, f"{bad} = 0")


def check_self_score(scores: DataFrame) -> DataFrame:
    return ledger_row(scores, "scoring ceiling", "self score 1.0", "min(soft_iou)", "min(soft_iou) = 1.0")


def check_quantised(pixels: DataFrame) -> DataFrame:
    err = "max(abs(cov - bround(cov * 65535) / 65535))"
    return ledger_row(pixels, "quantisation", "round trip within half a level", err, f"{err} <= {0.5 / 65535}")


def check_pairing(findings: DataFrame) -> DataFrame:
    return ledger_row(findings, "pairing QC", "no ambiguous claim", "count_if(kind = 'ambiguous')",
                      "count_if(kind = 'ambiguous') = 0")


def check_round_trip(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """Documents read again after being written are the same, in every table and column."""
    bad = None
    for name, table in before.items():
        own = table_difference(table, after[name].select(*table.columns)).select(key)
        bad = own if bad is None else bad.unionByName(own)
    one = next(iter(before.values())).select(key).distinct().join(bad.distinct().withColumn("_bad", F.lit(True)), key, "left")
    return ledger_row(one, "round trip", "read(write(document)) is the document", "count_if(_bad)", "count_if(_bad) = 0")


def check_conventions(meta: DataFrame, sets: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Recorded flags must equal the named set's; a missing field is tolerated; one set per dataset."""
    s = sets.select("convention", *[F.col(f).alias(f"_{f}") for f in flags], F.lit(True).alias("_known"))
    j = meta.join(F.broadcast(s), "convention", "left")
    off = " OR ".join(f"({f} IS NOT NULL AND NOT {f} <=> _{f})" for f in flags)
    bad = f"count_if(_known IS NULL OR {off})"
    return ledger_row(j, "render conventions", "one named set, flags agree", f"{bad} + count(DISTINCT convention) - 1",
                      f"{bad} = 0 AND count(DISTINCT convention) = 1")


def build_ledger(rows: Sequence[DataFrame]) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def ledger_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy().agg(F.expr("count(1) AS rows"), F.expr("count_if(status = 'GREEN') AS green"),
                                F.expr("count_if(status = 'RED') AS red"),
                                F.expr("count_if(status = 'INFO') AS info"))


def assert_green(ledger: DataFrame) -> None:
    """Fail on any RED row, naming the items. The ledger has one row per check."""
    red = [r["item"] for r in ledger.where("status = 'RED'").select("item").collect()]
    if red:
        raise ValueError(f"ledger is not green: {sorted(red)}")


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only with their multiplicity; empty means equal as bags."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_s")).unionByName(b.select(*cols, F.lit(-1).alias("_s")))
    return both.groupBy(*cols).agg(F.sum("_s").alias("excess")).where("excess <> 0")


def tables_equal(a: DataFrame, b: DataFrame) -> bool:
    return a.dtypes == b.dtypes and table_difference(a, b).isEmpty()


def fingerprint(df: DataFrame) -> DataFrame:
    """16 hex characters identifying the rows whatever their order or partitioning.

    Rows are hashed, hashes counted per 16-bit prefix bucket into ordered digests, and the 65,536
    or fewer bucket digests hashed once more; null for an empty table.
    """
    h = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    counted = h.groupBy("h").agg(F.expr("count(1) AS n"))
    # Two levels of exact integer sums over 60-bit pieces: associative, so no bucket is gathered.
    piece = [f"CAST(conv(substr(h, {1 + 15 * i}, 15), 16, 10) AS DECIMAL(20,0))" for i in range(4)]
    part = counted.groupBy(F.substring("h", 1, 4).alias("b")).agg(
        F.expr("sum(n) AS n"), *[F.expr(f"sum({p} * n) AS s{i}") for i, p in enumerate(piece)])
    return part.groupBy().agg(
        F.expr("CASE WHEN count(1) > 0 THEN substr(sha2(to_json(array_sort(collect_list(struct(b, n, s0, s1, s2, s3)))), 256), 1, 16) END AS fingerprint"),
        F.expr("coalesce(sum(n), 0L) AS rows"))


def list_runs(runs: DataFrame, rung: str | None = None, environment: str | None = None,
              status: str | None = None, limit: int = 50) -> DataFrame:
    """Newest first, at most 200. ``orderBy + limit`` is a distributed top-k."""
    for column, want in (("rung", rung), ("environment", environment), ("status", status)):
        if want is not None:
            runs = runs.where(F.col(column) == want)
    return runs.orderBy(F.desc("created"), F.desc("run_id")).limit(min(limit, 200))


def run_view(runs: DataFrame) -> DataFrame:
    done = ", ".join(f"'{s}'" for s in TERMINAL_STATUSES)
    return runs.select("*", F.expr("concat(rung, '_seed', seed) AS name"),
                       F.expr(f"status IN ({done}) AS is_terminal"))


def stage_durations(events: DataFrame) -> DataFrame:
    """Seconds between a stage's start and completion stamps, 2 places half-even; open stages null."""
    g = events.groupBy("run_id", "stage").agg(
        F.expr("max(CASE WHEN kind = 'started' THEN ts END) AS started_at"),
        F.expr("max(CASE WHEN kind = 'completed' THEN ts END) AS completed_at"))
    return g.withColumn("seconds", F.expr(
        "bround(timestampdiff(MICROSECOND, started_at, completed_at) / 1000000D, 2)"))


def latest_state(events: DataFrame) -> DataFrame:
    """Last state per run and how many events led to it; a failure keeps the earlier logs counted."""
    return events.groupBy("run_id").agg(
        F.expr("max_by(stage, struct(ts, event_id)) AS stage"), F.expr("max_by(kind, struct(ts, event_id)) AS kind"),
        F.expr("count(1) AS n_events"), F.expr("count_if(kind = 'failed') AS failures"))


def environment(explicit: str | None = None) -> str:
    """Where a run takes place: what the caller says, else the session's variable, else the first of ``ENVIRONMENTS``."""
    candidates = [explicit, os.environ.get(ENV_VAR), ENVIRONMENTS[0]]
    chosen = next(c for c in candidates if c)
    if chosen in ENVIRONMENTS:
        return chosen
    raise ValueError(f"{chosen!r} names no environment; there are {' and '.join(ENVIRONMENTS)}")


def with_environment(runs: DataFrame) -> DataFrame:
    return runs.withColumn("environment", F.coalesce("environment", F.lit("unstamped")))


def quotability(runs: DataFrame) -> DataFrame:
    """Per run: may it appear in a results table."""
    r = with_environment(runs)
    return r.withColumn("quotable", F.col("environment") != "local")


def check_quotable(runs: DataFrame, allow_local: bool = False) -> DataFrame:
    """The runs with their environment, or an error naming the local ones."""
    out = quotability(runs)
    local = out.where("NOT quotable").select("run")
    first = [] if allow_local else [str(r[0]) for r in local.orderBy("run").limit(NAMED + 1).collect()]
    if first:
        rest = f" and {local.count() - NAMED} more" if len(first) > NAMED else ""
        raise ValueError(f"local runs are trials and stay out of results: {', '.join(first[:NAMED])}{rest}")
    return out.drop("quotable")


def validate_requests(requests: DataFrame, rungs: DataFrame, versions: DataFrame, default_rung: str,
                      default_env: str, default_version: str) -> DataFrame:
    """Fill defaults and list every reason a request is refused; empty reasons means accepted."""
    r = requests.select(
        "request_id", F.expr(f"coalesce(nullif(rung, ''), '{default_rung}') AS rung"),
        F.expr(f"coalesce(nullif(environment, ''), '{default_env}') AS environment"),
        F.expr(f"coalesce(nullif(dataset_version, ''), '{default_version}') AS dataset_version"),
        F.expr("coalesce(seed, 1) AS seed"), "steps", "reference_id")
    r = r.withColumn("reference_id", F.expr("coalesce(nullif(reference_id, ''), concat(rung, '_seed', seed))"))
    known_r = rungs.select("rung", F.lit(True).alias("_r")).distinct()
    known_v = versions.select("dataset_version", F.lit(True).alias("_v")).distinct()
    envs = ", ".join(f"'{e}'" for e in ENVIRONMENTS)
    return r.join(known_r, "rung", "left").join(known_v, "dataset_version", "left").select(
        "request_id", "reference_id", "rung", "environment", "dataset_version", "seed", "steps",
        F.expr("array_join(array_compact(array(CASE WHEN _r IS NULL THEN concat('unknown rung ', rung) END, "
               f"CASE WHEN environment NOT IN ({envs}) THEN concat('unknown environment ', environment) END, "
               "CASE WHEN _v IS NULL THEN concat('dataset ', dataset_version, ' is not in storage') END)), '; ') AS reasons"))


def resolve_configs(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every rung's resolved ``(rung, key, value)``: base plus the overrides along its chain.

    ``overrides`` (rung, parent, key, value) is a catalogue of a few rows per rung; the chain is
    walked level by level to its end, the nearest override wins. A rung that is its own ancestor is an error.
    """
    edges = overrides.select("rung", "parent").distinct()
    edges = cut(edges)
    chain = edges.select("rung", F.col("rung").alias("at"), F.lit(0).alias("dist"))
    frontier = chain
    for d in count(1):
        frontier = cut(frontier.join(edges.select(F.col("rung").alias("at"), "parent"), "at").where(
            "parent IS NOT NULL").select("rung", F.col("parent").alias("at"), F.lit(d).alias("dist")))
        if frontier.isEmpty():
            break
        loops = sorted(str(r[0]) for r in frontier.where("rung = at").select("rung").distinct().collect())
        if loops:
            raise ValueError(f"rungs that inherit from themselves: {loops}")
        chain = chain.unionByName(frontier)
    own = chain.join(overrides.select(F.col("rung").alias("at"), "key", "value"), "at").where("key IS NOT NULL").groupBy(
        "rung", "key").agg(F.expr("min_by(value, dist) AS value"))
    rungs = edges.select("rung")
    full = rungs.crossJoin(base.select("key", F.col("value").alias("_b"))).join(own, ["rung", "key"], "full")
    return full.select("rung", "key", F.coalesce("value", "_b").alias("value"),
                       F.expr("value IS NOT NULL AND NOT value <=> _b AS changed"))


# Fixed constants of the growth projection: layers, frames and bytes per unit of corpus.
LAYERS_PER_SHOT = 2.1
DISK_MB_PER_LAYER = 0.905
RAM_MB_PER_LAYER = 36.0


def project_scale(shots: DataFrame, steps: int = 40000, batch: int = 6) -> DataFrame:
    """Layers, disk, memory and epochs for a shot count; ``frames`` is the corpus frame count."""
    return shots.select(
        "*", F.expr(f"shots * {LAYERS_PER_SHOT}D AS layers")).select(
        "*", F.expr(f"layers * {DISK_MB_PER_LAYER}D / 1000 AS disk_gb"),
        F.expr(f"layers * {RAM_MB_PER_LAYER}D / 1000 AS ram_gb"),
        F.expr(f"try_divide({steps} * {batch}D, frames) AS epochs"))
