"""Score roll-ups: per element, per run, per training status, across repeat runs.

Averages never travel alone: every aggregate also carries its worst case. Unmeasured stays null.
Groups may be arbitrarily large, so only mergeable aggregates are used, and quantiles go through
``quantile_table``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.distribution import quantile_table
from ..functions.expr import ratio, sigmoid, softplus, weighted_mean


ELEMENT_AGGS = (
    "count(1) AS frames", "avg(soft_iou) AS mean_soft_iou", "min(soft_iou) AS min_soft_iou",
    "avg(iou) AS mean_iou", "count_if(soft_iou < 0.95) AS frames_below_095",
    "count_if(soft_iou < 0.90) AS frames_below_090",
    "min_by(frame, struct(soft_iou, frame)) AS worst_frame",
    "avg(point_err) AS point_err_px", "max(point_err) AS max_point_err_px")
ONSCREEN_AGGS = (
    "count_if(coverage > 0) AS frames_onscreen", "count_if(coverage <= 0) AS frames_offscreen",
    "avg(CASE WHEN coverage > 0 THEN soft_iou END) AS mean_soft_iou_onscreen",
    "min(CASE WHEN coverage > 0 THEN soft_iou END) AS min_soft_iou_onscreen",
    "count_if(coverage > 0 AND soft_iou < 0.90) AS frames_below_090_onscreen")
SPLIT_AGGS = (
    "avg(CASE WHEN held THEN soft_iou END) AS held_soft_iou",
    "CASE WHEN count_if(held) > 0 THEN avg(CASE WHEN NOT held THEN soft_iou END) END AS train_soft_iou",
    "count_if(held) AS held_frames")
ELEMENT_KEY = ("run", "element_id")


def element_rows(scores: DataFrame, by: Sequence[str] = ELEMENT_KEY,
                 aggs: Sequence[str] = ELEMENT_AGGS + ONSCREEN_AGGS + SPLIT_AGGS) -> DataFrame:
    """One row per (run, element): every mergeable block in a single aggregation."""
    return scores.groupBy(*by).agg(*[F.expr(a) for a in aggs])


def with_quantiles(rows: DataFrame, scores: DataFrame, by: Sequence[str] = ELEMENT_KEY) -> DataFrame:
    """Attach the exact 5th percentile of soft IoU and 95th of point error."""
    by = list(by)
    return rows.join(quantile_table(scores, by, {
        "soft_iou": {"p05_soft_iou": 0.05}, "point_err": {"p95_point_err_px": 0.95}}), by, "left")


def element_summary(scores: DataFrame, by: Sequence[str] = ELEMENT_KEY) -> DataFrame:
    """Quality per element: means, floors, counts below the gates, worst frame, point errors."""
    return with_quantiles(element_rows(scores, by, ELEMENT_AGGS), scores, by)


def onscreen_summary(scores: DataFrame, by: Sequence[str] = ELEMENT_KEY) -> DataFrame:
    """The same over frames whose target draws something; null when none does."""
    return element_rows(scores, by, ONSCREEN_AGGS)


def split_summary(scores: DataFrame, by: Sequence[str] = ELEMENT_KEY) -> DataFrame:
    """Held and train means; elements with no held frame leave every column null."""
    return element_rows(scores, by, SPLIT_AGGS).withColumn(
        "held_gap", F.expr("train_soft_iou - held_soft_iou"))


def _wavg(x: str, w: str, name: str) -> Column:
    """Weighted mean over the rows where the metric was measured."""
    return F.expr(f"try_divide(sum({x} * {w}), sum(CASE WHEN {x} IS NOT NULL THEN CAST({w} AS DOUBLE) END))"
                  f" AS {name}")


def run_totals(rows: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Element rows to run rows. Optional metrics are included when their columns exist.

    Frame-weighted quality, artist-key-weighted key metrics, on-screen metrics weighted by
    on-screen frames, lifespan by cells, point counts by shapes, held metrics by held frames.
    """
    have = set(rows.columns)
    share = "frames_below_090 / greatest(1, frames)"
    aggs = [
        F.expr("count(1) AS elements"), F.expr("sum(frames) AS frames"),
        _wavg("mean_soft_iou", "frames", "mean_soft_iou"),
        _wavg("mean_iou", "frames", "mean_iou"),
        F.expr("min(mean_soft_iou) AS worst_element_soft_iou"),
        F.expr("min_by(element_id, struct(mean_soft_iou, element_id)) AS worst_element"),
        F.expr("min(min_soft_iou) AS worst_frame_soft_iou"),
        F.expr("min_by(worst_frame, struct(min_soft_iou, element_id)) AS worst_frame"),
        F.expr("min_by(element_id, struct(min_soft_iou, element_id)) AS worst_frame_element"),
        F.expr("sum(frames_below_095) AS frames_below_095"),
        F.expr("sum(frames_below_090) AS frames_below_090"),
        F.expr("100.0D * sum(frames_below_095) / greatest(1, sum(frames)) AS frames_below_095_pct"),
        F.expr("100.0D * sum(frames_below_090) / greatest(1, sum(frames)) AS frames_below_090_pct"),
        F.expr(f"100.0D * max({share}) AS worst_element_below_090_pct"),
        F.expr(f"max_by(element_id, struct({share}, -element_id)) AS worst_element_below_090")
        if dict(rows.dtypes)["element_id"] != "string" else
        F.expr(f"min_by(element_id, struct(-({share}), element_id)) AS worst_element_below_090"),
    ]
    for name in ("point_err_px", "p95_point_err_px", "jitter_px"):
        if name in have:
            aggs.append(_wavg(name, "frames", name))
    if "p95_point_err_px" in have:
        aggs.append(F.expr("max(p95_point_err_px) AS p95_point_err_worst_element_px"))
    if "max_point_err_px" in have:
        aggs.append(F.expr("max(max_point_err_px) AS max_point_err_px"))
    if {"keys_artist", "keys_predicted"} <= have:
        aggs += [F.expr("sum(keys_artist) AS keys_artist"),
                 F.expr("sum(keys_predicted) AS keys_predicted"),
                 F.expr("sum(keys_predicted) / greatest(1, sum(keys_artist)) AS key_ratio")]
        for name in ("key_f1", "key_precision", "key_recall", "key_f1_strict",
                     "key_f1_over_random", "head_key_f1", "head_key_f1_over_best_baseline"):
            if name in have:
                aggs.append(_wavg(name, "keys_artist", name))
    if "key_tol_min" in have:
        aggs += [F.expr("min(key_tol_min) AS key_tol_min"), F.expr("max(key_tol_max) AS key_tol_max")]
    if "mean_soft_iou_onscreen" in have:
        aggs += [_wavg("mean_soft_iou_onscreen", "frames_onscreen", "mean_soft_iou_onscreen"),
                 F.expr("min(mean_soft_iou_onscreen) AS worst_element_soft_iou_onscreen"),
                 F.expr("min_by(element_id, struct(mean_soft_iou_onscreen, element_id)) FILTER "
                        "(WHERE mean_soft_iou_onscreen IS NOT NULL) AS worst_element_onscreen"),
                 F.expr("sum(frames_onscreen) AS frames_onscreen"),
                 F.expr("sum(frames_offscreen) AS frames_offscreen"),
                 F.expr("sum(frames_below_090_onscreen) AS frames_below_090_onscreen")]
    if "held_soft_iou" in have:
        aggs += [_wavg("held_soft_iou", "held_frames", "held_soft_iou"),
                 _wavg("train_soft_iou", "held_frames", "train_soft_iou"),
                 F.expr("sum(held_frames) AS held_frames")]
    if "lifespan_cells" in have:
        aggs += [_wavg(f"lifespan_{m}", "lifespan_cells", f"lifespan_{m}")
                 for m in ("accuracy", "fp_rate", "fn_rate")]
        aggs += [F.expr("sum(lifespan_cells) AS lifespan_cells"),
                 F.expr("max(lifespan_fn_rate) AS lifespan_worst_fn_rate"),
                 F.expr("min_by(element_id, struct(-lifespan_fn_rate, element_id)) FILTER "
                        "(WHERE lifespan_fn_rate IS NOT NULL) AS lifespan_worst_element"),
                 F.expr("sum(lifespan_transitions_pred) / greatest(1, sum(lifespan_transitions_artist))"
                        " AS lifespan_transition_ratio")]
        for tag in ("held", "train"):
            if f"{tag}_lifespan_accuracy" in have:
                aggs.append(_wavg(f"{tag}_lifespan_accuracy", "lifespan_cells",
                                  f"{tag}_lifespan_accuracy"))
    if "point_count_exact" in have:
        aggs += [_wavg("point_count_exact", "coalesce(shapes, frames)" if "shapes" in have else "frames",
                       "point_count_exact"),
                 F.expr("sum(CASE WHEN point_count_exact IS NOT NULL THEN point_count_over END) AS point_count_over"),
                 F.expr("sum(CASE WHEN point_count_exact IS NOT NULL THEN point_count_under END) AS point_count_under")]
    out = rows.groupBy(*by).agg(*aggs)
    if "held_soft_iou" in have:
        out = out.withColumn("held_gap", F.expr("train_soft_iou - held_soft_iou"))
    if {"held_lifespan_accuracy", "train_lifespan_accuracy"} <= have:
        out = out.withColumn("lifespan_held_gap",
                             F.expr("train_lifespan_accuracy - held_lifespan_accuracy"))
    return out


def by_training_status(rows: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Blocks ``trained`` / ``held`` / ``all`` plus the ``headline`` choice.

    ``rows.in_train`` says what the run trained on. The headline is the trained block, or all
    rows when nothing was trained. Held and all are present only when something was held.
    """
    by = list(by)
    tagged = rows.withColumn("block", F.explode(F.expr(
        "array('all', CASE WHEN in_train THEN 'trained' ELSE 'held' END)")))
    blocks = run_totals(tagged, [*by, "block"])
    seen = Window.partitionBy(*by)
    flagged = blocks.select("*", F.expr("block = 'held'").alias("_h"),
                            F.expr("block = 'trained'").alias("_t"))
    flagged = flagged.select("*", F.max("_h").over(seen).alias("_any_held"),
                             F.max("_t").over(seen).alias("_any_trained"))
    flagged = flagged.withColumn("headline", F.expr(
        "block = 'trained' OR (block = 'all' AND NOT _any_trained)"))
    return flagged.where("_any_held OR headline").drop("_h", "_t", "_any_held", "_any_trained")


def long_metrics(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric columns to ``(by, metric, value)`` rows; unmeasured ones disappear."""
    pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics)
    return df.selectExpr(*by, f"stack({len(metrics)}, {pairs}) AS (metric, value)").where(
        "value IS NOT NULL")


def spread(runs: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Noise floor across repeat runs; the sample sd only for three or more."""
    long = long_metrics(runs, [*by, "run"], metrics)
    return long.groupBy(*by, "metric").agg(
        F.expr("count(1) AS n_runs"), F.expr("avg(value) AS mean"), F.expr("min(value) AS min"),
        F.expr("max(value) AS max"), F.expr("max(value) - min(value) AS range"),
        F.expr("CASE WHEN count(1) > 2 THEN stddev_samp(value) END AS sd"))


def results_table(runs: DataFrame, layout: DataFrame, provenance: DataFrame | None = None
                  ) -> DataFrame:
    """Formatted rows in layout order: mean and max-min spread at the layout's decimals.

    ``layout`` is the fixed-size catalogue ``(section, ordinal, label, metric, decimals)``;
    ``runs`` are long ``(run, metric, value)`` rows. A metric no run has shows ``--``.
    """
    agg = runs.groupBy("metric").agg(F.expr("avg(value) AS _m"),
                                     F.expr("max(value) - min(value) AS _s"))
    fmt = "CASE WHEN {0} IS NULL THEN '{1}' ELSE format_string(concat('%.', decimals, 'f'), {0}) END"
    return layout.join(agg, "metric", "left").select(
        "section", "ordinal", "label", F.expr(fmt.format("_m", "--")).alias("value"),
        F.expr(fmt.format("_s", "")).alias("spread"))


def results_report(runs: DataFrame, layout: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``(section, ordinal, label, value, spread)`` of a report whose sections read blocks of their own.

    ``runs`` are long ``(run, block, metric, value)`` rows; ``layout`` is the fixed catalogue ``(section, ordinal, label, block, metric,
    decimals, needs)``. A section with ``needs`` appears only if some run has that metric in its block, and not as zero. Two more
    sections follow when there is something to say: how many frames were on screen, and which shots and elements ``held`` (shot,
    element_id) were kept from training.
    """
    agg = runs.groupBy("block", "metric").agg(F.expr("avg(value) AS _m"), F.expr("max(value) - min(value) AS _s"), F.expr("max(abs(value)) AS _any"))
    need = agg.where("_any > 0").select("block", F.col("metric").alias("needs"), F.lit(True).alias("_there"))
    fmt = "CASE WHEN {0} IS NULL THEN '{1}' ELSE format_string(concat('%.', decimals, 'f'), {0}) END"
    body = layout.join(need, ["block", "needs"], "left").where("needs IS NULL OR _there").join(agg, ["block", "metric"], "left").select(
        "section", "ordinal", "label", F.expr(fmt.format("_m", "--")).alias("value"), F.expr(fmt.format("_s", "")).alias("spread"))
    seen = agg.where("block = 'all' AND metric IN ('frames_onscreen', 'frames_offscreen')").groupBy().agg(
        F.expr("max(CASE WHEN metric = 'frames_onscreen' THEN _m END) AS _on"), F.expr("max(CASE WHEN metric = 'frames_offscreen' THEN _m END) AS _off"))
    frames = seen.where("_on IS NOT NULL").select(
        F.lit("FRAMES").alias("section"), F.lit(1).alias("ordinal"), F.lit("on screen / layer absent").alias("label"),
        F.expr("format_string('%.0f / %.0f', _on, coalesce(_off, 0D))").alias("value"),
        F.expr("format_string('%.1f%%', coalesce(100 * _off / (_on + _off), 0D))").alias("spread"))
    out = body.unionByName(frames)
    if held is None:
        return out
    kept = held.groupBy("shot").agg(F.expr("array_join(sort_array(collect_set(element_id)), ', ') AS value")).where("shot IS NOT NULL")
    return out.unionByName(kept.select(
        F.lit("HELD-OUT SHOTS").alias("section"), F.row_number().over(Window.orderBy("shot")).alias("ordinal"), F.col("shot").alias("label"),
        "value", F.lit("").alias("spread")))


def table_header(runs: DataFrame) -> DataFrame:
    """One row of warnings for a results table: seeds, environments, dataset fingerprints."""
    env = "coalesce(environment, 'unstamped')"
    g = runs.groupBy().agg(
        F.expr("count(DISTINCT run) AS n_runs"),
        F.expr(f"array_join(sort_array(collect_set({env})), '/') AS environments"),
        F.expr("count(DISTINCT dataset_fingerprint) AS n_fingerprints"))
    return g.select(
        "n_runs", "environments", "n_fingerprints",
        F.expr("CASE WHEN n_runs > 1 THEN concat(n_runs, ' seeds, mean and spread') "
               "ELSE 'ONE SEED, not a mean' END AS header"),
        F.expr("CASE WHEN environments <> 'staging' OR n_fingerprints > 1 THEN concat("
               "'environment ', environments, CASE WHEN environments = 'unstamped' THEN "
               "' (environment not recorded)' ELSE '' END, CASE WHEN n_fingerprints > 1 THEN "
               "concat(', WARNING: ', n_fingerprints, ' different dataset fingerprints') ELSE '' END)"
               " END AS note"))


def compare_runs(now: DataFrame, prev: DataFrame, directions: DataFrame) -> DataFrame:
    """Attempt against attempt, both long ``(run, metric, value)``.

    A move counts only when it exceeds the current spread; ``higher_is_better`` may be null for
    ratios where both directions are wrong.
    """
    def agg(df, m, s):
        return df.groupBy("metric").agg(F.expr(f"avg(value) AS {m}"),
                                        F.expr(f"max(value) - min(value) AS {s}"))
    out = agg(now, "now", "spread").join(agg(prev, "was", "_ps"), "metric", "left").join(
        F.broadcast(directions), "metric")
    out = out.withColumn("delta", F.expr("now - was"))
    return out.select(
        "metric", "now", "spread", "was", "delta",
        F.expr("CASE WHEN delta IS NULL THEN 'new' WHEN abs(delta) <= spread THEN 'same' "
               "WHEN higher_is_better IS NULL THEN 'moved' "
               "WHEN (delta > 0) = higher_is_better THEN 'better' ELSE 'worse' END AS verdict"))


def score_assembly(scores: DataFrame, declared: DataFrame, known: DataFrame,
                   held_shots: DataFrame, shared: bool) -> DataFrame:
    """Training facts per scored element.

    ``declared``: elements the run says it withheld; ``known``: elements it holds rows for.
    An element is frozen when rows are not shared and it is withheld or unknown. The two lists
    can disagree, and ``disagrees`` says where.
    """
    d = declared.select("element_id", F.lit(True).alias("_w")).distinct()
    k = known.select("element_id", F.lit(True).alias("_k")).distinct()
    h = held_shots.select(F.col("shot"), F.lit(True).alias("_hs")).distinct()
    out = (scores.withColumn("shot", F.split_part("element_id", F.lit("__"), F.lit(1)))
           .join(d, "element_id", "full").join(k, "element_id", "left").join(h, "shot", "left"))
    w, kn = F.coalesce("_w", F.lit(False)), F.coalesce("_k", F.lit(False))
    frozen = (w | ~kn) & F.lit(not shared)
    return out.select(*scores.columns, "shot", (~w & kn).alias("in_train"),
                      (~frozen).alias("scored_with_real_queries"),
                      F.coalesce("_hs", F.lit(False)).alias("held_shot"),
                      (frozen != w).alias("disagrees"))


def sweep_best(cells: DataFrame, params: Sequence[str], metric: str) -> DataFrame:
    """The best grid cell; ties go to the first in parameter order."""
    order = ", ".join(params)
    return cells.groupBy().agg(F.expr(
        f"min_by(struct({order}, {metric}), struct(-{metric}, {order})) AS best")).select("best.*")


def balanced_logloss(df: DataFrame, by: Sequence[str], logit: str, target: str, weight: str,
                     mask: str = "true", thresh: float = 0.5) -> DataFrame:
    """Class-balanced log-loss with precision, recall and error shares at ``thresh``.

    ``mask`` limits the cells (live cells for keys, all cells for lifespans).
    """
    sp = "(greatest({0}, 0D) + log1p(exp(-abs({0}))))"
    pos, neg = sp.format(f"(-{logit})"), sp.format(logit)
    hot = f"(1D / (1D + exp(-{logit})) > {thresh})"
    g = df.where(mask)
    return g.groupBy(*by).agg(
        F.expr("count(1) AS cells"),
        F.expr(f"avg(CASE WHEN {target} THEN {weight} * {pos} ELSE {neg} END) AS logloss"),
        F.expr(f"coalesce(try_divide(count_if({hot} AND {target}), count_if({hot})), 0D) AS precision"),
        F.expr(f"coalesce(try_divide(count_if({hot} AND {target}), count_if({target})), 0D) AS recall"),
        F.expr(f"count_if({hot} AND NOT {target}) / count(1) AS fp_rate"),
        F.expr(f"count_if(NOT {hot} AND {target}) / count(1) AS fn_rate"))


def count_diagnostics(df: DataFrame, logits: str, target: str) -> DataFrame:
    """Per row: cross-entropy on the count and the relative deviation of the expected count."""
    peak = f"array_max({logits})"
    total = f"aggregate({logits}, 0D, (s, v) -> s + exp(v - {peak}))"
    expected = (f"aggregate(transform({logits}, (v, i) -> exp(v - {peak}) * i), 0D, (s, v) -> s + v)"
                f" / {total}")
    return df.select(
        "*", F.expr(f"ln({total}) + {peak} - element_at({logits}, {target} + 1)").alias("count_ce"),
        F.expr(expected).alias("expected_count")).withColumn(
        "count_deviation", F.expr(f"abs(expected_count - {target}) / greatest({target}, 1)"))


def log_windows(steps: DataFrame, n: int, metrics: Sequence[str], by: Sequence[str] = ()
                ) -> DataFrame:
    """Trailing means every ``n`` steps; an unfinished last bucket is not emitted."""
    g = steps.groupBy(*by, F.expr(f"(floor((step - 1) / {n}) + 1) * {n}").cast("long").alias("step_end"))
    return g.agg(F.expr("max(step) AS _last"), *[F.expr(f"avg({m}) AS {m}") for m in metrics]).where(
        "_last = step_end").drop("_last")
