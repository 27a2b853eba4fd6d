"""Key-event matching and key economy.

Matching is one-to-one, closest pairs first, ties by earlier prediction then earlier truth. That
greedy rule is evaluated without gathering a track: exact hits go first, then for each distance
``d`` the still-free events form chains of alternating kinds spaced exactly ``d`` apart, and the
greedy pairs neighbours two by two from the start of each chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import seeded, seeded_chunk
from ..functions.ordered import CHUNK, chunk_id, last_known, lookup, positions, stencil, with_totals


def matched_events(pred: DataFrame, truth: DataFrame, by: Sequence[str], tol: int,
                   size: int = CHUNK) -> DataFrame:
    """``(by, frame, in_pred, in_truth, hit)``; ``hit`` counts matched predictions at the frame."""
    by = list(by)
    ev = pred.select(*by, "frame", F.lit(True).alias("p"), F.lit(False).alias("t")).unionByName(
        truth.select(*by, "frame", F.lit(False).alias("p"), F.lit(True).alias("t")))
    ev = ev.groupBy(*by, "frame").agg(F.bool_or("p").alias("in_pred"), F.bool_or("t").alias("in_truth"))
    # state: 0 free prediction, 1 free truth, null when settled.
    ev = ev.select("*", F.expr("CASE WHEN in_pred AND in_truth THEN NULL WHEN in_pred THEN 0 ELSE 1 END AS kind"),
                   F.expr("in_pred AND in_truth").alias("hit"))
    for d in range(1, tol + 1):
        ev = _pair_at(ev, by, d, size)
    return ev.select(*by, "frame", "in_pred", "in_truth", F.col("hit"))


def _pair_at(ev: DataFrame, by: Sequence[str], d: int, size: int) -> DataFrame:
    """Settle the pairs exactly ``d`` apart. ``hit`` is set on both members of a pair."""
    by = list(by)
    lane = ev.withColumn("_r", F.expr(f"pmod(frame, {d})"))
    st = stencil(lane, [*by, "_r"], "frame", {
        "_pk": lambda w: F.last("kind").over(w.rangeBetween(-d, -d)),
        "_nk": lambda w: F.last("kind").over(w.rangeBetween(d, d))}, d, size)
    free = "kind IS NOT NULL"
    st = st.withColumn("_linked", F.expr(f"coalesce({free} AND _pk <> kind, false)"))
    st = st.withColumn("_next", F.expr(f"coalesce({free} AND _nk <> kind, false)"))
    scan = last_known(st, [*by, "_r"], "frame", {"_start": F.expr(f"CASE WHEN {free} AND NOT _linked THEN frame END")},
                      size, keep=[*by, "_r", "frame", "in_pred", "in_truth", "kind", "hit", "_next"])
    paired = (f"({free} AND (((frame - _start) div {d}) % 2 = 1 OR _next))")
    return scan.select(*by, "frame", "in_pred", "in_truth",
                       F.expr(f"CASE WHEN {paired} THEN NULL ELSE kind END AS kind"),
                       F.expr(f"hit OR coalesce({paired}, false) AS hit"))


SCORES = ("CASE WHEN n_truth = 0 THEN CASE WHEN n_pred > 0 THEN 0D ELSE 1D END WHEN n_pred = 0 THEN 1D "
          "ELSE hits / n_pred END AS precision",
          "CASE WHEN n_truth = 0 THEN 1D WHEN n_pred = 0 THEN 0D ELSE hits / n_truth END AS recall",
          "CASE WHEN n_truth = 0 THEN CASE WHEN n_pred > 0 THEN 0D ELSE 1D END WHEN n_pred = 0 OR hits = 0 THEN 0D "
          "ELSE 2D * hits / (n_pred + n_truth) END AS f1")


def match_events(pred: DataFrame, truth: DataFrame, by: Sequence[str], tol: int,
                 tracks: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """Precision, recall and F1 per track.

    ``tracks`` lists the tracks to report, so ones with neither events nor predictions get the
    empty-versus-empty score.
    """
    m = matched_events(pred, truth, by, tol, size).groupBy(*by).agg(
        F.expr("count_if(in_pred) AS n_pred"), F.expr("count_if(in_truth) AS n_truth"),
        F.expr("count_if(hit AND in_pred) AS hits"))
    if tracks is not None:
        m = tracks.select(*by).distinct().join(m, list(by), "left").na.fill(0, ["n_pred", "n_truth", "hits"])
    return m.select(*by, "n_pred", "n_truth", "hits", *[F.expr(s) for s in SCORES])


def truth_keys(keys: DataFrame, live: DataFrame, by: Sequence[str], mode: str) -> DataFrame:
    """Artist keys to score against. ``clipped``: moved into the live span, de-duplicated;
    ``strict``: only those already inside. Tracks never live drop out of both."""
    if mode not in ("clipped", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = keys.select(*by, "frame", F.lit(None).cast("long").alias("_l")).unionByName(
        live.where("live").select(*by, "frame", F.col("frame").cast("long").alias("_l")))
    k = with_totals(rows, by, {"lo": ("min", F.col("_l")), "hi": ("max", F.col("_l"))}, chunk_id("frame"))
    k = k.where("_l IS NULL AND lo IS NOT NULL")
    if mode == "clipped":
        return k.selectExpr(*by, "least(greatest(frame, lo), hi) AS frame").distinct()
    return k.where("frame BETWEEN lo AND hi").select(*by, "frame").distinct()


def key_summary(matches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Truth-count-weighted means over a group's tracks and the key ratio."""
    w = "n_truth"
    return matches.groupBy(*by).agg(
        F.expr("sum(n_pred) AS keys_predicted"), F.expr(f"sum({w}) AS keys_artist"),
        *[F.expr(f"coalesce(try_divide(sum({w} * {m}), sum({w})), 0D) AS key_{m}")
          for m in ("precision", "recall", "f1")],
        F.expr(f"sum(n_pred) / greatest(1, sum({w})) AS key_ratio"))


def random_keys(live: DataFrame, counts: DataFrame, by: Sequence[str], seed: int) -> DataFrame:
    """As many live frames as ``counts.n`` asks for, by hash rank: reproducible at any scale."""
    pool = live.where("live").select(*by, "frame").withColumn("_h", seeded(seed, *by, "frame"))
    ranked = positions(pool, by, ["_h", "frame"], seeded_chunk("_h"), "_rank")
    return lookup(ranked, counts.select(*by, "n"), by, ["_h"]).where("_rank < n").select(*by, "frame")


def random_key_baseline(live: DataFrame, chosen: DataFrame, truth: DataFrame, by: Sequence[str],
                        tol: int, seed: int) -> DataFrame:
    """F1 of a same-size random key set beside the chosen one; the difference is what was earned."""
    counts = chosen.groupBy(*by).agg(F.expr("count(1) AS n"))
    rnd = match_events(random_keys(live, counts, by, seed), truth, by, tol).select(
        *by, F.col("f1").alias("baseline_f1"))
    got = match_events(chosen, truth, by, tol)
    return got.join(rnd, list(by)).withColumn("f1_over_random", F.expr("f1 - baseline_f1"))


def head_key_score(cells: DataFrame, truth: DataFrame, by: Sequence[str], thresh: float, tol: int,
                   seed: int) -> DataFrame:
    """A key probability scored at ``thresh`` against firing on every live frame and at random."""
    own = cells.where(F.expr(f"live AND p > {thresh}"))
    live_all = cells.where("live")
    counts = own.groupBy(*by).agg(F.expr("count(1) AS n"))
    head = match_events(own, truth, by, tol, live_all)
    every = match_events(live_all, truth, by, tol).select(*by, F.col("f1").alias("all_live_f1"))
    rnd = match_events(random_keys(cells, counts, by, seed), truth, by, tol, live_all).select(
        *by, F.col("f1").alias("random_f1"))
    out = head.join(every, list(by)).join(rnd, list(by))
    return out.withColumn("over_best_baseline", F.expr("f1 - greatest(all_live_f1, random_f1)"))


def decode_count(logits: DataFrame, by: Sequence[str], pmax: int, values: str = "logits") -> DataFrame:
    """Sum class logits over frames, take the first maximum, clamp to ``[3, pmax]``."""
    long = logits.select(*by, F.posexplode(values).alias("cls", "v"))
    summed = long.groupBy(*by, "cls").agg(F.expr("sum(v) AS v"))
    return summed.groupBy(*by).agg(F.expr("max_by(cls, struct(v, -cls)) AS raw_count")).withColumn(
        "count", F.expr(f"least(greatest(raw_count, 3), {pmax})"))


def count_report(counts: DataFrame, truth: str, by: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by).agg(
        F.expr(f"count_if(count = {truth}) / count(1) AS point_count_exact"),
        F.expr(f"count_if(count > {truth}) AS point_count_over"),
        F.expr(f"count_if(count < {truth}) AS point_count_under"))


def slots_alive(prob: DataFrame, by: Sequence[str], slot: str = "slot", thresh: float = 0.5) -> DataFrame:
    """Slots whose probability passes the threshold on any frame."""
    per = prob.groupBy(*by, slot).agg(F.expr(f"bool_or(p > {thresh}) AS on"))
    return per.groupBy(*by).agg(F.expr("count_if(on) AS slots_alive"))
