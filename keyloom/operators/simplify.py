"""Fewest-keys track simplification.

Input rows are one frame of one track: ``(by, pos, frame, pts ARRAY<DOUBLE>)`` with ``pts`` the
flattened x, y of every point and ``pos`` a dense 0-based position. ``inv_tol`` (1 / tolerance) is
an optional per-frame column; without it the tolerance is uniform.

* up to 64 frames: exact minimax dynamic programme, one bounded group per track;
* longer: furthest-reach greedy, which walks a track once (``Walk``). Tracks beyond ``GROUP_LIMIT`` rows are walked
  chunk by chunk: every round takes the next chunk of each of them, from the state that the last one left, so
  no task holds more than a chunk and the frames that still confine the current chord. Rounds follow the
  longest track's number of chunks; the answer does not depend on them.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..functions.groups import by_group, lists, numbers
from ..functions.lineage import cut, work_dir
from ..functions.ordered import CHUNK, chunk_id, last_known, with_totals
from .refit import basis_weights, refit  # noqa: F401  (the other half of rebuilding a track)

# The group functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DP_MAX_FRAMES = 64
REACH_PATIENCE = 8
GROUP_LIMIT = 4096
CHUNK_BYTES = 32 << 20
"""A round's share of one track, at most ``CHUNK`` rows."""
DIRECTIONS = 128
MARGIN = 1e-10
MAX_BLOCK = 256


def _misses(start: np.ndarray, ends: np.ndarray, between: np.ndarray, u: np.ndarray, scale: np.ndarray | None) -> np.ndarray:
    """Largest point distance of every (end, row between): u is the row's share of the way to the end."""
    u = u[:, :, None, None]
    d = np.sqrt((((1.0 - u) * start + u * ends[:, None] - between[None]) ** 2).sum(-1)).max(-1)
    return d if scale is None else d * scale[None]


def chord_errors(pts: np.ndarray, scale: np.ndarray | None, a: int, lo: int, hi: int) -> np.ndarray:
    """Worst point distance inside each chord ``a-b`` for every end ``b`` in ``[lo, hi)``."""
    b, t = np.arange(lo, hi), np.arange(a + 1, hi - 1)
    if not len(t):
        return np.zeros(len(b))
    d = _misses(pts[a], pts[b], pts[t], (t[None, :] - a) / (b[:, None] - a), None if scale is None else scale[t])
    d[t[None, :] >= b[:, None]] = 0.0
    return d.max(axis=1)


def chord_error(pts: np.ndarray, scale: np.ndarray | None, a: int, b: int) -> float:
    return float(chord_errors(pts, scale, a, b, b + 1)[0])


def minimax_knots(pts, scale, budget: float) -> list[int]:
    """Fewest knots within budget, then the smallest worst chord, then the earliest frames."""
    t = len(pts)
    cost = np.full((t, t), np.inf)
    for a in range(t):
        cost[a, a] = 0.0
        cost[a, a + 1:] = chord_errors(pts, scale, a, a + 1, t)
    level, came = cost[0].copy(), []
    while level[-1] > budget and len(came) < t - 1:
        via = np.maximum(level[:, None], cost)
        came.append(via.argmin(axis=0))
        level = via.min(axis=0)
    at, knots = t - 1, {0, t - 1}
    for step in reversed(came):
        at = int(step[at])
        knots.add(at)
    return sorted(knots)


class Rows:
    """Consecutive rows of a track: positions, frames, points (n, P, 2) and tolerance scales (or none)."""

    def __init__(self, pos: np.ndarray, frame: np.ndarray, pts: np.ndarray, scale: np.ndarray | None):
        self.pos, self.frame, self.pts, self.scale = pos, frame, pts, scale

    def __len__(self) -> int:
        return len(self.pos)

    def take(self, which) -> Rows:
        return Rows(self.pos[which], self.frame[which], self.pts[which], None if self.scale is None else self.scale[which])

    def then(self, other: Rows) -> Rows:
        scale = None if self.scale is None else np.concatenate([self.scale, other.scale])
        return Rows(np.concatenate([self.pos, other.pos]), np.concatenate([self.frame, other.frame]),
                    np.concatenate([self.pts, other.pts]), scale)


class Walk:
    """Greedy knots of one track whose rows arrive in order of position.

    From a knot, the next one is the furthest row that a chord may reach before ``patience`` rows in a row may not be reached. A
    chord may reach a row if every row between lies within tolerance of it. A row between, at distance n from the knot,
    confines the chord's slope to a disc of radius tolerance / n around its own slope. A disc that contains all that the
    others leave open, as seen along ``DIRECTIONS`` directions and with a margin far above rounding, can never refuse a chord that
    they allow, so its row is forgotten. On a still track a few dozen rows are left of any number. What is left is
    compared by the same expression as all rows would be, so the knots are the same. With a tolerance of zero nothing is forgotten.
    """

    def __init__(self, budget: float, patience: int = REACH_PATIENCE):
        self.budget, self.patience = budget, patience
        self.rows: Rows | None = None      # from the best end so far (or the knot itself) on
        self.knot: Rows | None = None      # one row
        self.bounds: Rows | None = None    # rows between that may still refuse a chord
        self.front, self.misses, self.block, self.checked = 0, 0, patience, 0
        self.found: list[tuple[int, int]] = []

    def state(self) -> bytes:
        """What a later task needs to go on."""
        plain = {k: (v.pos, v.frame, v.pts, v.scale) if isinstance(v, Rows) else v for k, v in vars(self).items()}
        return pickle.dumps(plain)

    @staticmethod
    def resumed(state: bytes) -> Walk:
        walk = Walk(0.0)
        for k, v in pickle.loads(state).items():
            setattr(walk, k, Rows(*v) if isinstance(v, tuple) else v)
        return walk

    def feed(self, rows: Rows) -> None:
        if not len(rows):
            return
        if self.rows is None:
            self.rows = rows
            self._begin()
        else:
            self.rows = self.rows.then(rows)
        while self.front + 1 < len(self.rows):
            self._scan(min(self.front + 1 + self.block, len(self.rows)))

    def finish(self) -> None:
        """No row follows: what was reached is a knot, up to the last row."""
        while self.rows is not None and self.rows.pos[0] != self.knot.pos[0]:
            self._begin()
            while self.front + 1 < len(self.rows):
                self._scan(min(self.front + 1 + self.block, len(self.rows)))

    def _begin(self) -> None:
        """The first remembered row becomes a knot."""
        self.knot = self.rows.take(slice(0, 1))
        self.bounds = self.rows.take(slice(0, 0))
        self.front, self.misses, self.block, self.checked = 0, 0, self.patience, 0
        self.found.append((int(self.knot.pos[0]), int(self.knot.frame[0])))

    def _scan(self, hi: int) -> None:
        lo, best = self.front + 1, 0
        for b, ok in enumerate(self._allowed(lo, hi).tolist(), lo):
            best, self.misses = (b, 0) if ok else (best, self.misses + 1)
            if self.misses >= self.patience:
                self.rows = self.rows.take(slice(best, None))
                self._begin()
                return
        self.bounds = self.bounds.then(self.rows.take(slice(lo, hi)))
        if len(self.bounds) > 2 * self.checked + 64:
            self._forget()
        self.front = hi - 1
        self.block = min(2 * self.block, max(self.patience, min(MAX_BLOCK, 16384 // self.rows.pts.shape[1])))
        if best:
            self.rows = self.rows.take(slice(best, None))
            self.front -= best

    def _allowed(self, lo: int, hi: int) -> np.ndarray:
        """Whether a chord from the knot may end at each of the rows lo .. hi - 1."""
        a, start, ends = self.knot.pos[0], self.knot.pts[0], self.rows.take(slice(lo, hi))
        far = (ends.pos - a)[:, None]
        inside = ends.take(slice(0, len(ends) - 1))
        worst = np.zeros(len(ends))
        if len(inside):
            d = _misses(start, ends.pts, inside.pts, (inside.pos - a)[None, :] / far, inside.scale)
            d[inside.pos[None, :] >= ends.pos[:, None]] = 0.0
            worst = d.max(axis=1)
        per = max(1, (1 << 21) // (len(ends) * start.size))
        for k in range(0, len(self.bounds), per):
            some = self.bounds.take(slice(k, k + per))
            d = _misses(start, ends.pts, some.pts, (some.pos - a)[None, :] / far, some.scale)
            worst = np.maximum(worst, d.max(axis=1))
        return worst <= self.budget

    def _forget(self) -> None:
        start, b = self.knot.pts[0], self.bounds
        n = (b.pos - self.knot.pos[0]).astype(float)
        with np.errstate(divide="ignore"):
            radius = (self.budget if b.scale is None else self.budget / b.scale) / n
        size = np.abs(b.pts).max(axis=(1, 2)) + np.abs(start).max()
        angle = np.arange(DIRECTIONS) * (2 * np.pi / DIRECTIONS)
        ways = np.stack([np.cos(angle), np.sin(angle)])
        least = radius * np.cos(np.pi / DIRECTIONS) - MARGIN * (radius + size / n)
        keep = np.zeros(len(b), bool)
        for p in range(0, b.pts.shape[1], 64):
            along = ((b.pts[:, p:p + 64] - start[p:p + 64]) / n[:, None, None]) @ ways
            open_to = (along + radius[:, None, None]).min(axis=0)
            keep |= ((open_to[None] - along).max(axis=2) > least[:, None]).any(axis=1)
        self.bounds = b.take(keep & np.isfinite(radius))
        self.checked = len(self.bounds)


def _rows_of(pdf: pd.DataFrame) -> Rows:
    pdf = pdf.sort_values("pos")
    pts, scale = np.stack(pdf["pts"].to_numpy()).astype(float), pdf["inv_tol"].to_numpy(float)
    return Rows(pdf["pos"].to_numpy(np.int64), pdf["frame"].to_numpy(np.int64), pts.reshape(len(pdf), -1, 2),
                None if np.isnan(scale).any() else scale)


def _solve_groups(tol: float, dp_frames: int, patience: int):
    """The knots of whole tracks, one after the other."""
    def solve(table: pa.Table, bounds: np.ndarray):
        items, starts = lists(table["pts"])
        pos, frame, scales = table["pos"].to_numpy(), table["frame"].to_numpy(), numbers(table["inv_tol"])
        values = numbers(pa.chunked_array([items]))
        group, places, frames, methods = [], [], [], []
        for g, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            scale = scales[lo:hi]
            rows = Rows(pos[lo:hi], frame[lo:hi], values[starts[lo]:starts[hi]].reshape(hi - lo, -1, 2),
                        None if np.isnan(scale).any() else scale)
            budget = tol if rows.scale is None else 1.0
            if 2 < len(rows) <= dp_frames:
                at, method = minimax_knots(rows.pts, rows.scale, budget), "dp"
                found = list(zip(rows.pos[at].tolist(), rows.frame[at].tolist()))
            else:
                walk = Walk(budget, patience)
                walk.feed(rows)
                walk.finish()
                found, method = walk.found, "greedy" if len(rows) > 2 else "trivial"
            group += [g] * len(found)
            places += [p for p, _ in found]
            frames += [f for _, f in found]
            methods += [method] * len(found)
        return group, {"pos": pa.array(places, pa.int64()), "frame": pa.array(frames, pa.int64()), "method": pa.array(methods, pa.string())}
    return solve


def _long_knots(rows: DataFrame, by: list[str], tol: float, key_ddl: str, chunk: int, patience: int) -> DataFrame:
    """``(by, pos, frame)`` of the knots of long tracks; every round walks the next chunk of each."""
    spark, folder = rows.sparkSession, work_dir(rows.sparkSession)
    chunked = rows.withColumn("_chunk", chunk_id("pos", chunk))
    chunked.write.partitionBy("_chunk").parquet(f"{folder}/rows")
    written = spark.read.schema(chunked.schema).parquet(f"{folder}/rows")
    types = dict(rows.dtypes)

    def step(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in [*by, "pos", "frame", "state"]})
        own = _rows_of(pdf)
        walk = Walk.resumed(before["state"].iloc[0]) if len(before) else Walk(tol if own.scale is None else 1.0, patience)
        walk.feed(own)
        last = own.pos[-1] == pdf["_t"].iloc[0] - 1
        if last:
            walk.finish()
        found, walk.found = walk.found, []
        out = pd.DataFrame(found, columns=["pos", "frame"]).astype("Int64")
        out["state"] = None
        if not last:
            out.loc[len(out)] = [pd.NA, pd.NA, walk.state()]
        for k in reversed(by):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    ddl = f"{key_ddl}, pos long, frame long, state binary"
    state = spark.createDataFrame([], ", ".join([*[f"{k} {types[k]}" for k in by], "state binary"]))
    last = written.agg(F.max("_chunk")).first()[0]
    for c in range((last if last is not None else -1) + 1):
        here = written.where(F.col("_chunk") == c).drop("_chunk")
        here.groupBy(*by).cogroup(state.groupBy(*by)).applyInPandas(step, ddl).write.parquet(f"{folder}/walk/round={c}")
        state = spark.read.schema(ddl).parquet(f"{folder}/walk/round={c}").where("state IS NOT NULL").select(*by, "state")
    return spark.read.schema(ddl).parquet(f"{folder}/walk").where("pos IS NOT NULL").select(*by, "pos", "frame") if last is not None else \
        rows.select(*by, "pos", "frame").limit(0)


def simplify(track: DataFrame, by: Sequence[str], tol: float, inv_tol: str | None = None,
             chunk: int | None = None, limit: int = GROUP_LIMIT, dp_frames: int = DP_MAX_FRAMES,
             patience: int = REACH_PATIENCE) -> DataFrame:
    """``(by, pos, frame, method)`` of the chosen knots, first and last always included.

    Tracks of up to ``dp_frames`` frames get the fewest knots by dynamic programming, longer ones by greedy reach, which
    gives up after ``patience`` infeasible ends in a row. Tracks beyond ``limit`` rows are walked in chunks of ``chunk``
    rows (by default what ``CHUNK_BYTES`` hold); the answer does not depend on either.
    """
    by = list(by)
    types = dict(track.dtypes)
    key_ddl = ", ".join(f"{k} {types[k]}" for k in by)
    scale = F.col(inv_tol).cast("double") if inv_tol else F.lit(None).cast("double")
    rows = track.select(*by, F.col("pos").cast("long").alias("pos"), F.col("frame").cast("long").alias("frame"),
                        "pts", scale.alias("inv_tol"))
    solve, ddl = _solve_groups(tol, dp_frames, patience), "pos long, frame long, method string"
    # A position at or past the limit is what makes a track long.
    long = rows.where(F.col("pos") >= limit).agg(F.max(F.size("pts")).alias("width")).first()[0]
    if long is None:
        return by_group(rows, by, "pos", solve, ddl)
    chunk = chunk or max(GROUP_LIMIT, min(CHUNK, CHUNK_BYTES // (8 * max(1, long))))
    rows = with_totals(rows, by, {"_t": ("count", F.lit(1))}, chunk_id("pos"))
    short = rows.where(F.col("_t") <= limit).select(*by, "pos", "frame", "pts", "inv_tol")
    knots = _long_knots(rows.where(F.col("_t") > limit), by, tol, key_ddl, chunk, patience)
    return by_group(short, by, "pos", solve, ddl).unionByName(knots.withColumn("method", F.lit("greedy")))


def selection(track: DataFrame, knots: DataFrame, by: Sequence[str], size: int = CHUNK, tol: float | None = None,
              inv_tol: str | None = None) -> DataFrame:
    """Per track: knot count, worst point error of the chosen chords, exactness, method.

    The error is a distance in the track's own units also where the tolerance varied. With ``tol`` the range of tolerances in
    use is reported too: that value, or the frames' own, 1 / ``inv_tol``.
    """
    by = list(by)
    knots = cut(knots)  # read twice
    marked = track.select(*by, "pos", "pts").join(
        knots.select(*by, "pos", F.lit(True).alias("_k")), [*by, "pos"], "left")
    here = F.when(F.col("_k"), F.struct(F.col("pos").alias("p"), F.col("pts").alias("v")))
    fwd = last_known(marked, by, "pos", {"_a": here}, size)
    both = last_known(fwd, by, "pos", {"_b": here}, size, backward=True, keep=[*by, "pos", "pts", "_a"])
    u = "((pos - _a.p) / CAST(_b.p - _a.p AS DOUBLE))"
    miss = f"transform(pts, (v, i) -> power(_a.v[i] * (1 - {u}) + _b.v[i] * {u} - v, 2))"
    err = (f"CASE WHEN _b.p > _a.p THEN sqrt(array_max(transform(sequence(0, size(pts) div 2 - 1), "
           f"i -> {miss}[2 * i] + {miss}[2 * i + 1]))) ELSE 0D END")
    worst = both.groupBy(*by).agg(F.max(F.expr(err)).alias("max_error"))
    count = knots.groupBy(*by).agg(F.expr("count(1) AS n_knots"), F.expr("max(method) AS method"))
    out = count.join(worst, by).withColumn("exact", F.col("method") != "greedy")
    if tol is None:
        return out
    if inv_tol is None:
        return out.withColumns({"tol_min": F.lit(float(tol)), "tol_max": F.lit(float(tol))})
    used = track.groupBy(*by).agg(F.min(1 / F.col(inv_tol)).alias("_lo"), F.max(1 / F.col(inv_tol)).alias("_hi"))
    # A track of one or two frames is given back as it is, under the tolerance that was asked for.
    own = lambda c: F.when(F.col("method") == "trivial", F.lit(float(tol))).otherwise(F.col(c))
    return out.join(used, by).withColumns({"tol_min": own("_lo"), "tol_max": own("_hi")}).drop("_lo", "_hi")
