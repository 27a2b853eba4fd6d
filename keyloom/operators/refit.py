"""Least-squares key values for fixed key frames and modes, by an exact partitioned solver.

Every frame is a weighted sum of at most four consecutive keys, so the normal equations are sums by (key, key) with keys at
most three apart: a banded system. It is cut into chunks of keys whose last three keys are a border:

1. each chunk solves its inner keys as functions of the borders on both sides, and reports what that leaves to the borders;
2. the borders of a track, three unknowns a chunk, form a block-tridiagonal system, solved in one sweep per track;
3. inner keys follow from their chunk's functions, as a column expression.

No chunk is cut off from its neighbours, so the result does not depend on where the cuts are. Where frames do not determine
all keys, the solution of least norm is taken: pseudo-inverses give it inside a chunk, and what is undetermined across borders
(null vectors of the border system) is projected out over the whole track.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..functions.groups import by_group, list_array, lists, numbers, whole
from ..functions.lineage import cut
from ..functions.ordered import CHUNK, chunk_id, last_known, positions, stencil

cloudpickle.register_pickle_by_value(sys.modules[__name__])

REFIT_CHUNK = 512
BAND = 3
RANK = 1e-11
"""Eigenvalues below this share of the largest count as zero."""


def basis_weights(keys: DataFrame, frames: DataFrame, by: Sequence[str], size: int = CHUNK) -> DataFrame:
    """``(by, frame, k, w)``: weight of key ``k`` in the interpolated value at ``frame``.

    At most four keys touch a frame, so the basis stays sparse rows.
    """
    by = list(by)
    idx = positions(keys.select(*by, "frame", "interp"), by, ["frame"], chunk_id("frame", size), "kidx")
    seg = stencil(idx, by, "kidx", {"f1": lambda w: F.lead("frame").over(w),
                                    "f2": lambda w: F.lead("frame", 2).over(w)}, 2, size)
    packed = seg.select(*by, "frame", F.struct("kidx", F.col("frame").alias("f0"), "f1", "f2", "interp").alias("s"))
    asked = frames.select(*by, "frame", F.lit(None).cast(packed.schema["s"].dataType).alias("s"), F.lit(True).alias("_ask"))
    both = packed.withColumn("_ask", F.lit(False)).unionByName(asked).groupBy(*by, "frame").agg(
        F.first("s", ignorenulls=True).alias("s"), F.bool_or("_ask").alias("_ask"))
    hit = last_known(both, by, "frame", {"_s": F.col("s")}, size, keep=[*by, "frame", "_ask"]).where("_ask")
    hit = hit.select(*by, "frame", "_s.*").withColumn(
        "_u", F.expr("CASE WHEN f1 > f0 THEN (frame - f0) / CAST(f1 - f0 AS DOUBLE) ELSE 0D END"))
    e = lambda k, w: f"named_struct('k', CAST({k} AS BIGINT), 'w', CAST({w} AS DOUBLE))"
    cr = ("array(" + ", ".join((
        e("CASE WHEN kidx > 0 THEN kidx - 1 ELSE kidx END", "0.5D * (-_u + 2 * _u * _u - _u * _u * _u)"),
        e("kidx", "0.5D * (2 - 5 * _u * _u + 3 * _u * _u * _u)"),
        e("kidx + 1", "0.5D * (_u + 4 * _u * _u - 3 * _u * _u * _u)"),
        e("CASE WHEN f2 IS NOT NULL THEN kidx + 2 ELSE kidx + 1 END", "0.5D * (-_u * _u + _u * _u * _u)"))) + ")")
    lin = f"array({e('kidx', '1 - _u')}, {e('kidx + 1', '_u')})"
    one = lambda k: f"array({e(k, '1')})"
    rows = hit.select(*by, F.col("frame"), F.explode(F.expr(
        f"CASE WHEN kidx IS NULL THEN {one('0')} WHEN f1 IS NULL OR interp = 'hold' THEN {one('kidx')} "
        f"WHEN interp = 'catmullrom' THEN {cr} ELSE {lin} END")).alias("_e"))
    return rows.groupBy(*by, "frame", F.col("_e.k").alias("k")).agg(F.sum("_e.w").alias("w")).where("w <> 0")


def pseudo_inverse(m: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of a symmetric positive semidefinite matrix on its range, and a basis (columns) of its null space."""
    value, vector = np.linalg.eigh((m + m.T) / 2)
    real = value > RANK * scale
    return (vector[:, real] / value[real]) @ vector[:, real].T, vector[:, ~real]


def inner_keys(at: np.ndarray, i: np.ndarray, j: np.ndarray, a: np.ndarray, y: np.ndarray, first: int,
               border: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Solve one chunk for its inner keys.

    ``at`` are its key numbers, ``(i, j, a)`` the entries of their equations, ``first`` its first key, ``border`` the first key of its own
    border (None for the last chunk). Unknowns are ordered: border before, inner keys, own border. Gives z and w, with inner keys
    = z - w @ (border before, own border), and the 6 x 6 matrix and right side that are left to the borders.
    """
    inner = at < border if border is not None else np.ones(len(at), bool)
    m, n = int(inner.sum()), len(at)
    full = np.zeros((BAND + n, BAND + n))
    here = j < first + n  # what couples the own border to the next chunk is that chunk's to report
    full[BAND + i[here] - first, BAND + j[here] - first] = a[here]
    # Equations of the border before belong to the chunk before; only their coupling to inner keys is needed.
    core = slice(BAND, BAND + m)
    outer = np.r_[0:BAND, BAND + m:BAND + n]
    coupling = full[core][:, outer]
    inverse, _ = pseudo_inverse(full[core, core], max(1e-300, np.abs(np.diag(full)).max()))
    z, w = inverse @ y[:m], inverse @ coupling
    left, right = -coupling.T @ w, -coupling.T @ z
    own = slice(BAND, len(outer))
    left[own, own] += full[BAND + m:, BAND + m:]
    right[own] += y[m:]
    width = 2 * BAND
    pad = width - len(outer)
    return z, np.pad(w, ((0, 0), (0, pad))), np.pad(left, ((0, pad), (0, pad))), np.pad(right, (0, pad))


def border_values(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, list[dict[int, np.ndarray]]]:
    """Borders of one track from its chunks' reports, (chunks, 6, 6) and (chunks, 6): (chunks, 3), the last unused.

    Block elimination from the first border to the last, with pseudo-inverses; also the null vectors, each as {border: values}.
    """
    n = len(left) - 1
    x = np.zeros((len(left), BAND))
    if n < 1:
        return x, []
    own = [left[c, BAND:, BAND:] + left[c + 1, :BAND, :BAND] for c in range(n)]
    off = [left[c + 1, :BAND, BAND:] for c in range(n - 1)]          # border c to border c + 1
    y = [right[c, BAND:] + right[c + 1, :BAND] for c in range(n)]
    scale = max(1e-300, max(float(np.abs(np.diag(d)).max()) for d in own))
    inverse, loose = [], []
    for c in range(n):
        if c:
            own[c] = own[c] - off[c - 1].T @ inverse[c - 1] @ off[c - 1]
            y[c] = y[c] - off[c - 1].T @ inverse[c - 1] @ y[c - 1]
        got, null = pseudo_inverse(own[c], scale)
        inverse.append(got)
        loose.append(null)
    for c in range(n - 1, -1, -1):
        x[c] = inverse[c] @ (y[c] - (off[c] @ x[c + 1] if c + 1 < n else 0))
    vectors = []
    for c in range(n):
        for column in loose[c].T:
            vector, at = {c: column}, c
            while at and np.abs(vector[at]).max() > 1e-15:
                at -= 1
                vector[at] = -inverse[at] @ (off[at] @ vector[at + 1])
            vectors.append(vector)
    return x, vectors


def normal_equations(raw: DataFrame, keys: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """``(by, i, row, y)``: row i of the banded system as entries (j, a), and its right side."""
    a = basis_weights(keys, raw, by)
    pairs = a.select(*by, "frame", F.col("k").alias("i"), F.col("w").alias("wi")).join(
        a.select(*by, "frame", F.col("k").alias("j"), F.col("w").alias("wj")), [*by, "frame"])
    gram = pairs.groupBy(*by, "i", "j").agg(F.expr("sum(wi * wj) AS a"))
    rhs = a.join(raw.select(*by, "frame", F.col(value).alias("_y")), [*by, "frame"]).groupBy(
        *by, F.col("k").alias("i")).agg(F.expr("sum(w * _y) AS y"))
    return gram.groupBy(*by, "i").agg(F.collect_list(F.struct("j", "a")).alias("row")).join(rhs, [*by, "i"])


def refit(raw: DataFrame, keys: DataFrame, by: Sequence[str], value: str = "value", chunk: int = REFIT_CHUNK) -> DataFrame:
    """Least-squares key values ``(by, kidx, frame, value)``; a key that no frame depends on gets 0."""
    if chunk < 2 * BAND + 1:
        raise ValueError(f"a chunk needs {2 * BAND + 1} keys")
    by = list(by)
    types = dict(keys.dtypes)
    key_ddl = ", ".join(f"{k} {types[k]}" for k in by)
    where = positions(keys.select(*by, "frame"), by, ["frame"], chunk_id("frame"), "kidx")
    # Keys that no frame depends on have an empty equation.
    eq = where.select(*by, F.col("kidx").alias("i")).join(normal_equations(raw, keys, by, value), [*by, "i"], "left")
    eq = eq.withColumn("_chunk", F.floor(F.col("i") / chunk))

    def inside(table: pa.Table, bounds: np.ndarray):
        at, chunks = table["i"].to_numpy(), table["_chunk"].to_numpy()
        y = numbers(table["y"])
        y = np.where(np.isnan(y), 0.0, y)
        entries, starts = lists(table["row"])
        row = np.repeat(at, np.diff(starts))
        j, a = entries.field("j").to_numpy(zero_copy_only=False), entries.field("a").to_numpy(zero_copy_only=False)
        got, places, full = [], [], []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            c = int(chunks[lo])
            # A chunk that is not full ends its track and has no border of its own.
            border = (c + 1) * chunk - BAND if hi - lo == chunk else None
            e = slice(starts[lo], starts[hi])
            got.append(inner_keys(at[lo:hi], row[e], j[e], a[e], y[lo:hi], c * chunk, border))
            places.append(at[lo:lo + len(got[-1][0])])
            full.append(border is not None)
        z, w, left, right = (np.concatenate([part.ravel() for part in parts]) for parts in zip(*got))
        inner, n = [len(p) for p in places], len(got)
        # The inner keys of all chunks, then one report a chunk.
        report = np.repeat([False, True], [len(z), n])
        wide = lambda items, on, size: list_array(pa.array(items), np.where(on, size, 0), ~on)
        return [*np.repeat(np.arange(n), inner), *range(n)], {
            "i": pa.array(np.concatenate([*places, np.zeros(n, np.int64)]), mask=report),
            "z": pa.array(np.concatenate([z, np.zeros(n)]), mask=report), "w": wide(w, ~report, 2 * BAND),
            "left": wide(left, report, 4 * BAND * BAND), "right": wide(right, report, 2 * BAND),
            "ends": pa.array(np.concatenate([np.zeros(len(z), bool), full]), mask=~report)}

    solved = cut(by_group(eq, [*by, "_chunk"], "i", inside,
                          "i long, z double, w array<double>, left array<double>, right array<double>, ends boolean"))

    def borders(table: pa.Table, bounds: np.ndarray):
        lefts = lists(table["left"])[0].to_numpy().reshape(-1, 2 * BAND, 2 * BAND)
        rights = lists(table["right"])[0].to_numpy().reshape(-1, 2 * BAND)
        ends = whole(table["ends"]).to_numpy(zero_copy_only=False).astype(bool)
        around = np.zeros((table.num_rows, 2 * BAND))
        nulls: list[list] = [[] for _ in range(table.num_rows)]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo == 1 and not ends[lo]:  # one chunk without borders
                continue
            left, right, n = lefts[lo:hi], rights[lo:hi], hi - lo
            if ends[hi - 1]:  # a full chunk ends the track: nothing follows its border
                left, right = np.concatenate([left, np.zeros((1, *left.shape[1:]))]), np.concatenate([right, np.zeros((1, 2 * BAND))])
            x, vectors = border_values(left, right)
            around[lo:hi] = np.concatenate([np.vstack([np.zeros((1, BAND)), x[:n - 1]]), x[:n]], axis=1)
            for v, vector in enumerate(vectors):
                for c in {k for b in vector for k in (b, b + 1) if k < n}:
                    both = np.concatenate([vector.get(c - 1, np.zeros(BAND)), vector.get(c, np.zeros(BAND))])
                    nulls[lo + c].append({"id": v, "v": both.tolist()})
        kind = pa.list_(pa.struct([("id", pa.int32()), ("v", pa.list_(pa.float64()))]))
        return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), {
            "_chunk": whole(table["_chunk"]), "ends": whole(table["ends"]),
            "b": list_array(pa.array(around.ravel()), np.full(len(around), 2 * BAND)), "nulls": pa.array(nulls, kind)}

    found = by_group(solved.where("left IS NOT NULL").select(*by, "_chunk", "left", "right", "ends"), by, "_chunk", borders,
                     "_chunk long, ends boolean, b array<double>, nulls array<struct<id: int, v: array<double>>>")
    found = cut(found)
    at_border = f"transform(sequence(0, {BAND - 1}), k -> struct((_chunk + 1) * {chunk} - {BAND} + k AS i, b[{BAND} + k] AS x, " \
                f"transform(nulls, e -> struct(e.id AS id, e.v[{BAND} + k] AS n)) AS nulls))"
    ends = found.where("ends").select(*by, F.explode(F.expr(at_border)).alias("e")).select(*by, "e.*")
    weigh = "aggregate(sequence(0, {n} - 1), 0D, (s, k) -> s + w[k] * {v}[k])"
    inner = solved.where("i IS NOT NULL").join(found, [*by, "_chunk"]).select(
        *by, "i", F.expr(f"z - {weigh.format(n=2 * BAND, v='b')}").alias("x"),
        F.expr(f"transform(nulls, e -> struct(e.id AS id, -{weigh.format(n=2 * BAND, v='e.v')} AS n))").alias("nulls"))
    every = where.withColumnRenamed("kidx", "i").join(inner.unionByName(ends), [*by, "i"])
    if found.where("size(nulls) > 0").isEmpty():  # the frames determine every border
        return every.select(*by, F.col("i").alias("kidx"), "frame", F.col("x").alias("value"))
    parts = every.select(*by, "i", "x", F.explode("nulls").alias("e")).select(*by, "i", "x", "e.*").where("n <> 0")
    gram = parts.select(*by, "i", F.col("id").alias("p"), F.col("n").alias("np")).join(
        parts.select(*by, "i", F.col("id").alias("q"), F.col("n").alias("nq")), [*by, "i"]).groupBy(*by, "p", "q").agg(
        F.expr("sum(np * nq) AS g"))
    along = parts.groupBy(*by, F.col("id").alias("p")).agg(F.expr("sum(n * x) AS g")).select(*by, "p", F.lit(-1).alias("q"), "g")

    def project(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["p"]))
        place = {v: k for k, v in enumerate(ids)}
        m, y = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
        for p, q, g in zip(pdf["p"], pdf["q"], pdf["g"]):
            if q < 0:
                y[place[p]] = g
            else:
                m[place[p], place[q]] = g
        out = pd.DataFrame({"id": ids, "share": np.linalg.lstsq(m, y, rcond=None)[0]})
        for k in reversed(by):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    share = gram.unionByName(along).groupBy(*by).applyInPandas(project, f"{key_ddl}, id int, share double")
    less = parts.join(share, [*by, "id"]).groupBy(*by, "i").agg(F.expr("sum(share * n) AS less"))
    return every.join(less, [*by, "i"], "left").select(
        *by, F.col("i").alias("kidx"), "frame", (F.col("x") - F.coalesce("less", F.lit(0.0))).alias("value"))


def residual(raw: DataFrame, keys: DataFrame, by: Sequence[str], fitted: DataFrame, value: str = "value") -> DataFrame:
    """Per track: keys, and the largest entry of the normal equations' residual; zero for a least-squares solution."""
    by = list(by)
    eq = normal_equations(raw, keys, by, value)
    terms = eq.select(*by, "i", "y", F.explode("row").alias("e")).select(*by, "i", "y", "e.*").join(
        fitted.select(*by, F.col("kidx").alias("j"), F.col("value").alias("x")), [*by, "j"])
    rest = terms.groupBy(*by, "i").agg(F.expr("abs(sum(a * x) - max(y)) AS r"))
    return fitted.groupBy(*by).agg(F.expr("count(1) AS n_keys")).join(rest.groupBy(*by).agg(F.expr("max(r) AS residual")), by, "left")
