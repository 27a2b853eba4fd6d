"""Small column expressions used across the operators. All of them stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Banker's rounding, the rule every rounded quantity in the data model follows."""
    return F.bround(col(c), digits)


def seeded(seed: int, *key: str) -> Column:
    """A seeded order of rows that every engine can compute: the MD5 of seed and key as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in key]))


def hashed(seed: int, *key: Column | str) -> Column:
    """A whole number in [0, 2^52) that every engine can compute: the first 13 hex digits of ``seeded``."""
    return F.conv(F.substring(seeded(seed, *key), 1, 13), 16, 10).cast("long")


def seeded_chunk(order: Column | str) -> Column:
    """4,096 chunks that follow the order of ``seeded``."""
    return F.conv(F.substring(col(order), 1, 3), 16, 10).cast("long")


def ratio(num: Column, den: Column, empty=None) -> Column:
    """``num / den`` with ``empty`` where the denominator is zero or null."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(float(empty)))


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    """Aggregate: mean of ``x`` weighted by ``w`` over the rows where ``x`` is measured."""
    x, w = col(x), col(w).cast("double")
    return ratio(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def mean_where(x: Column | str, cond: Column) -> Column:
    return F.avg(F.when(cond, col(x)))


def uniform(seed: int, *cols: Column | str) -> Column:
    """Deterministic uniform in [0, 1) from the row's own key, stable under repartitioning."""
    h = F.xxhash64(F.lit(seed), *[col(c) for c in cols])
    return F.pmod(h, F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    """``log(1 + exp(x))`` without overflow on either side."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


IDENTITY4 = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]


def identity4() -> Column:
    return F.array(*[F.lit(v) for v in IDENTITY4])


def matmul4(a: Column, b: Column) -> Column:
    """Row-major 4x4 product of two 16-long arrays."""
    def cell(i: Column) -> Column:
        row = (F.floor(i / 4) * 4).cast("int")
        c = (i % 4).cast("int")
        return sum(
            (F.get(a, row + k) * F.get(b, c + 4 * k) for k in range(1, 4)),
            F.get(a, row) * F.get(b, c),
        )
    return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)


def element_name(shot: Column, layer: Column) -> Column:
    """``<shot>__<layer>`` with runs outside ``[A-Za-z0-9_.-]`` folded to ``_`` and trimmed."""
    safe = F.regexp_replace(layer, r"[^A-Za-z0-9_.\-]+", "_")
    safe = F.regexp_replace(safe, r"^_+|_+$", "")
    return F.concat(shot, F.lit("__"), F.when(safe == "", F.lit("unnamed")).otherwise(safe))
