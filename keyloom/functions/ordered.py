"""Ordered computations that never place one whole track in a single task.

A plain ``Window.partitionBy(track)`` sends every row of a track to one task, so a track that
holds a third of the table stalls the job. The primitives here cut each track into chunks of
consecutive positions and partition on ``(track, chunk)`` instead:

``stencil``      bounded neighbourhood (lag/lead/moving frames): rows within ``reach`` of a chunk
                 edge are also sent to the neighbouring chunk, so one shuffle is enough.
``last_known``   unbounded look-back: per-chunk scan plus a carry computed over one summary row
                 per chunk.
``running_sum``  prefix sums, same two-level shape.
``positions``    dense 0-based positions in an arbitrary order, same two-level shape.

A chunk follows the order: equal steps of a position or time (``chunk_id``), or, for keys of any type and spread,
ranges with about the same number of rows each (``range_chunks``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

CHUNK = 65536
"""Positions per chunk: large enough that ordinary tracks are one chunk."""


def chunk_id(order: Column | str, size: int = CHUNK) -> Column:
    c = F.col(order) if isinstance(order, str) else order
    return F.coalesce(F.floor(c / size), F.lit(0)).cast("long")


def _shared(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partition once so the detail branch and the summary branch read one exchange."""
    return df.repartition(*[F.col(k) for k in keys])


TASK_ROWS = 1 << 20
"""Rows that one task may hold in the table of an aggregation."""


def enough(df: DataFrame, rows: int) -> int:
    """How many partitions ``rows`` rows need, the session's shuffle partitions at least.

    Adaptive execution joins partitions up to 64 MB of compressed rows, which can be many millions, and a fixed number
    grows with the table. A partitioning by this number does neither, so what a task holds is bounded.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def _touch(column: Column, kind: T.DataType) -> Column:
    """A number that reads a column of any type, so that its maximum keeps a fixed-width buffer."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(column)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.size(column)
    if isinstance(kind, T.StructType) and kind.fields:
        return _touch(column.getField(kind.fields[0].name), kind.fields[0].dataType)
    return column if isinstance(kind, (T.NumericType, T.BooleanType)) else column.isNull()


def _summary(shared: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Per-chunk aggregates over the shared exchange.

    The filter is always true. It keeps column pruning from narrowing this branch's exchange, which would make
    it differ from the detail branch's and force a second upstream run. It reads a number per
    column, so the aggregate stays a hash aggregate and takes columns of every type.
    """
    others = [f for f in shared.schema.fields if f.name not in keys]
    seen = [F.max(_touch(F.col(f"`{f.name}`"), f.dataType)).alias(f"_any{i}") for i, f in enumerate(others)]
    out = shared.groupBy(*keys).agg(*aggs, *seen)
    names = [f"_any{i}" for i in range(len(others))]
    return (out.where(F.pmod(F.hash(*names), F.lit(7)) >= 0) if names else out).drop(*names)


def stencil(df: DataFrame, by: Sequence[str], order: str,
            exprs: Mapping[str, Callable[[WindowSpec], Column]] | Sequence[Mapping],
            reach: int, size: int = CHUNK, within: Sequence[str] = ()) -> DataFrame:
    """Add window columns that look at most ``reach`` order units away.

    ``exprs`` maps an output name to a function of the window spec; a sequence of such maps is
    evaluated stage by stage over the same shuffle (``reach`` is then the total look-around).
    ``within`` adds partition columns that refine ``by`` without taking part in chunking.
    """
    stages = [exprs] if isinstance(exprs, Mapping) else list(exprs)
    home = chunk_id(order, size)
    o = F.col(order)
    lo, hi = chunk_id(o - reach, size), chunk_id(o + reach, size)
    near = F.sequence(lo, hi) if reach >= size else F.array_distinct(F.array(home, lo, hi))
    spread = df.withColumn("_chunk", F.explode(near))
    w = Window.partitionBy(*by, "_chunk", *within).orderBy(order)
    out = spread
    for stage in stages:
        out = out.select("*", *[fn(w).alias(name) for name, fn in stage.items()])
    return out.where(F.col("_chunk") == home).drop("_chunk")


def last_known(df: DataFrame, by: Sequence[str], order: str, marks: Mapping[str, Column],
               size: int = CHUNK, inclusive: bool = True, backward: bool = False,
               keep: Sequence[str] | None = None, chunk: Column | None = None) -> DataFrame:
    """For each row, the latest non-null value of each mark at or before it.

    ``inclusive=False`` looks strictly before; ``backward=True`` looks at or after instead.
    ``keep`` names the input columns the result carries (default: all); columns that are only
    read by the marks should be left out so they are not shuffled. ``chunk`` replaces the chunks of ``size`` order units.
    """
    keep = list(df.columns if keep is None else keep)
    base = df.select(*keep, *[c for c in [*by, order] if c not in keep],
                     (chunk_id(order, size) if chunk is None else chunk).alias("_chunk"),
                     *[m.alias(f"_m_{n}") for n, m in marks.items()])
    base = _shared(base, [*by, "_chunk"])
    rank = F.col(order)
    pick = F.min_by if backward else F.max_by
    summary = _summary(base, [*by, "_chunk"], [
        pick(F.col(f"_m_{n}"), F.when(F.col(f"_m_{n}").isNotNull(), rank)).alias(f"_s_{n}")
        for n in marks])
    key = F.col("_chunk").desc() if backward else F.col("_chunk")
    across = (Window.partitionBy(*by).orderBy(key)
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = summary.select(*by, "_chunk", *[
        F.last(f"_s_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in marks])
    inside = (Window.partitionBy(*by, "_chunk").orderBy(rank.desc() if backward else rank)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = base.select("*", *[
        F.last(f"_m_{n}", ignorenulls=True).over(inside).alias(f"_l_{n}") for n in marks])
    joined = local.join(carry, [*by, "_chunk"])
    return joined.select(*keep, *[
        F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in marks])


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], chunk: Column,
                sums: Mapping[str, Column], inclusive: bool = True,
                totals: bool = False) -> DataFrame:
    """Prefix sums per group. ``chunk`` must not decrease along ``order`` within a group.

    ``totals=True`` also attaches each group's full sum as ``<name>_total``.
    """
    base = df.select("*", F.coalesce(chunk, F.lit(0)).alias("_chunk"), *[c.alias(f"_v_{n}") for n, c in sums.items()])
    base = _shared(base, [*by, "_chunk"])
    across = (Window.partitionBy(*by).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = (_summary(base, [*by, "_chunk"], [F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
             .select(*by, "_chunk", *[
                 F.coalesce(F.sum(f"_s_{n}").over(across), F.lit(0)).alias(f"_c_{n}")
                 for n in sums],
                 *[F.sum(f"_s_{n}").over(Window.partitionBy(*by)).alias(f"{n}_total")
                   for n in sums if totals]))
    inside = (Window.partitionBy(*by, "_chunk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = base.select("*", *[
        F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_l_{n}") for n in sums])
    return local.join(carry, [*by, "_chunk"]).select(*df.columns, *[
        (F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums],
        *[f"{n}_total" for n in sums if totals])


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], chunk: Column,
              name: str = "frame") -> DataFrame:
    """0-based position of each row in its group. ``chunk`` must follow ``order``."""
    base = _shared(df.withColumn("_chunk", F.coalesce(chunk, F.lit(0))), [*by, "_chunk"])
    across = (Window.partitionBy(*by).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = (_summary(base, [*by, "_chunk"], [F.count(F.lit(1)).alias("_n")])
             .select(*by, "_chunk",
                     F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before")))
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order)
    return (base.withColumn("_rn", F.row_number().over(inside))
            .join(carry, [*by, "_chunk"])
            .select(*df.columns, (F.col("_before") + F.col("_rn") - 1).alias(name)))


SPREAD = 64

_MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
_FIRST = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def with_totals(df: DataFrame, by: Sequence[str], totals: Mapping[str, tuple[str, Column]],
                chunk: Column) -> DataFrame:
    """Attach per-group aggregates to every row without gathering a group in one task.

    ``totals`` maps a name to ``(sum|count|max|min, column)``. Groups are split by ``chunk``
    (any expression that spreads a large group); the join back is on ``(by, chunk)``.
    """
    base = _shared(df.withColumn("_chunk", F.coalesce(chunk, F.lit(0))), [*by, "_chunk"])
    part = _summary(base, [*by, "_chunk"], [
        _FIRST[kind](c).alias(f"_p_{n}") for n, (kind, c) in totals.items()])
    whole = Window.partitionBy(*by)
    part = part.select(*by, "_chunk", *[
        _MERGE[kind](f"_p_{n}").over(whole).alias(n) for n, (kind, _) in totals.items()])
    return base.join(part, [*by, "_chunk"]).drop("_chunk")


def spread(*key: str) -> Column:
    """A chunk for ``with_totals`` that scatters a group's rows by their own key."""
    return F.pmod(F.xxhash64(*key), F.lit(SPREAD))


def lookup(big: DataFrame, small: DataFrame, on: Sequence[str], key: Sequence[str],
           how: str = "inner", salts: int = SPREAD) -> DataFrame:
    """Join a table of one row per ``on`` to a large one whose ``on`` values may be very uneven.

    The one-row side is repeated per salt and the large side picks a salt from its own ``key``,
    so a heavy value is shared by ``salts`` tasks.
    """
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int"))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


RANGES = 1024
DRAWS = 32
STEP = 32


def range_chunks(df: DataFrame, order: Sequence[str], name: str = "_range", ranges: int = RANGES) -> DataFrame:
    """``df`` with a chunk number that follows ``order`` (nulls first), for columns of any orderable type.

    The boundaries between chunks are evenly spaced in a sample of ``DRAWS`` rows a range, drawn by the hash of the key, so
    chunks hold about the same number of distinct keys whatever their distribution. The sample is one row on its way
    to the tasks, with at most ``ranges - 1`` keys. Rows with equal keys share a chunk.
    """
    sample = df.select(F.struct(*order).alias("_k")).orderBy(F.xxhash64("_k"), "_k").limit(ranges * DRAWS)
    # Of 1,024 sorted boundaries, every 32nd finds the block, and the block finds the place: 64 comparisons a row.
    bounds = sample.agg(F.array_sort(F.collect_list("_k")).alias("_s")).selectExpr(
        f"transform(sequence(1, {ranges} - 1), i -> get(_s, CAST(i * size(_s) DIV {ranges} AS INT))) AS _fine").selectExpr(
        "_fine", f"transform(sequence(1, size(_fine) DIV {STEP}), i -> get(_fine, i * {STEP} - 1)) AS _coarse"
        if ranges > STEP else "slice(_fine, 1, 0) AS _coarse")
    key = F.struct(*order)
    wide = df.crossJoin(F.broadcast(bounds)).withColumn("_c", F.size(F.filter("_coarse", lambda x: x <= key)))
    block = F.slice("_fine", F.col("_c") * STEP + 1, F.lit(STEP))
    place = (F.col("_c") * STEP + F.size(F.filter(block, lambda x: x <= key))).cast("long")
    return wide.withColumn(name, place).drop("_fine", "_coarse", "_c")


def ranked(df: DataFrame, by: Sequence[str], first: Column, order: Sequence[str | Column],
           name: str, ranges: int = RANGES) -> DataFrame:
    """0-based rank where ``first`` is the leading sort key, ascending, of any type."""
    wide = range_chunks(df.withColumn("_first_key", first), ["_first_key"], "_range", ranges)
    return positions(wide, by, order, F.col("_range"), name).select(*df.columns, name)
