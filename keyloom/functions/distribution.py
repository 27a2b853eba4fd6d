"""Exact quantiles and modes whose memory does not grow with the largest group.

Spark's exact ``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here the values are first reduced to ``(group, value, count)`` with map-side combining, then
ranked by a two-level prefix sum, so no task ever holds one whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import RANGES, range_chunks, running_sum


def value_counts(df: DataFrame, by: Sequence[str], value: Column | str) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    return (df.select(*by, v.alias("_value")).where(F.col("_value").isNotNull())
            .groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_n")))


def quantile_table(df: DataFrame, by: Sequence[str], measures: Mapping[str, Mapping[str, float]],
                   ranges: int = RANGES) -> DataFrame:
    """One row per group with linearly interpolated quantiles: ``measures`` maps a value expression to ``{name: probability}``.

    All measures share one pass: values are counted per (group, measure, value), cut into ranges with about as many distinct
    values each, however unevenly they lie, and ranked by counts. A group without values of a measure has nulls there.
    """
    by = list(by)
    group = by or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    values = F.array(*[F.struct(F.lit(i).alias("_m"), F.expr(v).cast("double").alias("_value")) for i, v in enumerate(measures)])
    rows = src.select(*group, F.explode(values).alias("_v")).select(*group, "_v.*").where(F.col("_value").isNotNull())
    counts = range_chunks(rows.groupBy(*group, "_m", "_value").agg(F.count(F.lit(1)).alias("_n")), ["_m", "_value"], "_range", ranges)
    hits = running_sum(counts, [*group, "_m"], ["_value"], F.col("_range"), {"_upto": F.col("_n")}, totals=True
                       ).withColumnRenamed("_upto_total", "_total")
    start, stop = F.col("_upto") - F.col("_n"), F.col("_upto")
    aggs, outs = [], []
    for i, probs in enumerate(measures.values()):
        own = F.col("_m") == i
        for name, p in probs.items():
            pos = F.lit(float(p)) * (F.col("_total") - 1)
            lo, hi = F.floor(pos), F.ceil(pos)
            aggs += [F.max(F.when(own & (lo >= start) & (lo < stop), F.col("_value"))).alias(f"_lo_{name}"),
                     F.max(F.when(own & (hi >= start) & (hi < stop), F.col("_value"))).alias(f"_hi_{name}"),
                     F.max(F.when(own, pos - F.floor(pos))).alias(f"_f_{name}")]
            lo_c, hi_c, f_c = (F.col(f"_{t}_{name}") for t in ("lo", "hi", "f"))
            outs.append((lo_c + (hi_c - lo_c) * f_c).alias(name))
    return hits.groupBy(*group).agg(*aggs).select(*by, *outs)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], buckets: int = RANGES) -> DataFrame:
    """One row per group with linearly interpolated quantiles under the given names."""
    return quantile_table(df, by, {value: probs}, buckets)


def mode_of(df: DataFrame, by: Sequence[str], value: Column | str, name: str = "mode",
            tie: str = "smallest") -> DataFrame:
    """Most frequent value per group; ties go to the smallest (or largest) value."""
    counts = value_counts(df, by, value)
    if tie == "smallest":
        best = F.min_by("_value", F.struct(-F.col("_n"), F.col("_value")))
    else:
        best = F.max_by("_value", F.struct(F.col("_n"), F.col("_value")))
    return counts.groupBy(*by).agg(best.alias(name), F.max("_n").alias(f"{name}_count"))
