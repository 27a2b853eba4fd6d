"""Mixing sources to target weights by capped water-filling.

The share of each source follows its weight until that would need more than ``max_epochs`` passes over
it; such sources are clamped there and what they leave goes to the others by weight, until none is
above its cap. Clamping in the order of cap over weight reaches that point in one pass over sources.

A source's rate (target over size) is its number of whole repetitions plus a fraction. Documents have a
seeded order inside their source; the extra repetition goes to the first ones in it, up to the
document whose middle lies nearest to the fraction of the source's words. So every source
misses its target by about half a document at most, no document is taken more than ``max_epochs`` times
(``max_epochs`` is whole), and reruns agree. The cut is found without sorting a source: words are summed
per hash bucket, and only the bucket that holds the cut is ordered row by row.

Null texts have size 0. A null source is a source of its own, last in order. Null or repeated ``doc_id``
rows each count; equal ones are ordered by size and text digest. A source without words has target 0 and
nothing is taken. An empty table gives an empty table. Other columns stay out of the digest, and
``expand`` keeps all columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import column, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
FEW_SOURCES = 100_000
"""Up to so many sources (some 20 MB) the plan is broadcast; beyond, it is an ordinary join."""


def order_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"mix-{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def water_fill(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """source, source_size -> also weight and target. One row per source, so its windows are small."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), place.cast("int") + 1)
    table = (sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
             .withColumn("ratio", F.col("cap").cast("double") / F.col("weight")))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0))
    clamped = left.cast("double") / F.sum("weight").over(after) >= F.col("ratio")
    table = table.withColumn("total", total).withColumn("clamped", clamped)
    free = F.col("total") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(everything)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(
        free.cast("double") * F.col("weight") / open_weight)
    return table.select("source", "source_size", "weight", target.alias("target"))


def mixing_plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """Per source: target, whole repetitions, and the last document in order that gets an extra one.

    ``sized`` has source, size, key, digest.
    """
    bucket = F.substring("key", 1, 4)
    sums = stored(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "buckets")
    sources = water_fill(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn(
        "extra", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = stored(sources.withColumn("source_id", F.row_number().over(Window.orderBy("source"))), "sources")
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = (sums.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0)))
           .join(few(sources), sums.source.eqNullSafe(sources.source)).drop(sources.source)
           .where((F.col("before") <= F.col("extra")) & (F.col("before") + F.col("words") > F.col("extra")))
           .select("source_id", "bucket", "before", "extra"))
    ids = few(sources.select(F.col("source").alias("s"), "source_id"))
    inside = (sized.join(ids, sized.source.eqNullSafe(F.col("s"))).withColumn("bucket", bucket)
              .join(few(cut), ["source_id", "bucket"]))
    rank = F.struct("key", "size", "digest")
    upto = Window.partitionBy("source_id").orderBy("key", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(upto), F.lit(0)) + F.col("size") / 2
    last = (inside.withColumn("middle", middle).withColumn("rank", rank).groupBy("source_id")
            .agg(F.max(F.when(F.col("middle") <= F.col("extra"), F.col("rank"))).alias("last"),
                 F.first("bucket").alias("bucket")))
    return stored(sources.join(last, "source_id", "left").drop("source_id", "extra"), "plan")


def few(df: DataFrame) -> DataFrame:
    """Broadcast a table of about one row per source if those are few."""
    return F.broadcast(df) if df.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else df


def with_repeats(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3,
                 id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 keep_columns: bool = False) -> DataFrame:
    """row (the id; with ``keep_columns`` a struct of all columns), size, source_size, target, repeats per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = {"source": F.col(source_col), "size": F.regexp_count(text, F.lit(WORD)).cast("long"),
           "key": order_key(F.col(id_col), seed), "digest": F.md5(text)}
    named = F.struct(*[c.alias(n) for n, c in own.items()]).alias("own")
    sized = stored(docs.select(named).select("own.*"), "sized")
    plan = few(mixing_plan(sized, weights, max_epochs).select(F.struct("*").alias("plan")))
    # The input's columns travel inside one column, so their names meet no others.
    row = F.struct(*[column(c) for c in docs.columns]) if keep_columns else F.col(id_col).cast("long")
    joined = docs.select(row.alias("row"), named).join(plan, F.col("own.source").eqNullSafe(F.col("plan.source")))
    rank = F.struct("own.key", "own.size", "own.digest")
    # Without a document at or below the cut in its bucket, the earlier buckets still get their extra one.
    first = F.when(F.substring("own.key", 1, 4) < F.col("plan.bucket"), F.lit(True)).otherwise(F.coalesce(rank <= F.col("plan.last"), F.lit(False)))
    # Where whole repetitions meet the target there is no extra one, and a document without words never needs it.
    extra = (F.col("own.size") > 0) & (F.col("plan.target") > F.col("plan.whole") * F.col("plan.source_size")) & F.coalesce(first, F.lit(False))
    return joined.select("row", "own.size", "plan.source_size", "plan.target", (F.col("plan.whole") + extra.cast("long")).alias("repeats"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and repeats per document."""
    return with_repeats(docs, **options).select(
        F.col("row").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


def expand(docs: DataFrame, **options) -> DataFrame:
    """The mixed table itself: every document as often as the mix takes it, with its own columns."""
    rows = with_repeats(docs, keep_columns=True, **options).where(F.col("repeats") > 0)
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key, md5(coalesce(text, '')) AS digest
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE
         ELSE 1.0::DOUBLE END AS weight, 3 * source_size AS cap FROM src),
ordered AS (
  SELECT *, cap::DOUBLE / weight AS ratio, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_after FROM weighed),
flagged AS (SELECT *, (total - cap_before)::DOUBLE / weight_after >= ratio AS clamped FROM ordered),
targets AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE
    ELSE (total - coalesce(sum(CASE WHEN clamped THEN cap END) OVER (), 0))::DOUBLE * weight
         / sum(CASE WHEN NOT clamped THEN weight END) OVER () END AS target FROM flagged),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS extra,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size, s.digest
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND extra > 0 AND before + size / 2.0::DOUBLE <= extra THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(whole + CASE WHEN size > 0 AND extra > 0 AND before + size / 2.0::DOUBLE <= extra THEN 1 ELSE 0 END AS BIGINT) AS repeats
FROM placed
"""
