"""Adapters: the long tables the operators read, derived from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ordered import enough, positions

TRACK_BUCKET_MINUTES = 5
"""Width of the time buckets that bound one task's share of a track's history."""


def time_bucket(ts: str, minutes: int = TRACK_BUCKET_MINUTES):
    """Monotone bucket of a zone-less timestamp (no zone conversion, so no DST jumps)."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return day * (1440 // minutes) + F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """``(user_id, frame, event_id, *cols)`` on a dense frame axis per user.

    Callers name the value columns they read, so nothing else enters the shuffle.
    """
    ev = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", *cols)
    return positions(ev, ["user_id"], ["ts", "event_id"], time_bucket("ts"), "frame").select(
        "user_id", F.col("frame").cast("int").alias("frame"), "event_id", *cols)


TRACK_SQL = """track AS (
  SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER)
           AS frame, event_id, event_type, value FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, label, point_idx, x, y)``: each vector read as 32 planar points."""
    e = load(spark, sf_dir, "embeddings")
    xy = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(
        F.get("embedding", 2 * i).cast("double").alias("x"),
        F.get("embedding", 2 * i + 1).cast("double").alias("y")))
    return e.select("vec_id", "label", F.posexplode(xy).alias("point_idx", "p")).select(
        "vec_id", "label", "point_idx", "p.x", "p.y")


POINTS_SQL = """points AS (
  SELECT vec_id, label, CAST(i AS INTEGER) AS point_idx,
         CAST(embedding[2*i+1] AS DOUBLE) AS x, CAST(embedding[2*i+2] AS DOUBLE) AS y
  FROM embeddings, range(32) r(i))"""


HALVES_SQL = f"""{POINTS_SQL}, halves AS (
  SELECT vec_id * 2 + part AS vec_id, label, point_idx - part * k AS idx, CAST(CASE part WHEN 0 THEN k ELSE 32 - k END AS INTEGER) AS n, x, y
  FROM (SELECT *, CASE WHEN point_idx < k THEN 0 ELSE 1 END AS part FROM (
    SELECT *, CAST(CASE WHEN vec_id % 29 > 24 THEN 32 ELSE 4 + vec_id % 29 END AS INTEGER) AS k FROM points)))"""


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, label, idx, n, x, y)``: the points of each vector as two outlines, 2 * id and 2 * id + 1, of 4 to 32 points in all sizes."""
    p = points(spark, sf_dir).withColumn("k", F.expr("CAST(CASE WHEN vec_id % 29 > 24 THEN 32 ELSE 4 + vec_id % 29 END AS INT)"))
    p = p.withColumn("part", F.expr("CASE WHEN point_idx < k THEN 0 ELSE 1 END"))
    return p.selectExpr("vec_id * 2 + part AS vec_id", "label", "point_idx - part * k AS idx", "CASE part WHEN 0 THEN k ELSE 32 - k END AS n", "x", "y")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(side, frame, y, x, cov)``: two sparse coverage tables, zero pixels absent."""
    li = load(spark, sf_dir, "lineitem")
    key = ["side", "frame", "y", "x"]
    # Few rows share a pixel, so they are dealt as they are and combined once, in tasks of a bounded number of rows.
    cells = li.select(F.col("l_linestatus").alias("side"), F.col("l_suppkey").alias("frame"), F.col("l_linenumber").alias("y"),
                      (F.col("l_partkey") % 128).alias("x"), "l_discount").repartition(enough(li, li.count()), *key)
    return cells.groupBy(*key).agg(F.round(F.max("l_discount") * 10, 6).alias("cov")).where("cov > 0")


PIXELS_SQL = """pixels AS (
  SELECT l_linestatus AS side, l_suppkey AS frame, l_linenumber AS y, l_partkey % 128 AS x,
         round(max(l_discount) * 10, 6) AS cov
  FROM lineitem GROUP BY ALL HAVING round(max(l_discount) * 10, 6) > 0)"""


def frame_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame"))


def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (run, element, frame) score rows read off the line items."""
    li = load(spark, sf_dir, "lineitem")
    frame = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return li.select(
        F.col("l_returnflag").alias("run"), F.col("l_suppkey").alias("element_id"),
        frame.alias("frame"),
        (1 - F.col("l_discount")).alias("soft_iou"), (1 - F.col("l_tax")).alias("iou"),
        (F.col("l_quantity") / 10).alias("point_err"),
        F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).otherwise(F.lit(0.0))
         .alias("coverage"),
        (frame % 7 == 3).alias("held"),
        (F.col("l_linenumber") <= 2).alias("artist_key"),
        (F.col("l_quantity") < 12).alias("pred_key"))


FRAME_SCORES_SQL = """frame_scores AS (
  SELECT l_returnflag AS run, l_suppkey AS element_id, l_orderkey * 8 + l_linenumber AS frame,
         1 - l_discount AS soft_iou, 1 - l_tax AS iou, l_quantity / 10 AS point_err,
         CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0.0::DOUBLE END AS coverage,
         (l_orderkey * 8 + l_linenumber) % 7 = 3 AS held,
         l_linenumber <= 2 AS artist_key, l_quantity < 12 AS pred_key
  FROM lineitem)"""
