"""Cutting lineage in the few loops that need it, through reliable storage only."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder below the one that the session names in ``spark.checkpoint.dir``; without one, a local test's own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="keyloom-")
    return f"{root.rstrip('/')}/keyloom-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the folder the session names in ``spark.checkpoint.dir``.

    Only when the session names none (a local test) is a temporary folder used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="keyloom-"))
    return df.checkpoint()
