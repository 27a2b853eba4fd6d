"""Small helpers that the operators of this package share."""

from __future__ import annotations

import sys
import tempfile
import time
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WHITE = b" \t\n\x0b\x0c\r"
"""The white space of every word and line rule here: U+0020 and U+0009 to U+000D."""


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the session names in ``spark.checkpoint.dir``.

    Only a local session that names none (a test) gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        if named.isDefined():
            root = named.get()
        elif spark.sparkContext.master.startswith("local"):
            root = tempfile.mkdtemp(prefix="keyloom-llm-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/keyloom-llm-{uuid.uuid4().hex}"


def column(name: str) -> Column:
    """A column of any name."""
    return F.col("`" + name.replace("`", "``") + "`")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


IDLE = 20.0


def worker_cache() -> dict[Any, list]:
    """Objects that a reused Python worker keeps between tasks (loaded vocabularies, word tables), each with the time of its last use."""
    return sys.modules.setdefault("_keyloom_worker", types.ModuleType("_keyloom_worker")).__dict__.setdefault("kept", {})


def keep(key: Any, make: Callable[[], Any]) -> Any:
    """The object of this key, made at its first use. Others that no task asked for in ``IDLE`` seconds are let go, so
    that what one operator loaded does not stay in memory while the next one runs."""
    kept, now = worker_cache(), time.monotonic()
    if key not in kept:
        kept[key] = [make(), now]
    kept[key][1] = now
    if any(now - used > IDLE for _, used in kept.values()):
        for other in [k for k, (_, used) in kept.items() if now - used > IDLE]:
            del kept[other]
    return kept[key][0]


class Kept(dict):
    """A bounded table that makes absent values, in two generations: what was not asked for during a whole
    generation is dropped."""

    def __init__(self, size: int, make: Callable[[Any], Any]):
        super().__init__()
        self.size, self.make, self.old = size, make, {}

    def __missing__(self, key: Any) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def recall(self, keys: set) -> None:
        """Make room for ``keys`` and bring back those that the former generation knows, before they are used."""
        known = {k: v for k in keys if (v := self.old.get(k)) is not None}
        if len(self) + len(keys) > self.size:
            self.old = dict(self)
            self.clear()
        self.update(known)

    def put(self, key: Any, value: Any) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch of about ``limit`` bytes in ``column`` each, one row at least."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def shape(**columns: str) -> str:
    return ", ".join(f"{k} {v}" for k, v in columns.items())


HOT_SHARE = 1000


def attach(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` with one more column, ``fact``: the row of ``facts`` for its key, or null.

    ``facts`` has one row per ``key`` and, in ``n``, how many of ``rows`` have it. Keys with more than a thousandth of
    all counted rows, 1,000 at most, go by broadcast; the others meet in an ordinary join, where none is large. Nulls are a
    key like others. Both tables are read twice, so they should be stored.
    """
    facts = facts.select(F.col(key).alias("_key"), F.struct(*facts.columns).alias("fact"), "n")
    total = facts.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_SHARE > total
    hot, cold = F.broadcast(facts.where(is_hot).drop("n")), facts.where(~is_hot).drop("n")
    same = F.col(key).eqNullSafe(F.col("_key"))
    rest = rows.join(hot, same, "left_anti").join(cold, same, "left")
    return rows.join(hot, same).unionByName(rest).drop("_key")
