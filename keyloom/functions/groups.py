"""Python on many small groups: whole groups in blocks of rows, not one call of Python per group.

``applyInPandas`` builds frames for every group, some eight milliseconds each, and adaptive execution puts groups of few bytes
into one or two tasks. With a few dozen rows a group that is the whole cost of a query.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Solver = Callable[[pa.Table, np.ndarray], tuple[Sequence[int], dict[str, pa.Array]]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a sorted partition, with where each starts and where the last one ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        first = np.flatnonzero(batch.column("_rn").to_numpy() == 1)
        if len(first):
            held.append(batch.slice(0, int(first[-1])))
            if sum(b.num_rows for b in held):
                yield _block(held)
            batch, held = batch.slice(int(first[-1])), []
        held.append(batch)
    if sum(b.num_rows for b in held):
        yield _block(held)


def _block(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    return table, np.append(np.flatnonzero(table["_rn"].to_numpy() == 1), table.num_rows)


def whole(column: pa.ChunkedArray) -> pa.Array:
    """A column of a block as one array."""
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A column of numbers as doubles, null as NaN."""
    return whole(column).cast(pa.float64()).to_numpy(zero_copy_only=False)


def lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The items of a column of lists, and where each list starts and the last one ends; null as empty."""
    own = whole(column)
    return own.flatten(), np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(own), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def list_array(items: pa.Array, sizes: Sequence[int], missing: np.ndarray | None = None) -> pa.Array:
    """Lists of the given sizes, cut from ``items``; null where ``missing``."""
    ends = pa.array(np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, items, mask=None if missing is None else pa.array(missing))


def by_group(df: DataFrame, keys: Sequence[str], order: str, solve: Solver, ddl: str) -> DataFrame:
    """``keys`` and the columns of ``ddl`` that ``solve`` gives for the groups of ``keys``, each in ``order``.

    ``solve`` takes a block of whole groups as a table and the rows where they start (and the end), and gives for
    every row of its result the number of its group in the block, and the columns. A task holds one batch of rows and the group that runs
    on from it. There are as many tasks as shuffle partitions, however few bytes the rows have.
    """
    keys = list(keys)
    types = dict(df.dtypes)
    names = [c.split()[0].strip("`") for c in _fields(ddl)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.repartition(parts, *keys).withColumn("_rn", F.row_number().over(w)).sortWithinPartitions(*keys, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _blocks(batches):
            group, columns = solve(table, bounds)
            at = pa.array(bounds[:-1][np.asarray(group, dtype=np.int64)])
            own = [whole(table[k].take(at)) for k in keys]
            yield from pa.Table.from_arrays([*own, *[columns[n] for n in names]], names=[*keys, *names]).to_batches()

    return marked.mapInArrow(run, ", ".join([*[f"`{k}` {types[k]}" for k in keys], ddl]))


def _fields(ddl: str) -> list[str]:
    """The top-level fields of a schema string."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]
