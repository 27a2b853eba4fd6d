"""Files with names of their own, written by tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def put_files(rows: DataFrame, root: str) -> DataFrame:
    """``(relpath, content)`` rows as files below ``root``, ``(relpath, size)`` of what was written; runs when read.

    A task that runs again writes the same names again. Storage is whatever pyarrow knows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            sizes = []
            for relpath, content in zip(batch.column("relpath"), batch.column("content")):
                path, data = f"{top}/{relpath.as_py()}", content.as_py() or b""
                folder = path.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(path, compression=None) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("relpath"), pa.array(sizes, pa.int64())], names=["relpath", "size"])
    return rows.select("relpath", "content").mapInArrow(run, "relpath string, size long")
