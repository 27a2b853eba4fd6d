"""Delivery listings: which files exist, what their names mean, which candidate a shot uses."""

from __future__ import annotations

import fnmatch
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The source travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed file-name rules. The frame number may follow a dot or an underscore.
AUTOSAVE = r"^(project|backup|autosave)(\.\d+)?\.sfx$"
FRAME = r"[._](\d+)\.exr$"
PREFERRED = "project.sfx"


class DeliveryListing(DataSource):
    """A file listing as a Spark source: ``spark.read.format("delivery_listing").load(root)``.

    The driver lists the folders of the first ``depth`` levels (1 by default: the shots); tasks walk the rest folder by folder, so
    no index of all files is ever in one place and no content is read. Options: ``depth``, ``glob`` on file names. Storage is
    whatever pyarrow knows: local and mounted folders, S3, GCS, HDFS.
    """

    @classmethod
    def name(cls) -> str:
        return "delivery_listing"

    def schema(self) -> str:
        return "path string, relpath string, size long, mtime timestamp"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"], int(self.options.get("depth", 1)), self.options.get("glob", "*"))


@dataclass
class Folders(InputPartition):
    """Folders that one task lists: whole trees, or their own files only."""
    whole: list[str]
    own: list[str]

    def __post_init__(self):
        super().__init__(None)


class ListingReader(DataSourceReader):
    def __init__(self, root: str, depth: int, glob: str):
        self.root, self.depth, self.glob = root.rstrip("/"), depth, glob

    def partitions(self) -> list[InputPartition]:
        store, top = fs.FileSystem.from_uri(self.root)
        own, level = [], [top]
        for _ in range(self.depth):
            own += level
            level = [f.path for at in level for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.Directory]
        out: list[InputPartition] = [Folders([], own[i:i + FOLDERS]) for i in range(0, len(own), FOLDERS)]
        return out + [Folders(level[i:i + FOLDERS], []) for i in range(0, len(level), FOLDERS)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        store, top = fs.FileSystem.from_uri(self.root)
        todo = [(at, True) for at in partition.whole] + [(at, False) for at in partition.own]
        while todo:
            at, deep = todo.pop()
            for f in store.get_file_info(fs.FileSelector(at)):
                if f.type == fs.FileType.Directory:
                    if deep:
                        todo.append((f.path, True))
                elif fnmatch.fnmatchcase(f.base_name, self.glob):
                    rel = f.path[len(top.rstrip("/")) + 1:]
                    yield f"{self.root}/{rel}", rel, f.size, f.mtime


FOLDERS = 16
"""Folders a task: a few, as one of them may hold most files."""


def list_files(spark: SparkSession, root: str, glob: str = "*", depth: int = 1) -> DataFrame:
    """``path, name, size, mtime, shot, kind, matte_kind, matte`` of every file; contents are never read."""
    spark.dataSource.register(DeliveryListing)
    files = spark.read.format("delivery_listing").option("glob", glob).option("depth", depth).load(root)
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size", "mtime",
        F.split_part("relpath", F.lit("/"), F.lit(1)).alias("shot"),
        F.when(F.col("relpath").rlike(r"^[^/]+/splines/silhouette/[^/]+\.sfx$"), "project")
         .when(F.col("relpath").rlike(r"^[^/]+/mattes/[^/]+/[^/]+/[^/]+\.exr$"), "matte").otherwise("other").alias("kind"),
        F.regexp_extract("relpath", r"/mattes/([^/]+)/", 1).alias("matte_kind"),
        F.regexp_extract("relpath", r"/mattes/[^/]+/([^/]+)/", 1).alias("matte"))


def classify_files(files: DataFrame, name: str = "name") -> DataFrame:
    """Autosave, preferred and frame number from the file name."""
    n = F.col(name)
    return files.select("*", n.rlike(AUTOSAVE).alias("is_autosave"), (n == PREFERRED).alias("is_preferred"),
                        F.expr(f"try_cast(nullif(regexp_extract({name}, '{FRAME}', 1), '') AS BIGINT)".replace("\\", "\\\\"))
                        .alias("frame"))


def pick_candidate(shots: DataFrame, cands: DataFrame) -> DataFrame:
    """One row per shot: chosen path, the reason, and how many candidates there were.

    Rungs: the preferred file if it parses; else the best positive agreement (ties: larger path);
    else the most shapes (ties: first in size order). Every rung is a mergeable aggregate, so a
    shot with many candidates is never gathered.
    """
    best = cands.groupBy("shot").agg(
        F.expr("count(1) AS n_candidates"), F.expr("count_if(parses) AS n_parsed"),
        F.expr(f"min_by(path, struct(-size, path)) FILTER (WHERE name = '{PREFERRED}' AND parses) AS r1"),
        F.expr("max(struct(agreement, path)) FILTER (WHERE parses AND agreement IS NOT NULL) AS r2"),
        F.expr("min_by(struct(n_shapes, path), struct(-n_shapes, -size, path)) FILTER (WHERE parses) AS r3"))
    j = shots.select("shot").join(best, "shot", "left")
    two = "r2.agreement > 0"
    return j.select(
        "shot", F.expr(f"CASE WHEN r1 IS NOT NULL THEN r1 WHEN {two} THEN r2.path ELSE r3.path END AS path"),
        F.expr(f"CASE WHEN n_candidates IS NULL THEN 'no .sfx found' WHEN r1 IS NOT NULL THEN '{PREFERRED} (rung 1)' "
               "WHEN n_parsed = 0 THEN concat('none of ', n_candidates, ' candidates parse') "
               f"WHEN {two} THEN concat('best EXR agreement ', format_string('%.4f', r2.agreement), ' (rung 2)') "
               "ELSE concat('most shapes, ', r3.n_shapes, ' (rung 3)') END AS reason"),
        F.expr("coalesce(n_candidates, 0L) AS n_candidates"))


def require_keys(df: DataFrame, wanted: DataFrame, column: str, what: str = "keys") -> DataFrame:
    """``df`` limited to the wanted keys; unknown ones are an error listing them sorted."""
    missing = wanted.select(column).distinct().join(df.select(column).distinct(), column, "left_anti")
    names = [str(r[0]) for r in missing.orderBy(column).collect()]
    if names:
        raise ValueError(f"unknown {what}: {names}")
    return df.join(wanted.select(column).distinct(), column, "left_semi")


def probe_frames(elements: DataFrame, n: int, duration: str = "duration") -> DataFrame:
    """``n`` frames spread over ``1 .. duration - 2``; two frames or fewer give them all."""
    d = duration
    spread = f"slice(sequence(1L, CAST({d} AS BIGINT) - 2, greatest(1L, CAST(({d} - 2) div {max(1, n)} AS BIGINT))), 1, {n})"
    short = f"CASE WHEN {d} <= 0 THEN CAST(array() AS ARRAY<BIGINT>) ELSE sequence(0L, CAST({d} AS BIGINT) - 1) END"
    keep = [c for c in elements.columns if c != duration]
    return elements.select(*keep, F.explode(F.expr(f"CASE WHEN {d} <= 2 THEN {short} ELSE {spread} END")).alias("frame"))


def sync_plan(src: DataFrame, dst: DataFrame) -> DataFrame:
    """What an incremental copy does with each source file; nothing is ever deleted.

    Same means equal size and equal whole-second mtime.
    """
    d = dst.select("relpath", F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.lit(True).alias("_have"))
    same = "size = _s AND date_trunc('SECOND', mtime) = date_trunc('SECOND', _m)"
    return src.join(d, "relpath", "left").select("relpath", "size", F.expr(
        f"CASE WHEN _have IS NULL THEN 'copy: missing' WHEN {same} THEN 'current' ELSE 'copy: changed' END AS action"))


def run_path(df: DataFrame) -> DataFrame:
    """Storage key of a run; local runs carry the user and never share a prefix with staging."""
    return df.withColumn("run_path", F.expr(
        "CASE WHEN environment = 'local' THEN concat_ws('/', 'runs', 'local', user, run) "
        "ELSE concat_ws('/', 'runs', environment, run) END")).withColumn(
        "dataset_path", F.expr("concat_ws('/', 'datasets', dataset_version)"))
