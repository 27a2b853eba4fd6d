"""Versioned datasets and score sinks on any Hadoop-compatible storage.

A version exists from the moment its manifest does. ``write_version`` writes every table into a folder that belongs to
this attempt alone and puts the manifest last, under a name that must be free; it names the attempt's folder, the tables,
their schemas and row counts. So readers see a whole version or none, an attempt that died blocks nothing, and of two writers
one is refused. Overwriting adds the next manifest: whoever reads the former one keeps its files.

    <root>/datasets/<version>/manifests/000000.json
    <root>/datasets/<version>/data/<attempt>/<table>/by_shot=.../part-*.parquet

A table with a ``shot`` is partitioned by it, so reading a few shots lists and opens only their folders. ``by_shot`` repeats the shot
with a prefix, which keeps empty shots apart from null ones. Absent (False, None) is kept apart from a storage that cannot be asked
(``StorageUnavailable``). "Must be free" is as strict as the storage's rename without overwriting: atomic on HDFS and the like, a look
before the rename on a local disk.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

ABSENT, TAKEN = "java.io.FileNotFoundException", "org.apache.hadoop.fs.FileAlreadyExistsException"


class StorageUnavailable(RuntimeError):
    """The storage could not be asked, which is not the same as 'not there'."""


class _Storage:
    """The file operations that Spark's readers and writers do not offer."""

    def __init__(self, spark: SparkSession, root: str):
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.gateway = spark.sparkContext._gateway
        self.root = root
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._ask(lambda: self.hadoop.Path(root).getFileSystem(conf))
        self.conf = conf

    def _ask(self, what, **instead):
        """The answer, or ``instead`` by the kind of the error; anything else means that the storage cannot be asked."""
        try:
            return what()
        except Py4JJavaError as error:
            kind = error.java_exception.getClass().getName()
            if kind == ABSENT and "absent" in instead:
                return instead["absent"]
            if kind == TAKEN and "taken" in instead:
                return instead["taken"]
            raise StorageUnavailable(f"cannot ask {self.root}: {error.java_exception}") from error

    def any_file(self, prefix: str) -> bool:
        """Whether a file lies anywhere below ``prefix``: the listing is lazy and stops at the first."""
        return self._ask(lambda: self.fs.listFiles(self.hadoop.Path(prefix), True).hasNext(), absent=False)

    def names(self, folder: str) -> list[str]:
        """File names of a folder of a few files."""
        found = self._ask(lambda: self.fs.listStatus(self.hadoop.Path(folder)), absent=[])
        return sorted(f.getPath().getName() for f in found)

    def put_if_absent(self, path: str, text: str) -> bool:
        """Write a small file whole or not at all; False if the name is taken."""
        draft = self.hadoop.Path(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        out = self._ask(lambda: self.fs.create(draft))
        out.write(bytearray(text.encode()))
        out.close()
        files = self._ask(lambda: self.hadoop.FileContext.getFileContext(draft.toUri(), self.conf))
        plain = self.gateway.new_array(self.hadoop.Options.Rename, 0)
        free = self._ask(lambda: files.rename(draft, self.hadoop.Path(path), plain) or True, taken=False)
        if not free:
            self.fs.delete(draft, False)
        return free


def _folder(root: str, version: str) -> str:
    return f"{root.rstrip('/')}/datasets/{version}"


def prefix_exists(spark: SparkSession, prefix: str) -> bool:
    """Is there any file below ``prefix``? A missing or empty prefix is False."""
    return _Storage(spark, prefix).any_file(prefix)


def _published(spark: SparkSession, root: str, version: str) -> list[str]:
    folder = f"{_folder(root, version)}/manifests"
    return [f"{folder}/{n}" for n in _Storage(spark, root).names(folder) if n.endswith(".json") and not n.startswith(".")]


def version_exists(spark: SparkSession, root: str, version: str) -> bool:
    return bool(_published(spark, root, version))


def load_manifest(spark: SparkSession, root: str, version: str) -> dict | None:
    """The version's latest manifest, or None where there is none."""
    found = _published(spark, root, version)
    return json.loads(spark.read.text(found[-1], wholetext=True).first()[0]) if found else None


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> dict[str, dict]:
    """Write tables below ``folder`` and describe them; nothing is published.

    Rows of one shot are clustered by element and frame across many files, so a heavy shot does not become one file.
    """
    described = {}
    for name, df in tables.items():
        if "by_shot" in df.columns:
            raise ValueError(f"table {name}: by_shot is the name of the partition column")
        by_shot = "shot" in df.columns
        out = df.withColumn("by_shot", F.concat(F.lit("s_"), F.col("shot").cast("string"))) if by_shot else df
        keys = [c for c in ("shot", "element_id", "frame") if c in df.columns]
        seen = Observation()
        out = (out.repartitionByRange(*keys) if keys else out).observe(seen, F.count(F.lit(1)).alias("rows"))
        writer = out.write.partitionBy("by_shot") if by_shot else out.write
        writer.parquet(f"{folder}/{name}")
        described[name] = {"schema": json.loads(df.schema.json()), "rows": seen.get["rows"], "by_shot": by_shot}
    return described


def write_version(tables: Mapping[str, DataFrame], root: str, version: str, overwrite: bool = False,
                  facts: Mapping[str, object] | None = None) -> dict:
    """Write and publish a version; its manifest. ``facts`` (versions, crop, counts, ...) are recorded as given."""
    spark = next(iter(tables.values())).sparkSession
    found = _published(spark, root, version)
    if found and not overwrite:
        raise FileExistsError(f"dataset {version} already exists under {root}")
    attempt = uuid.uuid4().hex
    described = write_tables(tables, f"{_folder(root, version)}/data/{attempt}")
    manifest = {"version": version, "attempt": attempt, "facts": dict(facts or {}), "tables": described}
    path = f"{_folder(root, version)}/manifests/{len(found):06d}.json"
    if not _Storage(spark, root).put_if_absent(path, json.dumps(manifest, indent=1)):
        raise FileExistsError(f"dataset {version} was published by another writer meanwhile")
    return manifest


def read_version(spark: SparkSession, root: str, version: str, table: str, shots: Sequence[str | None] | None = None) -> DataFrame | None:
    """A table of a version, all of it or some shots, or None where version or table was never published."""
    manifest = load_manifest(spark, root, version)
    described = (manifest or {"tables": {}})["tables"].get(table)
    if described is None:
        return None
    schema = T.StructType.fromJson(described["schema"])
    path = f"{_folder(root, version)}/data/{manifest['attempt']}/{table}"
    if not described["by_shot"]:
        if shots is not None:
            raise ValueError(f"table {table} has no shots")
        return spark.read.schema(schema).parquet(path)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("by_shot", T.StringType())])).parquet(path)
    if shots is not None:
        wanted = F.col("by_shot").isin([f"s_{s}" for s in shots if s is not None])
        rows = rows.where(wanted | F.col("by_shot").isNull() if None in shots else wanted)
    return rows.select(*[F.col(f"`{f.name}`") for f in schema.fields])


def write_scores(summary: DataFrame, table: DataFrame, path: str) -> None:
    """Summary rows as JSON lines and the rendered table in layout order, next to the runs."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    # The layout has a few dozen rows, so one output file is bounded by construction.
    lines = table.select("section", "ordinal", F.expr(
        "concat(rpad(label, 38, ' '), ' ', lpad(value, 10, ' '), ' ', lpad(spread, 9, ' '))").alias("value"))
    lines.orderBy("section", "ordinal").select("value").coalesce(1).write.mode("overwrite").text(f"{path}/table")
