"""WARC archives without repeated payloads, by revisit resolution.

``capture`` writes one response record per row, without any shuffle. ``resolve`` then reads only the index of such
archives: headers are shuffled by payload digest, the smallest record of each digest is its original, and the others
are joined to it as revisits. ``rewrite`` deals the resolved headers by archive file, copies the payloads of responses from there
(checked against their digest), gives revisits a header and no payload, and writes everything as new archives with fresh
headers. ``read_archive`` reads archives record by record. No payload is ever shuffled.

Archives are WARC/1.1, one gzip member a record, in files of about ``roll`` bytes, on any storage that pyarrow
knows (local and mounted folders, S3, GCS, HDFS). A task writes files of names that no other attempt has, and reports them, with
every record's place, as rows of the folder's ``index`` table. Spark commits that table, so an attempt that was lost leaves files
that no index names and no reader opens. Memory is bounded by the longest record.

A null payload is empty. Payloads below ``least`` bytes are always responses. Of rows with equal payloads the one with the
smallest id, then url, then place in the archive, is the original; null ids come last, null urls first. Rows that repeat an id
are records of their own, so all but one of them revisit it. A null url gives a record without target; control
characters in urls are percent-encoded. An empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import attach, slices, stored

LEAST = 100
ROLL = 128 << 20
LEVEL = 3
"""Compression; archives are written once and read many times, but written twice here."""

INDEX = "file string, start long, length long, page_id long, url string, payload_bytes long, digest binary"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TEXT = "text/html; charset=utf-8"


# ---- records ----------------------------------------------------------------------------------

def record(fields: dict[str, object], block: bytes) -> bytes:
    """One record as a gzip member; fields without value are left out."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    head = f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode()
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of an unpacked record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or len(rest) != size + 4:
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    return fields, rest[:size]


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one after the other."""
    unpack, out, data = zlib.decompressobj(31), [], stream.read(chunk)
    while data:
        out.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(out)
            unpack, out = zlib.decompressobj(31), []
        data = data or stream.read(chunk)
    if out:
        raise ValueError("an archive ends inside a record")


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {TEXT}\r\nContent-Length: {size}\r\n\r\n".encode()


def target(url: str | None) -> str | None:
    return None if url is None else "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_id(archive: str, file: str, start: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}/{file}#{start}')}>"


class Archive:
    """The archive files of one task attempt. Each begins with a record about the archive."""

    def __init__(self, folder: str, date: str, roll: int):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.date, self.roll, self.out, self.file, self.at = date, roll, None, "", 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        """Where a record came to lie: file, start, length."""
        if self.out is None or self.at >= self.roll:
            self.close()
            self.file = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
            self.fs.create_dir(self.root, recursive=True)
            self.out, self.at = self.fs.open_output_stream(f"{self.root}/{self.file}", compression=None), 0
            self._write(record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("info", self.file, 0), "WARC-Date": self.date,
                                "Content-Type": "application/warc-fields"}, b"software: keyloom\r\nformat: WARC File Format 1.1\r\n"))
        start = self.at
        self._write(data)
        return self.file, start, len(data)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


# ---- capture, resolve, rewrite, read ------------------------------------------------------------

def now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def fields(kind: str, page_id: int | None, url: str | None, digest: bytes, identity: str, date: str) -> dict[str, object]:
    return {"WARC-Type": kind, "WARC-Record-ID": identity, "WARC-Date": date, "WARC-Target-URI": target(url), "X-Page-ID": page_id,
            "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha256:{digest.hex()}"}


def capture(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            date: str | None = None, roll: int = ROLL) -> DataFrame:
    """Write every row as a response record below ``folder``; its index."""
    date = date or now()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(folder, date, roll)
        for batch in batches:
            for part in slices(batch, "payload"):
                rows = []
                for page_id, url, payload in zip(*(part.column(n).to_pylist() for n in ("page_id", "url", "payload"))):
                    digest = hashlib.sha256(payload).digest()
                    head = fields("response", page_id, url, digest, f"<urn:uuid:{uuid.uuid4()}>", date)
                    place = archive.add(record(head, http_head(len(payload)) + payload))
                    rows.append((*place, page_id, url, len(payload), digest))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        archive.close()

    names = ["file", "start", "length", "page_id", "url", "payload_bytes", "digest"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    return indexed(rows.mapInArrow(write, INDEX), folder)


def indexed(index: DataFrame, folder: str) -> DataFrame:
    index.write.parquet(f"{folder}/index")
    return index.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """Every header with ``original``, the header that it revisits (page_id, url, file, start); null for a response."""
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url", "file", "start")
    groups = (headers.where(F.col("payload_bytes") >= least).groupBy("digest")
              .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("original")).where(F.col("n") > 1))
    found = attach(headers, stored(groups, "originals"), "digest")
    first = F.col("fact.original")
    revisits = first.isNotNull() & ~((F.col("file") == first.file) & (F.col("start") == first.start))
    return found.withColumn("original", F.when(revisits, first)).drop("fact")


def rewrite(resolved: DataFrame, source: str, folder: str, date: str | None = None, roll: int = ROLL) -> DataFrame:
    """Write the records of the archives in ``source``, responses with payload and revisits without; their index."""
    date = date or now()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, store, root = Archive(folder, date, roll), *fs.FileSystem.from_uri(source)
        opened, name = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                kind = "response" if r["original"] is None else "revisit"
                head = fields(kind, r["page_id"], r["url"], r["digest"], record_id(folder, r["file"], r["start"]), date)
                if r["original"] is None:
                    if r["file"] != name:
                        if opened is not None:
                            opened.close()
                        opened, name = store.open_input_file(f"{root}/{r['file']}"), r["file"]
                    block = parsed(zlib.decompress(opened.read_at(r["length"], r["start"]), 31))[1]
                    payload = block[len(block) - r["payload_bytes"]:]
                    if hashlib.sha256(payload).digest() != r["digest"]:
                        raise ValueError(f"payload of {name} at {r['start']} does not match its digest")
                else:
                    first = r["original"]
                    block = http_head(r["payload_bytes"])
                    head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(folder, first["file"], first["start"]),
                             "WARC-Refers-To-Target-URI": target(first["url"]), "WARC-Refers-To-Date": date,
                             "X-Refers-To-Page-ID": first["page_id"]}
                rows.append((*archive.add(record(head, block)), r["page_id"], r["url"], r["payload_bytes"], r["digest"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        archive.close()

    names = ["file", "start", "length", "page_id", "url", "payload_bytes", "digest"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    # As many tasks as files: the size of headers says nothing about the payloads that are copied.
    tasks = max(1, resolved.select("file").distinct().count())
    rows = resolved.select(*names, "original").repartition(tasks, "file").sortWithinPartitions("file", "start")
    return indexed(rows.mapInArrow(write, INDEX), folder)


def read_archive(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url per record, and on request the payload (null for
    revisits). Payloads are digested anew; one that differs from its header is an error."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows, held = [], 0
                    for raw in members(stream):
                        head, block = parsed(raw)
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        whole = head["WARC-Type"] == "response"
                        if whole and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its header")
                        page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                        rows.append((None if page is None else int(page), size, digest, head["WARC-Type"],
                                     None if refers is None else int(refers), head.get("WARC-Target-URI"),
                                     *([payload if whole else None] if with_payload else [])))
                        held += len(payload) if with_payload else 100
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * with_payload]
    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    files = spark.read.schema(INDEX).parquet(f"{folder}/index").select("file").distinct()
    return files.repartition(max(1, files.count()), "file").mapInArrow(read, shape + ", payload binary" * with_payload)


def write_deduplicated(pages: DataFrame, folder: str, least: int = LEAST, date: str | None = None, roll: int = ROLL, **columns) -> str:
    """Archive ``pages`` below ``folder`` without repeated payloads; the folder of the result."""
    date = date or now()
    headers = capture(pages, f"{folder}/captured", date=date, roll=roll, **columns)
    rewrite(resolve(headers, least), f"{folder}/captured", f"{folder}/archive", date, roll)
    return f"{folder}/archive"


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
