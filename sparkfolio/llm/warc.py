"""WARC archives: write, normalise to one gzip member per record with an offset index, read.

Each task streams into files of the shared folder through ``pyarrow.fs``, so any store works
that both Spark and Arrow know.  A file's name holds the task attempt and only files in the
written manifest count, so a lost or repeated task does no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import written
from sparkfolio.session import work_dir

#: Bytes of payload after which a task starts its next archive.
ROLL = 256 << 20
#: Compressed bytes that one task reads back.
TASK_BYTES = 4 << 20
#: Bytes moved at once while a record is copied.
COPY = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def payload_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_bytes(page_id: str | None, url: str | None, date: str, sha1: bytes, size: int, payload: bytes | None, refers_to: str | None) -> bytes:
    """One WARC/1.1 record.  A revisit (payload None) keeps the HTTP header with the full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id or ''}>", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to or ''}>"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(sha1)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class _Archive:
    """A file that is one gzip stream from beginning to end."""

    def __init__(self, store: fs.FileSystem, path: str, level: int):
        self.path, self.records, self.size = path, 0, 0
        self.out = store.open_output_stream(path, compression=None)
        self.zip = zlib.compressobj(level, zlib.DEFLATED, 31)

    def add(self, record: bytes) -> None:
        self.out.write(self.zip.compress(record))
        self.records += 1
        self.size += len(record)

    def close(self) -> tuple[str, int, int]:
        self.out.write(self.zip.flush())
        self.out.close()
        return self.path, self.records, self.size


def _write(folder: str, date: str, level: int, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        attempt = TaskContext.get().taskAttemptId()
        archive, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if archive is None:
                    archive = _Archive(store, f"{path}/raw-{attempt}-{len(done):05d}-{uuid.uuid4().hex[:8]}.warc.gz", level)
                payload = None if row["html"] is None else row["html"].encode()
                archive.add(record_bytes(row["page_id"], row["url"], date, bytes.fromhex(row["sha1"]), row["size"], payload, row["refers_to"]))
                if archive.size >= roll:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "size"])
    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 1, roll: int = ROLL,
                   id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write a record per row into whole-stream gzip archives; returns the manifest (path, records, size).

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest id
    is a response and the others revisit it; smaller payloads are all responses.  A null
    payload is empty.  Rows that repeat the largest id are responses too; a group without any
    id has only responses.  Groups are found by digests and partial aggregates, so a payload
    that a third of the pages share is one row per task.
    """
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("html"),
                        F.octet_length(body).cast("long").alias("size"), F.sha1(body.cast("binary")).alias("sha1"), F.unhex(F.sha2(body, 256)).alias("print"))
    tops = rows.filter(F.col("size") >= least_bytes).groupBy("print").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = rows.join(tops.withColumnRenamed("print", "top_print"), F.col("print") == F.col("top_print"), "left")
    again = F.col("top").isNotNull() & ~F.col("top").eqNullSafe(F.col("page_id"))
    records = joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "sha1", "size", F.when(~again, F.col("html")).alias("html"),
                            F.when(again, F.col("top").cast("string")).alias("refers_to"))
    return written(records.mapInArrow(_write(folder, date, level, roll), "path string, records long, size long"))


def normalise_stream(source: io.RawIOBase, target, level: int = 6) -> Iterator[tuple[int, int, str]]:
    """Inflate ``source`` (gzip, however cut into members) once from beginning to end and write
    every record to ``target`` as a member of its own.  Yields (offset, length, record id).

    A record is copied in pieces, so memory does not grow with records or files.  Anything that
    is not a WARC record, or a record cut short, is an error.
    """
    stream = io.BufferedReader(gzip.GzipFile(fileobj=source), COPY)
    at = 0
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head = [line]
        length, name = None, ""
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("the archive ends inside a record's header")
            head.append(line)
            key, _, value = line.decode("utf-8", "replace").partition(":")
            if key.lower() == "content-length":
                length = int(value)
            elif key.lower() == "warc-record-id":
                name = value.strip()
        if length is None:
            raise ValueError("a record without Content-Length")
        member = zlib.compressobj(level, zlib.DEFLATED, 31)
        size = target.write(member.compress(b"".join(head) + b"\r\n")) or 0
        while length:
            piece = stream.read(min(length, COPY))
            if not piece:
                raise ValueError("the archive ends inside a record")
            length -= len(piece)
            size += target.write(member.compress(piece)) or 0
        size += target.write(member.compress(b"\r\n\r\n") + member.flush()) or 0
        yield at, size, name
        at += size


class _Counted:
    """Output stream whose write returns the number of bytes."""

    def __init__(self, out):
        self.out = out

    def write(self, data: bytes) -> int:
        if data:
            self.out.write(data)
        return len(data)


def _normalise(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for source in batch.column("path").to_pylist():
                name = f"{path}/member-{attempt}-{uuid.uuid4().hex[:8]}.warc.gz"
                with ExitStack() as files:
                    raw = files.enter_context(store.open_input_stream(source, compression=None))
                    out = files.enter_context(store.open_output_stream(name, compression=None))
                    index = files.enter_context(store.open_output_stream(f"{name}.idx", compression=None))
                    rows: list[tuple[int, int, str]] = []
                    for entry in normalise_stream(raw, _Counted(out), level):
                        index.write("{}\t{}\t{}\n".format(*entry).encode())
                        rows.append(entry)
                        if len(rows) == 10_000:
                            yield _index(name, rows)
                            rows = []
                    yield _index(name, rows)
    return run


def _index(name: str, rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array([r[2] for r in rows], pa.string())], names=["path", "offset", "length", "record_id"])


def normalise_archives(manifest: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each archive of ``manifest`` (path) with a gzip member per record; returns the
    offset index (path, offset, length, record_id).  Beside each archive lies the same index as
    ``.idx``.  An empty manifest gives an empty index."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    n = manifest.count()
    return written(manifest.select("path").repartition(max(1, n)).mapInArrow(_normalise(folder, level), "path string, offset long, length long, record_id string"))


def parse_record(data: bytes) -> dict:
    """Fields of one uncompressed record of ``write_archives``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)[1])
    page = lambda x: re.fullmatch(r"<urn:x-page:(.*)>", x)[1] or None if x else None
    return {"page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
            "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": full, "refers_to": page(fields.get("warc-refers-to")),
            "payload": payload if fields["warc-type"] == "response" else None}


_RECORD = "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def _read(store_uri: str):
    kinds = pa.schema([(n, t) for n, t in zip(("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"),
                                              (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(store_uri)
        name, file = None, None
        for batch in batches:
            rows, size = [], 0
            for entry in batch.to_pylist():
                if entry["path"] != name:
                    if file is not None:
                        file.close()
                    name, file = entry["path"], store.open_input_file(entry["path"])
                file.seek(entry["offset"])
                record = parse_record(zlib.decompress(file.read(entry["length"]), 31))
                if record["payload"] is not None and (len(record["payload"]) != record["payload_bytes"] or payload_digest(hashlib.sha1(record["payload"]).digest()) != record["payload_digest"]):
                    raise ValueError(f"record at {entry['path']}:{entry['offset']} does not match its digest")
                rows.append(record)
                size += record["payload_bytes"]
                if size > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, kinds)
        if file is not None:
            file.close()
    return run


def read_records(index: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
    """Records at the places of ``index`` (path, offset, length), checked against their digests.

    Returns page_id, url, record_type, payload_digest, payload_bytes, refers_to and payload
    (null for revisits).  Tasks get stretches of neighbouring records; unless ``partitions`` is
    given, one for every ``TASK_BYTES`` of compressed records.
    """
    if partitions is None:
        partitions = 1 + (index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES
    places = index.select("path", "offset", "length").repartitionByRange(partitions, "path", "offset").sortWithinPartitions("path", "offset")
    return places.mapInArrow(_read(folder), _RECORD)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back all ``pages`` under a new shared folder."""
    folder = work_dir(pages.sparkSession)
    index = normalise_archives(write_archives(pages, folder, least_bytes), folder)
    kind = pages.schema["page_id"].dataType
    return read_records(index, folder).withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
