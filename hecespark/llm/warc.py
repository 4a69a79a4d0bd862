"""WARC files: a writer of one gzip member per record, and a sequential reader.

The reader goes through a file as a stream and never holds more than one record: bytes are inflated as they come, a record's header
ends at an empty line, its block is framed by Content-Length, and its digests are computed and compared. A record that is broken
gets a status, and reading goes on at the next gzip member. A file is read by one task, files in parallel;
executors open them through Arrow's file systems (local, HDFS, S3 by the URI), so that no file has to fit in memory.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hecespark.runtime import bind, scratch

CHUNK = 1 << 16
LEVEL = 1
MAGIC = b"\x1f\x8b\x08"
#: Longest header that is looked for; without its end by then a record is malformed.
HEADER_BYTES = 1 << 20
SCHEMA = "file string, position bigint, record_id string, type string, target_uri string, date string, content_type string, content_length bigint, http_status int, payload binary, payload_digest string, status string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, uri: str | None, block: bytes, content_type: str, date: str, record_id: str, payload: bytes | None = None) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("Content-Type", content_type), ("WARC-Block-Digest", digest(block))]
    if uri is not None:
        head.insert(1, ("WARC-Target-URI", uri))
    if payload is not None:
        head.append(("WARC-Payload-Digest", digest(payload)))
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def response(page_id: int | None, url: str | None, html: str, date: str) -> bytes:
    body = html.encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    return record("response", uri, block, "application/http; msgtype=response", date, f"urn:hecespark:page:{'' if page_id is None else page_id}", body)


def open_fs(uri: str):
    from pyarrow import fs

    uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_kernel(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get()
    system, path = open_fs(folder)
    name = f"{path}/part-{task.partitionId():06d}.warc.gz"
    attempt = f"{path}/_attempt-{task.taskAttemptId()}"
    n = 0
    with system.open_output_stream(attempt, compression=None) as out:
        for batch in batches:
            for i, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                if html is not None:
                    out.write(member(response(i, url, html, date)))
                    n += 1
    if system.get_file_info(name).type.name == "File":  # of an attempt whose executor was lost
        system.delete_file(name)
    system.move(attempt, name)  # files appear whole
    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([n], pa.int64())], names=["file", "records"])


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One file for each partition of pages (page_id, url, html), in folder; (file, records). The record id names page_id;
    a null html is not written, a null url leaves out the target."""
    spark = pages.sparkSession
    system, path = open_fs(folder)
    system.create_dir(path, recursive=True)
    done = pages.select("page_id", "url", "html").mapInArrow(bind(__name__, "write_kernel", folder, date), "file string, records bigint").collect()
    return spark.createDataFrame(done, "file string, records bigint")


class Members:
    """The gzip members of a stream: read() gives inflated bytes of the current one, next() goes on to the following."""

    def __init__(self, stream):
        self.stream, self.left, self.at = stream, b"", 0
        self.z = None
        self.ended = self.broken = False

    def _more(self) -> bool:
        data = self.stream.read(CHUNK)
        self.left += data
        return bool(data)

    def next(self) -> int | None:
        """The position of the next member, found by its magic bytes (whatever is between is skipped); None at the end."""
        while True:
            found = self.left.find(MAGIC)
            if found >= 0:
                self.at += found
                self.left = self.left[found:]
                self.z, self.ended, self.broken = zlib.decompressobj(31), False, False
                return self.at
            gone = max(0, len(self.left) - len(MAGIC) + 1)
            self.at += gone
            self.left = self.left[gone:]
            if not self._more():
                return None

    def read(self) -> bytes:
        """Some inflated bytes, or none if the member has ended, well or broken."""
        while not (self.ended or self.broken):
            if not self.left and not self._more():
                self.broken = True
                break
            begin, size = self.left, len(self.left)
            try:
                out = self.z.decompress(begin, 4 * CHUNK)
            except zlib.error:
                self.broken = True
                self.left, self.at = begin[1:], self.at + 1  # the next search starts within this member
                break
            self.left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.at += size - len(self.left)
            self.ended = self.z.eof
            if out:
                return out
        return b""


def read_records(stream) -> Iterator[dict]:
    """The records of one file, in order. status is ok, no_digest, digest_mismatch, truncated, bad_header or bad_gzip."""
    members = Members(stream)
    while (position := members.next()) is not None:
        row = dict.fromkeys(("record_id", "type", "target_uri", "date", "content_type", "content_length", "http_status", "payload", "payload_digest"))
        row |= {"position": position, "status": "ok"}
        data = bytearray()
        end = -1
        while end < 0 and len(data) < HEADER_BYTES and (part := members.read()):
            data += part
            end = data.find(b"\r\n\r\n", max(0, len(data) - len(part) - 3))
        if end < 0 or not data.startswith(b"WARC/"):
            row["status"] = "bad_gzip" if members.broken else "bad_header"
            while members.read():
                pass
            yield row
            continue
        head = {}
        last = None
        for line in bytes(data[:end]).split(b"\r\n")[1:]:
            if line[:1] in b" \t" and last:
                head[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            k, colon, v = line.decode("utf-8", "replace").partition(":")
            if colon:
                last = k.strip().lower()
                head[last] = v.strip()
        rest = data[end + 4 :]
        length = head.get("content-length", "")
        row |= {"record_id": head.get("warc-record-id", "").strip("<>") or None, "type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "content_type": head.get("content-type")}
        if not length.isdecimal():
            row["status"] = "bad_header"
            while members.read():
                pass
            yield row
            continue
        size = int(length)
        while len(rest) < size and (part := members.read()):
            rest += part
        block = bytes(rest[:size])
        while members.read():  # the two line breaks after the block, and what else is in the member
            pass
        payload = block
        if (head.get("content-type") or "").lower().startswith("application/http"):
            top, gap, body = block.partition(b"\r\n\r\n")
            if gap:
                payload = body
                words = top.split(b"\r\n", 1)[0].split()
                if row["type"] == "response" and len(words) > 1 and words[1].isdigit() and len(words[1]) == 3:
                    row["http_status"] = int(words[1])
        row |= {"content_length": size, "payload": payload, "payload_digest": digest(payload)}
        given = [(head[k], d) for k, d in (("warc-block-digest", block), ("warc-payload-digest", payload)) if k in head]
        if len(block) < size:
            row["status"] = "truncated"
        elif members.broken:
            row["status"] = "bad_gzip"
        elif not given:
            row["status"] = "no_digest"
        elif not all(matches(g, d) for g, d in given):
            row["status"] = "digest_mismatch"
        yield row


def matches(given: str, data: bytes) -> bool:
    """Whether a labelled digest (base 32 or hexadecimal) is that of data; one of an algorithm that isn't known doesn't count against it."""
    name, _, value = given.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("sha1", "md5", "sha256", "sha512"):
        return True
    found = hashlib.new(name, data).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def read_kernel(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name in batch.column("file").to_pylist():
            system, path = open_fs(name)
            rows: list[dict] = []
            size = 0
            with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                for row in read_records(stream):
                    rows.append(row | {"file": name})
                    size += len(row["payload"] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read(spark: SparkSession, files: list[str] | DataFrame) -> DataFrame:
    """A row for each record of the files (names, or a frame with a column ``file``), as in SCHEMA; payload is the HTTP body of
    HTTP records, else the block. Files without a member give no row; a file that can't be opened fails the job.
    Null names are passed over, a file that is named twice is read twice."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    if not isinstance(files, DataFrame):
        files = spark.createDataFrame([(f,) for f in files], "file string")
    files = files.select("file").where("file is not null")
    n = max(1, files.count())
    spread = files.repartitionByRange(min(n, 20_000), "file")
    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))
    return spread.mapInArrow(bind(__name__, "read_kernel", schema), SCHEMA)


def folder(spark: SparkSession) -> str:
    return scratch(spark, "warc")
