"""WARC archives: writer, monolithic gzip normaliser, reader (3).

``write_archives`` writes one record per page into archives that are each a
single gzip stream.  Of pages with equal payloads of at least
``min_revisit_bytes`` the one with the smallest page_id becomes a response
record, the others revisit it; smaller payloads are all responses.

``normalise`` inflates every archive once, as a stream, and rewrites each
record as a gzip member of its own, with a sidecar index of offsets, so that
a reader can fetch any record alone.  A task holds one record at a time.  A
writer starts a new archive after ``archive_bytes`` of records, which bounds
the work of a normalising task.

``read_archives`` fetches the records by their offsets and checks every
response against its digest.

File names hold a random part and count only if the manifest, which Spark
commits, names them; files of lost or repeated tasks are never read.

Defined cases: null html is an empty payload; a null url is replaced by the
record's id, control characters in one are percent-encoded; pages without
page_id come back without one and are responses unless an equal payload has
a page_id; rows that repeat a response's page_id and payload are responses
too; an empty table gives no archive and no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import filesystem, text_slices
from changeflow.session import remove_paths

ARCHIVE_BYTES = 1 << 30
STREAM_LEVEL, MEMBER_LEVEL = 1, 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, n_records long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _page_id(urn: str) -> int | None:
    own = urn.strip("<>").rpartition(":")[2]
    return int(own) if own else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The record of one page; a revisit holds the HTTP header alone."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    target = _CONTROL.sub(lambda m: quote(m[0]), url) if url else _urn(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_urn(page_id)}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_urn(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields by lower-case name, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[:int(fields["content-length"])]


def inflate(f, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, as a stream."""
    z = zlib.decompressobj(31)
    while data := f.read(chunk):
        while data:
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; one is held at a time."""
    buffer, need = bytearray(), 0      # need: bytes of the record at the front, 0 if not known
    for data in stream:
        buffer += data
        at = 0
        while True:
            if not need:
                head = buffer.find(b"\r\n\r\n", at)
                if head < 0:
                    break
                m = re.search(rb"\r\nContent-Length: *(\d+)", buffer[at:head], re.I)
                if not m:
                    raise ValueError("a record without Content-Length")
                need = head - at + 4 + int(m[1]) + 4
            if len(buffer) - at < need:
                break
            yield bytes(buffer[at:at + need])
            at, need = at + need, 0
        del buffer[:at]
    if buffer:
        raise ValueError("the archive ends within a record")


def first_pages(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(digest, first): of every payload that repeats, its smallest page_id."""
    return (pages.filter(F.octet_length("html") >= min_revisit_bytes).groupBy("digest")
            .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1 AND first IS NOT NULL").select("digest", "first"))


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives of one gzip stream each; the manifest (file, n_records)."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                       F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # the long side is split by AQE where one payload holds many rows
    marked = own.join(first_pages(own, min_revisit_bytes), "digest", "left").select(
        "page_id", "url", "html", F.when(F.octet_length("html") >= min_revisit_bytes, F.col("first")).alias("first"))
    fs, path = filesystem(folder)
    fs.create_dir(f"{path}/streams", recursive=True)

    def write(batches):
        fs, path = filesystem(folder)
        out, done = None, []
        for batch in text_slices(batches, ("html",)):
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, size, n = uuid.uuid4().hex, 0, 0
                    z = zlib.compressobj(STREAM_LEVEL, zlib.DEFLATED, 31)
                    out = fs.open_output_stream(f"{path}/streams/{name}.warc.gz", compression=None)
                data = record(page_id, url, html.encode(), first if first != page_id else None)
                out.write(z.compress(data))
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.write(z.flush())
                    out.close()
                    out = None
                    done.append((name, n))
        if out is not None:
            out.write(z.flush())
            out.close()
            done.append((name, n))
        yield from _manifest(done)
    marked.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/streams-manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/streams-manifest")


def _manifest(done: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
                                         ["file", "n_records"])


def _a_file_a_task(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(max(1, manifest.count()), "file")


def normalise(manifest: DataFrame, folder: str, keep_streams: bool = False) -> DataFrame:
    """Rewrite each archive of ``manifest`` with one gzip member a record and
    a sidecar index (record id, type, offset, length); the new manifest.  The
    streams are removed once all are rewritten, unless ``keep_streams``."""
    fs, path = filesystem(folder)
    fs.create_dir(f"{path}/members", recursive=True)

    def rewrite(batches):
        fs, path = filesystem(folder)
        done = []
        for batch in batches:
            for name in batch.column("file").to_pylist():
                new, at, n = uuid.uuid4().hex, 0, 0
                with (fs.open_input_stream(f"{path}/streams/{name}.warc.gz", compression=None) as f,
                      fs.open_output_stream(f"{path}/members/{new}.warc.gz", compression=None) as out,
                      fs.open_output_stream(f"{path}/members/{new}.idx") as idx):
                    for data in records(inflate(f)):
                        fields, _ = parse(data)
                        z = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(data) + z.flush()
                        out.write(member)
                        idx.write(f"{fields['warc-record-id']}\t{fields['warc-type']}\t{at}\t{len(member)}\n".encode())
                        at, n = at + len(member), n + 1
                done.append((new, n))
        yield from _manifest(done)
    _a_file_a_task(manifest).mapInArrow(rewrite, MANIFEST).write.parquet(f"{folder}/manifest")
    if not keep_streams:
        remove_paths(manifest.sparkSession, [f"{folder}/streams"])
    return manifest.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record: page_id, url, record_type, refers_to, payload_digest,
    payload_bytes (both of the full payload), payload (null for a revisit)."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def read(batches):
        fs, path = filesystem(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, size = [], 0
                with (fs.open_input_file(f"{path}/members/{name}.warc.gz") as f,
                      fs.open_input_stream(f"{path}/members/{name}.idx") as idx):
                    for line in _lines(idx):
                        _, _, at, length = line.split("\t")
                        f.seek(int(at))
                        rows.append(_row(zlib.decompress(f.read(int(length)), 31)))
                        size += rows[-1]["payload_bytes"]
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
    return _a_file_a_task(manifest).select("file").mapInArrow(read, RECORD)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                     ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _lines(f, chunk: int = 1 << 20) -> Iterator[str]:
    rest = b""
    while data := f.read(chunk):
        *whole, rest = (rest + data).split(b"\n")
        yield from (x.decode() for x in whole)


def _row(data: bytes) -> dict:
    fields, block = parse(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"{fields['warc-record-id']}: the payload does not match its digest")
    return {"page_id": _page_id(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": kind,
            "refers_to": _page_id(fields["warc-refers-to"]) if kind == "revisit" else None, "payload_digest": digest,
            "payload_bytes": int(re.search(rb"Content-Length: *(\d+)", http)[1]),
            "payload": payload if kind == "response" else None}


def digest(archives: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return archives.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
