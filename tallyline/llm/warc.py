"""WARC archives: written from pages, normalised record by record, and read back.

``write_archives`` writes records the way some crawlers do: a whole file is one gzip
stream. ``normalise`` inflates such a stream once and rewrites every record as a gzip
member of its own, beside a sidecar file with each record's offset and length, by which
single records can be read. ``read_archives`` reads records through that index.

Records with equal payloads: that with the least page id is a response, the others are
revisits without a payload, which name it and give the payload's length and digest.
Payloads below ``min_revisit`` bytes are all responses.

Files are written by the tasks, through pyarrow's file systems, below a folder that all
executors share. A task returns a row for each file it has finished; a file counts only
if it is in the rows of a task that succeeded, so that tasks may be repeated. Names are
unique to an attempt. Streams are read and written in pieces, whatever a file's size.

Defined results: a null payload is empty. Rows without a page id are records too and rank
last; of equal payloads, all rows with the least page id are responses. Repeated rows are
repeated records. Other columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import col, evenly_joined, reliable, sent

#: A new file is begun beyond so many bytes of records.
FILE_BYTES = 128_000_000
CHUNK = 1 << 20
_DATE = "1970-01-01T00:00:00Z"
_MANIFEST = "path string, records long, bytes long"
_RECORDS = (
    "record_id string, page_id string, target_uri string, record_type string, refers_to string,"
    " payload_bytes long, payload_digest string, payload binary"
)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1, as in WARC-Payload-Digest without its prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def marked(frame: DataFrame, page_id: str, payload: str, min_revisit: int = 0) -> DataFrame:
    """(page_id, payload, refers_to): refers_to is the page whose equal payload stands for it."""
    told = frame.select(
        col(page_id).alias("page_id"), col("url").cast("string").alias("url"),
        F.coalesce(col(payload).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("same", F.sha2("payload", 256))
    large = F.octet_length("payload") >= min_revisit
    repeated = reliable(
        told.where(large).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    )
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return evenly_joined(told, repeated, ["same"], "n").select(
        "page_id", "url", "payload", F.when(other, F.col("first")).alias("refers_to")
    )


def _record(page: str, uri: str, payload: bytes, refers_to: str | None) -> bytes:
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "X-Page-ID": page,
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"
        head["X-Refers-To-Page"] = refers_to
        payload = b""
    head["Content-Length"] = str(len(payload))
    lines = "".join(f"{k}: {json.dumps(v)[1:-1] if k in _ESCAPED else v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + payload + b"\r\n\r\n"


#: Values that may hold line ends or any other character; written as JSON text without its quotes.
_ESCAPED = {"WARC-Target-URI", "X-Page-ID", "X-Refers-To-Page"}


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _told(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    path, records, size = zip(*rows, strict=True) if rows else ((), (), ())
    columns = [pa.array(path, pa.string()), pa.array(records, pa.int64()), pa.array(size, pa.int64())]
    return pa.record_batch(columns, ["path", "records", "bytes"])


def write_archives(records: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write (page_id, url, payload, refers_to) as archives of one gzip stream each.

    Returns (path, records, bytes) of each file, computed once.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        out: gzip.GzipFile | None = None
        path, count, size, done = "", 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, count, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = system.open_output_stream(path, compression=None)
                    out = gzip.GzipFile(fileobj=sink, mode="wb", compresslevel=level, mtime=0)
                data = _record(row["page"] or "", row["url"] or "", row["payload"].encode(), row["refers_to"])
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.close()
                    sink.close()
                    done, out = [*done, (path, count, size)], None
        if out is not None:
            out.close()
            sink.close()
            done.append((path, count, size))
        yield _told(done)

    told = records.select(
        F.col("page_id").cast("string").alias("page"), "url", "payload", F.col("refers_to").cast("string")
    )
    return reliable(sent(told).mapInArrow(write, _MANIFEST))


class _Inflated(io.RawIOBase):
    """A gzip file's content as one stream, inflated in pieces; members may follow each other."""

    def __init__(self, source: IO[bytes]):
        self.source, self.inflate, self.rest = source, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: bytearray) -> int:
        while True:
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            data = self.rest or self.source.read(CHUNK)
            if not data:
                return 0
            found = self.inflate.decompress(data, len(buffer))
            self.rest = self.inflate.unconsumed_tail
            if found:
                buffer[: len(found)] = found
                return len(found)


def _heads(stream: io.BufferedReader) -> Iterator[tuple[bytes, dict[str, str]]]:
    """Each record's head, as bytes and as fields; the caller reads the block behind it."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        head, fields = line, {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            value = value.strip()
            fields[name] = json.loads(f'"{value}"') if name in _ESCAPED else value
            head += line
        yield head + line, fields


def _normalised(system: pafs.FileSystem, source: str, target: str, level: int) -> tuple[int, int]:
    """Rewrite one archive; returns the number of its records and its new size."""
    count, at = 0, 0
    with (
        system.open_input_stream(source, compression=None) as raw,
        system.open_output_stream(target, compression=None) as out,
        system.open_output_stream(f"{target}.idx", compression=None) as index,
    ):
        stream = io.BufferedReader(_Inflated(raw), CHUNK)
        for head, fields in _heads(stream):
            pack = zlib.compressobj(level, zlib.DEFLATED, 31)
            size, left = out.write(pack.compress(head)), int(fields["Content-Length"])
            while left:
                if not (block := stream.read(min(left, CHUNK))):
                    raise ValueError(f"{source} ends inside a record")
                left -= len(block)
                size += out.write(pack.compress(block))
            size += out.write(pack.compress(b"\r\n\r\n") + pack.flush())
            entry = {"offset": at, "length": size, "record_id": fields["WARC-Record-ID"], "type": fields["WARC-Type"]}
            index.write(json.dumps(entry).encode() + b"\n")
            count, at = count + 1, at + size
    return count, at


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite the archives of (path): a gzip member for each record, and a sidecar index.

    Returns (path, records, bytes) of each new file; its index is ``path`` and ``.idx``.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            done = []
            for path in batch.column("path").to_pylist():
                target = f"{base}/{uuid.uuid4().hex}.warc.gz"
                done.append((target, *_normalised(system, path, target, level)))
            yield _told(done)

    return reliable(_one_by_one(archives).mapInArrow(rewrite, _MANIFEST))


def _one_by_one(archives: DataFrame) -> DataFrame:
    """Paths, dealt out so that files and not rows decide on the number of tasks."""
    files = archives.count()
    return sent(archives).select("path").repartition(max(1, min(files, 10_000)))


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Every record of normalised archives, read by its place in the sidecar index.

    Lengths and digests of responses are those of the payload that was read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(folder)
        names = [part.split()[0] for part in _RECORDS.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(f"{path}.idx", compression=None) as index, system.open_input_file(path) as file:
                    rows, size = [], 0
                    for line in io.BufferedReader(index, CHUNK):
                        place = json.loads(line)
                        file.seek(place["offset"])
                        member = gzip.decompress(file.read(place["length"]))
                        stream = io.BufferedReader(io.BytesIO(member))
                        _, fields = next(_heads(stream))
                        body = stream.read(int(fields["Content-Length"]))
                        revisit = fields["WARC-Type"] == "revisit"
                        rows.append((
                            fields["WARC-Record-ID"], fields["X-Page-ID"] or None, fields["WARC-Target-URI"],
                            fields["WARC-Type"], fields.get("X-Refers-To-Page"),
                            int(fields["X-Payload-Length"]) if revisit else len(body),
                            fields["WARC-Payload-Digest"].partition(":")[2] if revisit else digest(body),
                            body if payloads else None,
                        ))
                        size += len(body) if payloads else 0
                        if len(rows) >= 5000 or size >= 8_000_000:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return _one_by_one(archives).mapInArrow(read, _RECORDS)
