"""WARC archives with a Zstandard dictionary.

Each task writes its pages as archives of individually compressed records. A file's
dictionary is trained on its own first records (a bounded buffer) and stands in a
leading skippable frame, so a file can be read alone. Payloads that equal another
page's are written as revisit records, without their bytes.

A file gets its name only when it is whole: it is written under a name of the task's
attempt and then renamed, so a task that is run again replaces its files and a lost
one leaves none that readers see. Archives go to any folder that pyarrow can open and
all executors share; payloads travel through one shuffle by page id.

Defined results: null html is an empty payload; a null url has no target; payloads
below ``min_revisit_bytes`` are all responses; of equal larger payloads the largest
page id is the response, and each row of that id is one; a row without an id is a
response that nothing refers to; an empty table gives no archive and an empty result;
columns other than id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import run_dir
from .common import materialize, plain

#: Frame type of the dictionary's skippable frame, as the WARC/zstd convention has it.
DICTIONARY_MAGIC = 0x184D2A5D
#: Bytes of records from which a file's dictionary is trained, and the dictionary's size.
TRAIN_BYTES, DICTIONARY_BYTES = 4 << 20, 64 << 10
#: Compressed bytes after which a task begins another file.
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: object) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: object, url: str | None, payload: bytes, refers_to: object, date: str = DATE) -> bytes:
    """One WARC record; a revisit keeps the payload's HTTP header, not its bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id("none" if page_id is None else page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def train(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on records; empty where they are too few or too small to train one."""
    total = sum(map(len, records))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), records).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes records to one open file, the dictionary first."""

    def __init__(self, out, level: int = 3):
        self.out, self.level = out, level
        self.held: list[bytes] | None = []
        self.held_bytes = self.written = 0

    def add(self, data: bytes) -> None:
        if self.held is None:
            self._write(self.compressor.compress(data))
            return
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= TRAIN_BYTES:
            self._begin()

    def _begin(self) -> None:
        held, self.held = self.held, None
        dictionary = train(held)
        if dictionary:
            packed = zstandard.ZstdCompressor(level=self.level).compress(dictionary)
            self._write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=known)
        for data in held:
            self._write(self.compressor.compress(data))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def finish(self) -> None:
        if self.held is not None:
            self._begin()


def read_archive(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive, frame by frame."""
    decompressor = zstandard.ZstdDecompressor()
    pending = file.read(8)
    if len(pending) == 8 and struct.unpack("<I", pending[:4])[0] == DICTIONARY_MAGIC:
        packed = file.read(struct.unpack("<I", pending[4:])[0])
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed))
        decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
        pending = b""
    frame, out, begun = decompressor.decompressobj(), io.BytesIO(), False
    while True:
        data = pending or file.read(1 << 20)
        pending = b""
        if not data:
            if begun:
                raise EOFError("the archive ends inside a record")
            return
        while data:
            out.write(frame.decompress(data))
            begun = not frame.eof
            data = frame.unused_data if frame.eof else b""
            if frame.eof:
                yield parse(out.getvalue())
                frame, out = decompressor.decompressobj(), io.BytesIO()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields, by lower-case name, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and plain path of a folder given as a path or a URI."""
    folder = re.sub(r"^file:/+", "/", folder)
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def revisits(pages: DataFrame, *, min_revisit_bytes: int) -> DataFrame:
    """(id, refers_to) of the pages whose payload a larger id holds too; pages has (id, url, html).

    Only digests are grouped. A very common payload is a partial maximum, then a skewed
    key of a plain join.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    digests = pages.filter("id is not null").select(
        "id", F.sha1(html).alias("digest"), F.octet_length(html).alias("bytes")
    ).filter(F.col("bytes") >= min_revisit_bytes)
    keepers = digests.groupBy("digest", "bytes").agg(F.max("id").alias("refers_to"))
    found = digests.join(keepers, ["digest", "bytes"]).filter(F.col("id") < F.col("refers_to"))
    return found.groupBy("id", "digest").agg(F.max("refers_to").alias("refers_to"))


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 1000,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write all pages as archives in ``folder``; (path, n_records, n_bytes) of each file, written already."""
    rows = pages.select(plain(id_col).alias("id"), plain(url_col).alias("url"), plain(html_col).alias("html"))
    # The digest takes part in the join: rows of one id may hold different payloads.
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    joined = rows.withColumn("digest", digest).join(
        revisits(rows, min_revisit_bytes=min_revisit_bytes), ["id", "digest"], "left"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(folder)
        where.create_dir(base, recursive=True)
        task = TaskContext.get()
        writer, out, n, number = None, None, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal writer, n, number
            writer.finish()
            out.close()
            path = f"{base}/part-{task.partitionId():05d}-{number:04d}.warc.zst"
            where.move(open_name(), path)
            made = pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([n], pa.int64()), pa.array([writer.written], pa.int64())],
                ["path", "n_records", "n_bytes"],
            )
            writer, n, number = None, 0, number + 1
            return made

        def open_name() -> str:
            return f"{base}/.part-{task.partitionId():05d}-{number:04d}-{task.taskAttemptId()}"

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    out = where.open_output_stream(open_name(), compression=None)
                    writer = ArchiveWriter(out)
                writer.add(record(page_id, url, html or b"", refers_to))
                n += 1
                if writer.written >= file_bytes:
                    yield close()
        if writer is not None:
            yield close()

    ready = joined.select("id", "url", F.col("html").cast("binary").alias("html"), "refers_to")
    return materialize(ready.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-files")


def read_archives(files: DataFrame, *, id_type: str = "bigint") -> DataFrame:
    """(id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records.

    ``files`` has a column path; each file is one task's stream. A response's payload is
    digested again and must agree with its header; a revisit has no payload here, its
    size and digest are those of the full one.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = _open(path)
                with where.open_input_stream(name, compression=None) as file:
                    rows, held = [], 0
                    for fields, block in read_archive(file):
                        rows.append(_row(fields, block))
                        held += len(block)
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    n = max(1, files.count())
    read = files.select("path").repartition(n).mapInArrow(
        run,
        "id string, url string, payload_bytes long, payload_digest string, record_type string,"
        " refers_to string, payload binary",
    )
    return read.withColumns({"id": F.col("id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


_ROW = pa.schema([
    ("id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()),
])


def _row(fields: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} differs from its header")
    own = fields["warc-record-id"][len("<urn:page:") : -1]
    refers_to = fields.get("warc-refers-to")
    return {
        "id": None if own == "none" else own,
        "url": fields.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": refers_to and refers_to[len("<urn:page:") : -1],
        "payload": payload if kind == "response" else None,
    }


def archive_and_read(pages: DataFrame, *, id_col: str = "page_id", **params) -> DataFrame:
    """Write ``pages`` to a fresh shared folder and read the archives back."""
    folder = run_dir(pages.sparkSession, "llm/warc")
    files = write_archives(pages, folder, id_col=id_col, **params)
    return read_archives(files, id_type=pages.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)
