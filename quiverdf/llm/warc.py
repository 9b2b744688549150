"""WARC archives in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with whole WARC records of about `FRAME_BYTES`, then a
skippable frame with the index (record identifier to frame and offset within the frame) and a skippable frame with the
seek table of the public seekable format, whose last bytes tell where everything is. A reader fetches the end of the
file, looks an identifier up and decompresses a single frame.

Executors write bundles under names of their own into a shared folder; only bundles listed in the manifest of
successful tasks are read, so a lost task leaves at most an unlisted file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, by_value

by_value(__name__)

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
LEAST_REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK_TABLE, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ENTRY = "<qII"

MANIFEST = "bundle string, records long, frames long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def arrow_rows(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """A response with its payload, or a revisit that names the response with the same payload and keeps the HTTP headers only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    where = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:none")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {where}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts there, and where the next one starts. The digest of a response is taken from its payload anew."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) for x in lines)
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and digest(payload) != stated:
        raise ValueError(f"the payload of {head['WARC-Record-ID']} does not have its digest")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    page, other = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
    return {
        "page_id": None if page is None else int(page), "url": head["WARC-Target-URI"], "payload_bytes": size, "payload_digest": stated, "record_type": head["WARC-Type"],
        "refers_to": None if other is None else int(other), "payload": None if revisit else payload,
    }, end + 4 + len(block) + 4


class BundleWriter:
    """Appends records to a file and ends it with index and seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.sink, self.frame_bytes, self.zstd = sink, frame_bytes, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.index: list[bytes] = []
        self.open: list[bytes] = []
        self.open_bytes = self.raw = 0

    def add(self, page_id: int | None, data: bytes) -> None:
        if page_id is not None:
            self.index.append(struct.pack(ENTRY, page_id, len(self.frames), self.open_bytes))
        self.open.append(data)
        self.open_bytes += len(data)
        self.raw += len(data)
        if self.open_bytes >= self.frame_bytes:
            self._end_frame()

    def _end_frame(self) -> None:
        if self.open:
            frame = self.zstd.compress(b"".join(self.open))
            self.sink.write(frame)
            self.frames.append((len(frame), self.open_bytes))
            self.open, self.open_bytes = [], 0

    def close(self) -> None:
        self._end_frame()
        index = self.zstd.compress(b"".join(sorted(self.index)))
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        entries = [*self.frames, (len(index) + 8, 0)]
        table = b"".join(struct.pack("<II", *x) for x in entries) + struct.pack("<IBI", len(entries), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table)
        self.sink.close()


class BundleReader:
    """Frames and records of a bundle; source: a file with seek, read and size."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("not a seekable bundle")
        flat = struct.unpack(f"<{2 * n}I", self._at(size - 9 - 8 * n, 8 * n))
        self.frames, at = [], 0
        for k in range(n - 1):
            self.frames.append((at, flat[2 * k], flat[2 * k + 1]))
            at += flat[2 * k]
        self.index_at, self.index_bytes = at + 8, flat[2 * n - 2] - 8

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        at, n, raw = self.frames[k]
        return self.zstd.decompress(self._at(at, n), max_output_size=raw)

    def index(self) -> dict[int, tuple[int, int]]:
        return {p: (f, o) for p, f, o in struct.iter_unpack(ENTRY, self.zstd.decompress(self._at(self.index_at, self.index_bytes)))}

    def get(self, page_id: int) -> dict:
        """One record, by decompressing its frame alone."""
        k, offset = self.index()[page_id]
        return parse(self.frame(k), offset)[0]

    def __iter__(self) -> Iterator[dict]:
        for k in range(len(self.frames)):
            data, at = self.frame(k), 0
            while at < len(data):
                found, at = parse(data, at)
                yield found


def open_bundle(path: str) -> BundleReader:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return BundleReader(store.open_input_file(name))


def with_responses(pages: DataFrame, work: Workspace, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Adds refers_to: the smallest id with an equal payload, null for that row itself and payloads under `least` bytes."""
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").alias("url"), body.alias("payload")).withColumn("key", F.sha2("payload", 256))
    first = rows.filter(F.octet_length("payload") >= least).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = work.keep(first.filter("n > 1").select("key", "first"), "responses")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    return rows.join(first, "key", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_bundles(rows: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes page_id, url, payload, refers_to; gives the manifest, which must be kept before it is used."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        writer, listed = None, []

        def done():
            writer.close()
            listed.append((name, n, len(writer.frames), writer.raw))

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if writer is None:
                    file = f"part-{TaskContext.get().partitionId():06d}-{len(listed):04d}-{uuid.uuid4().hex}.warc.zst"
                    name, n, writer = f"{folder}/{file}", 0, BundleWriter(store.open_output_stream(f"{base}/{file}", compression=None), frame_bytes)
                writer.add(page_id, record(page_id, url, payload, refers_to))
                n += 1
                if writer.raw >= bundle_bytes:
                    done()
                    writer = None
        if writer is not None:
            done()
        yield arrow_rows([dict(zip(("bundle", "records", "frames", "bytes"), x, strict=True)) for x in listed], MANIFEST)

    whole = rows.select("page_id", "url", "payload", "refers_to")
    return whole.mapInArrow(run, MANIFEST)


def read_bundles(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the bundles listed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("bundle").to_pylist():
                rows: list[dict] = []
                held = 0
                for found in open_bundle(path):
                    held += len(found["payload"] or b"")
                    rows.append(found if payloads else found | {"payload": None})
                    if held >= 8 << 20 or len(rows) >= 5000:
                        yield arrow_rows(rows, RECORDS)
                        rows, held = [], 0
                if rows:
                    yield arrow_rows(rows, RECORDS)

    return manifest.select("bundle").mapInArrow(run, RECORDS)


def archive(pages: DataFrame, folder: str | None = None, payloads: bool = True) -> DataFrame:
    """Writes all pages as WARC and reads them back.

    Null html is an empty payload. Rows with the id of the response are responses themselves, so a repeated row is
    written twice. A null id is kept, but never is a response that others name nor in the index. An empty table gives
    an empty result.
    """
    work = Workspace(pages.sparkSession)
    rows = with_responses(pages, work)
    manifest = work.keep(write_bundles(rows, folder or f"{work.root}/bundles"), "manifest")
    count = manifest.count()
    spread = manifest.repartition(max(1, min(count, 4096)), "bundle") if count > 1 else manifest
    return read_bundles(spread, payloads)
