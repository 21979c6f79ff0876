"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of bounded size that decompress on their own.  An archive ends in a seek
table, a skippable frame with the sizes of all frames in the public seekable format, so any reader of
Zstandard sees one stream, and one that knows the format jumps to a frame.  A catalogue, a staged table,
maps each record to its archive, its frame and its offset in the frame.

Only rows of finished tasks enter the catalogue, so an archive left by a lost task is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.sources.staging import new_location, stage

FRAME_BYTES = 256 << 10
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

CATALOGUE = (
    "archive string, frame long, offset long, length long, record_id string, page_id string"
)
RECORDS = (
    "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string,"
    " payload binary"
)


def record_id(page_id: str | None) -> str:
    """The same identifier for a page in every archive, so that revisits can name its record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def one_line(value: str | None) -> str:
    """A header value without line breaks."""
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def unquoted(page_id: str | None) -> str | None:
    """An id from its header, where it stands percent-encoded; a null id has no header."""
    return None if page_id is None else unquote(page_id)


def make_record(
    page_id: str | None, url: str | None, payload: bytes, sha1: bytes, first: str | None, revisit: bool
) -> bytes:
    """A response record with the payload, or a revisit record that names the first page's record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest_text(sha1)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {quote(page_id)}")
    if revisit:
        head += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {record_id(first)}",
            f"Refers-To-Page-ID: {quote(first)}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple:
    """``RECORDS`` of one record; a response whose payload does not fit its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (
        len(payload) != size or digest_text(hashlib.sha1(payload).digest()) != digest
    ):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return (
        unquoted(fields.get("Page-ID")),
        size,
        digest,
        kind,
        unquoted(fields.get("Refers-To-Page-ID")),
        payload if kind == "response" else None,
    )


class ArchiveWriter:
    """Writes records into one archive and tells where they went."""

    def __init__(self, folder: str, frame_bytes: int):
        import zstandard

        self.files, base = fs.FileSystem.from_uri(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        # The records are compressed here: the stream must not do it again because of the name.
        self.out = self.files.open_output_stream(f"{base}/{self.name}", compression=None)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frame_bytes = frame_bytes
        self.frame: list[bytes] = []
        self.filled = 0
        self.written = 0
        self.sizes: list[tuple[int, int]] = []

    def add(self, record: bytes) -> tuple[str, int, int, int]:
        """Archive, frame, offset in the frame, and length of the record."""
        if self.filled and self.filled + len(record) > self.frame_bytes:
            self.flush()
        place = (self.name, len(self.sizes), self.filled, len(record))
        self.frame.append(record)
        self.filled += len(record)
        return place

    def flush(self) -> None:
        if self.frame:
            packed = self.compressor.compress(b"".join(self.frame))
            self.out.write(packed)
            self.written += len(packed)
            self.sizes.append((len(packed), self.filled))
            self.frame, self.filled = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class ArchiveReader:
    """Reads single frames of an archive by its seek table."""

    def __init__(self, folder: str, name: str):
        files, base = fs.FileSystem.from_uri(folder)
        self.file = files.open_input_file(f"{base}/{name}")
        end = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        table = self.file.read_at(8 * n, end - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, size in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, size))
            at += packed

    def read(self, frame: int) -> bytes:
        import zstandard

        at, packed, size = self.frames[frame]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at))
        if len(data) != size:
            raise ValueError("a frame does not have the size of its entry")
        return data


def marked_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``_id, _url, _html, _sha1, _first, _revisit``: what to write for each page.

    Of payloads of at least ``min_bytes`` that are equal, by digest, length and a second hash, the page
    with the smallest id is the response.  The aggregate combines in the map tasks; the join on the
    digest is split by the adaptive skew join where one payload is on many pages.
    """
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").alias("_id"), F.col("url").alias("_url"), html.alias("_html"))
    key = [
        F.sha1("_html").alias("_sha1"),
        F.octet_length("_html").alias("_size"),
        F.xxhash64("_html").alias("_check"),
    ]
    names = ["_sha1", "_size", "_check"]
    own = own.select("*", *key)
    first = own.filter(F.col("_size") >= min_bytes).groupBy(*names).agg(F.min("_id").alias("_first"))
    revisit = F.coalesce(~F.col("_id").eqNullSafe(F.col("_first")), F.lit(False))
    if min_bytes > 0:
        return own.join(first, names, "left").select(
            *own.columns, "_first", (revisit & (F.col("_size") >= min_bytes)).alias("_revisit")
        )
    return own.join(first, names).select(*own.columns, "_first", revisit.alias("_revisit"))


def write_archives(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per page into archives under ``folder``; the catalogue of them, staged.

    ``folder`` is in a store that every executor can write to.  A null ``html`` is an empty payload.  Rows
    that repeat the smallest id of a payload are all responses; null ids come last.  An empty table
    writes no archive.
    """
    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    marked = marked_pages(pages, min_bytes).select(
        F.col("_id").cast("string").alias("_id"),
        "_url",
        F.col("_html").cast("binary").alias("_html"),
        F.unhex("_sha1").alias("_sha1"),
        F.col("_first").cast("string").alias("_first"),
        "_revisit",
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            rows = []
            for page in zip(*batch.columns):
                page_id, url, payload, sha1, first, revisit = (v.as_py() for v in page)
                if writer is None:
                    writer = ArchiveWriter(folder, frame_bytes)
                record = make_record(page_id, url, payload, sha1, first, revisit)
                rows.append((*writer.add(record), record_id(page_id), page_id))
                if writer.written >= archive_bytes:
                    writer.close()
                    writer = None
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), *[pa.int64()] * 3, *[pa.string()] * 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["archive", "frame", "offset", "length", "record_id", "page_id"],
            )
        if writer is not None:
            writer.close()

    return stage(marked.mapInArrow(write, CATALOGUE), "catalogue")


def read_archives(catalogue: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """``RECORDS`` of every record in the catalogue, read from its frame; null payloads unless asked for.

    A frame is read once for all records in it; their number is bounded by the size of a frame.
    """
    # The catalogue is small beside what reading it takes, so the number of tasks is given.
    tasks = int(catalogue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = catalogue.repartition(tasks, "archive", "frame")
    frames = dealt.groupBy("archive", "frame").agg(
        F.collect_list(F.struct("offset", "length")).alias("places")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for batch in batches:
            for archive, frame, places in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != name:
                    reader, name = ArchiveReader(folder, archive), archive
                data = reader.read(frame)
                rows = [read_record(data[p["offset"] : p["offset"] + p["length"]]) for p in places]
                if not payloads:
                    rows = [(*r[:5], None) for r in rows]
                kinds = [pa.string(), pa.int64(), *[pa.string()] * 3, pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
                )

    return frames.sortWithinPartitions("archive", "frame").mapInArrow(read, RECORDS)


def archive_report(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` as read back from archives."""
    folder = folder or new_location(pages.sparkSession, "warc")
    catalogue = write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    return read_archives(catalogue, folder).select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
