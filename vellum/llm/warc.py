"""WARC archives as seekable Zstandard bundles.

A bundle is one file of independent Zstandard frames.  Each frame holds some whole WARC records.  Two skippable frames
end the file: an index that maps the identifier of every record to its frame and its offset in the frame, and the
seek table of the public seekable format, whose last bytes are its magic number.  Any Zstandard reader can
read the whole; a reader of one record decompresses one frame.

Bundles are written by Spark's own writer, one file a bundle, so they reach any store that Spark can write, and only
files of tasks that ended well count.  Spark has no writer of raw bytes, but its text writer copies the bytes of a
string as they are and ends a row by a separator: the separator is set to the magic number that ends a bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import store

#: Uncompressed bytes from which on a frame, and a bundle, is complete.
FRAME_BYTES = 256_000
BUNDLE_BYTES = 16_000_000

#: Fixed values of the Zstandard and seekable formats.
SKIPPABLE_INDEX = 0x184D2A5D
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = b"\xb1\xea\x92\x8f"

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page_id(identifier: str) -> int | None:
    own = identifier.removeprefix("<urn:x-page:").removesuffix(">")
    return None if own == "null" else int(own)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC 1.1 record; a revisit keeps the HTTP header, with the payload's length, and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else url))
    fields.append(("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_records(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of each record."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        yield at, fields, raw[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


class BundleWriter:
    """Collects records into frames, and frames into a bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.done, self.sizes, self.index, self.open, self.size = [], [], [], [], 0
        self.total = 0

    def add(self, identifier: str, record: bytes) -> None:
        self.index.append((identifier, len(self.sizes), self.size))
        self.open.append(record)
        self.size += len(record)
        self.total += len(record)
        if self.size >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            frame = self.zstd.compress(b"".join(self.open))
            self.done.append(frame)
            self.sizes.append((len(frame), self.size))
            self.open, self.size = [], 0

    def finish(self) -> bytes:
        """The whole file."""
        self._close_frame()
        entries = b"".join(struct.pack("<III", frame, offset, len(i.encode())) + i.encode() for i, frame, offset in self.index)
        index = struct.pack("<II", SKIPPABLE_INDEX, len(entries)) + entries
        # The index frame is an entry of no content, so that the entries add up to where the seek table starts.
        table = b"".join(struct.pack("<II", c, d) for c, d in [*self.sizes, (len(index), 0)])
        table += struct.pack("<IB", len(self.sizes) + 1, 0) + SEEKABLE_MAGIC
        return b"".join(self.done) + index + struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table


class BundleReader:
    """Random access to a bundle's frames and records."""

    def __init__(self, raw: bytes):
        if raw[-4:] != SEEKABLE_MAGIC:
            raise ValueError("not a seekable bundle")
        n, descriptor = struct.unpack("<IB", raw[-9:-4])
        width = 12 if descriptor & 0x80 else 8
        start = len(raw) - 9 - n * width
        if struct.unpack("<II", raw[start - 8 : start]) != (SKIPPABLE_SEEK_TABLE, n * width + 9):
            raise ValueError("the seek table is damaged")
        self.raw, self.frames, at = raw, [], 0
        for i in range(n):
            c, d = struct.unpack("<II", raw[start + i * width : start + i * width + 8])
            self.frames.append((at, c, d))
            at += c

    def frame(self, number: int) -> bytes:
        at, c, d = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.raw[at : at + c], max_output_size=d) if d else b""

    def index(self) -> list[tuple[str, int, int]]:
        """(identifier, frame, offset in the frame) of every record."""
        at, c, _ = self.frames[-1]
        raw, at, out = self.raw[at + 8 : at + c], 0, []
        while at < len(raw):
            frame, offset, n = struct.unpack("<III", raw[at : at + 12])
            out.append((raw[at + 12 : at + 12 + n].decode(), frame, offset))
            at += 12 + n
        return out

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        """One record, from its frame alone."""
        _, fields, block = next(parse_records(self.frame(frame)[offset:]))
        return fields, block

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for number in range(len(self.frames)):
            for _, fields, block in parse_records(self.frame(number)):
                yield fields, block


def _bundles(date: str, frame_bytes: int, bundle_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = BundleWriter(frame_bytes)
        for batch in batches:
            for page, url, html, keep, revisit in zip(*(c for c in batch.columns), strict=True):
                page, payload = page.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass")
                out.add(record_id(page), make_record(page, url.as_py(), payload, keep.as_py(), revisit.as_py(), date))
                if out.total >= bundle_bytes:
                    yield _row(out)
                    out = BundleWriter(frame_bytes)
        if out.total:
            yield _row(out)

    def _row(out: BundleWriter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([out.finish()[: -len(SEEKABLE_MAGIC)]], pa.binary())], ["content"])

    return work


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Write every row of `pages` as a record into bundles under `path`.

    Of rows with equal payloads of at least `min_bytes` bytes the one with the largest page_id is the response and the
    others revisit it; smaller payloads are all responses.  Rows that share the largest page_id are all responses; a
    null page_id is smaller than any other (with none other, all are responses).  A null html is an empty payload, a
    null url leaves its field out.  An empty table writes no bundle.  Only the named columns are read.
    """
    spark = pages.sparkSession
    store.prepare(spark)
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("html"))
    light = store.keep(rows.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("sha"), F.octet_length("html").alias("n")).where(F.col("n") >= min_bytes).drop("n"), "digests")
    groups = light.groupBy("sha").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Two plain tables meet on the digest, so that a payload that very many rows share can be split over tasks.
    revisits = light.join(store.keep(groups, "groups"), "sha").where("keep is not null and not (page_id <=> keep)")
    # Rows of one page_id and digest are alike; the large rows are joined on the id, which spreads them evenly.
    revisits = store.keep(revisits.select(F.col("page_id").alias("id"), F.col("sha").alias("own"), "keep").distinct(), "revisits")
    same = rows.page_id.eqNullSafe(revisits.id) & (F.sha1(F.encode("html", "UTF-8")) == revisits.own)
    decided = rows.join(revisits, same, "left").select("page_id", "url", "html", "keep", F.col("own").isNotNull().alias("revisit"))
    bundles = decided.mapInArrow(_bundles(date, frame_bytes, bundle_bytes), "content binary")
    bundles.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", SEEKABLE_MAGIC.decode("latin-1")).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(*batch.columns, strict=True):
            rows = BundleReader(content.as_py()).index() if len(content.as_py()) > 4 else []
            ids, frames, offsets = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64())], ["path", "record_id", "frame", "offset"])


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, record_id, frame, offset) of every record under `path`."""
    return _files(spark, path).mapInArrow(_index, "path string, record_id string, frame int, offset long")


_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _records(with_payload: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in _RECORDS.split(", ")]
        for batch in batches:
            for content in batch.column(1):
                raw, rows = content.as_py(), []
                for fields, block in BundleReader(raw).records() if len(raw) > 4 else ():
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
                    refers = _page_id(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((_page_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind, refers, payload if with_payload and kind == "response" else None))
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return work


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """Every record under `path`; payloads are checked against their digests."""
    return _files(spark, path).mapInArrow(_records(with_payload), _RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "warc")
    write_archives(store.read(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
), h AS (
  SELECT page_id, last, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS sha FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST(('0x' || substr(sha, 1 + 5 * CAST(i // 4 AS INT), 5)) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM h
"""
