"""WARC archives: index first, then coalesced range reads.

Every partition writes archives of about ARCHIVE bytes into a folder that all executors share: a gzip member per record, under file names of
its own attempt, so a retried task leaves no half-written archive in the index. The index (archive, offset, length, URL, digest per
record) is a table beside the archives. A read takes index rows, deals them by archive and stretch of RANGE bytes to as many tasks as their summed
lengths ask for, orders them by archive and offset, joins neighbours into ranges of at most RANGE bytes with gaps of at most GAP, and reads each range once.

Of records with equal payloads of at least `least_bytes`, that with the largest page_id holds the payload; the others are
revisits that name it. Payloads are compared by SHA-1 and length.

Defined results: a null html is an empty payload; a null url is written as an empty target; a null page_id sorts below all others (as a
record's id it is written as `null`); rows that tie for the largest page_id are all responses; an empty table gives no archives
and an empty index; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcurve.llm.common import shared_dir, small, stored

RANGE, GAP = 8 << 20, 64 << 10
ARCHIVE = 1 << 30
#: Bytes of records that a read task takes: the least where all cores are busy, and the most.
TASK_LEAST, TASK_MOST = 4 << 20, 256 << 20
INDEX = "page_id long, archive string, offset long, length long, url string, digest string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    body = b"" if revisit else payload
    lines = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"] if revisit else []),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 5, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and content block of one record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """digest, n_bytes, original (the largest page_id; null if none has one) of payloads that several rows share."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    d = pages.select("page_id", F.sha1(body).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("n_bytes")).where(f"n_bytes >= {least_bytes}")
    return d.groupBy("sha", "n_bytes").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")


def write(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes archives and index for page_id, url, html; returns the index, read back from the folder. A record that would pass archive_bytes begins a new archive."""
    shared, _ = small(stored(originals(pages, least_bytes), "originals"))
    body = F.coalesce("html", F.lit(""))
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"), F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).cast("long").alias("n_bytes"))
    d = d.join(shared.withColumn("shared", F.lit(True)), ["sha", "n_bytes"], "left")
    d = d.select("page_id", "url", "html", F.coalesce(F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("original")), F.lit(False)).alias("revisit"), "original")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, path = None, 0, ""
        for batch in batches:
            rows = []
            for page, url, html, revisit, original in zip(*(batch.column(c) for c in ("page_id", "url", "html", "revisit", "original")), strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                digest = payload_digest(payload)
                member = record(page.as_py(), url.as_py(), payload, digest, original.as_py(), revisit.as_py())
                if out is not None and at + len(member) > archive_bytes:
                    out.close()
                    out = None
                if out is None:
                    at, path = 0, f"{folder}/archive-{uuid.uuid4().hex}.warc.gz"
                    fs, inner = pafs.FileSystem.from_uri(path)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(inner, compression=None)  # the members are compressed already
                out.write(member)
                rows.append((page.as_py(), path, at, len(member), url.as_py(), digest))
                at += len(member)
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "archive", "offset", "length", "url", "digest"])
        if out is not None:
            out.close()

    spark = pages.sparkSession
    d.mapInArrow(archive, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def coalesced(rows: Iterator[tuple[int, int]], most: int = RANGE, gap: int = GAP) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, members) of ranges that cover ordered (offset, length)."""
    start = end = 0
    held: list[tuple[int, int]] = []
    for offset, length in rows:
        if held and (offset - end > gap or max(end, offset + length) - start > most):
            yield start, end, held
            held = []
        if not held:
            start = end = offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield start, end, held


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows (RECORD; a revisit's payload is null), from as few range reads as possible."""
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // TASK_MOST), min(-(-total // TASK_LEAST), 2 * index.sparkSession.sparkContext.defaultParallelism))
    d = index.select("archive", "offset", "length").repartition(tasks, "archive", F.floor(F.col("offset") / RANGE)).sortWithinPartitions("archive", "offset")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        held, source = None, None
        for batch in batches:
            paths, offsets, lengths = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
            a = 0
            while a < len(paths):
                b = a
                while b < len(paths) and paths[b] == paths[a]:
                    b += 1
                if held != paths[a]:
                    if source is not None:
                        source.close()
                    fs, inner = pafs.FileSystem.from_uri(paths[a])
                    held, source = paths[a], fs.open_input_file(inner)
                for start, end, members in coalesced(zip(offsets[a:b], lengths[a:b], strict=True)):
                    data = source.read_at(end - start, start)
                    rows = []
                    for offset, length in members:
                        fields, body = parse(data[offset - start : offset - start + length])
                        revisit = fields["WARC-Type"] == "revisit"
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and payload_digest(body) != digest:
                            raise ValueError(f"damaged record at {offset} of {held}")
                        rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], int(fields["X-Payload-Length"]), digest, _page(fields.get("WARC-Refers-To")), body if payloads and not revisit else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                a = b
        if source is not None:
            source.close()

    return d.mapInArrow(fetch, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Every row of pages, written into archives below the shared folder and read back."""
    folder = shared_dir(pages.sparkSession, "warc")
    return read(write(pages.select("page_id", "url", "html"), folder, least_bytes), payloads)
