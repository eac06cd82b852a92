"""WARC archives with an index written first and read by coalesced byte ranges.

Writing: every record is a gzip member of its own, so it can be read alone. A task writes
its records to files with unique names in a shared folder and returns one index row per
record (file, offset, length, URL, digest ...); the index is a table. A task that runs
again writes new files, and the index names only those of the run that counted.

Reading: selected index rows are grouped into byte ranges of neighbouring records, sorted
by file and offset; each range is one read, and a task gets ranges of bounded length.

Records are of type ``response`` with an HTTP block, or ``revisit`` with its headers only.

The archives' folder must be on a file system that pyarrow opens (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path

#: Payloads of at least this many bytes are stored once.
MIN_DEDUP_BYTES = 0
#: A file is closed once it is this long; a range read is about this long.
FILE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
#: Stored bytes that a task reads, about.
TASK_BYTES = 32 << 20
GZIP_LEVEL = 2
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string, refers_to long, payload_bytes long"


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The fields of the record and of its HTTP block, and the payload in it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data, digest = payload.encode(), _b32(digest)
                press = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                member = press.compress(_record(page_id, url, data, digest, refers_to)) + press.flush()
                out.write(member)
                rows.append((name, at, len(member), page_id, url, digest, "response" if refers_to is None else "revisit", refers_to, len(data)))
                at += len(member)
            names = [x.split()[0] for x in INDEX.split(", ")]
            kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in INDEX.split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, folder: str, min_dedup_bytes: int = MIN_DEDUP_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per page below ``folder`` and return the index, a stored table.

    Of equal payloads of at least ``min_dedup_bytes`` the one with the smallest page_id is
    the response and later ids revisit it. A null html is an empty payload. Rows that
    share the smallest id of a payload are responses all; a null page_id revisits any
    other and is a response where no page has an id. A null URL leaves the field out. A
    payload is held whole while its record is pressed, however long. An empty table writes no
    files. Columns that are not named are ignored.
    """
    payload = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    firsts = base.where(F.octet_length("payload") >= min_dedup_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts.select("digest", "first"), "warc-firsts")
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    rows = base.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", F.when(later, F.col("first")).alias("refers_to"))
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return materialize(rows.mapInArrow(_writer(folder, file_bytes), INDEX), "warc-index")


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start, end, records in zip(*(batch.column(k).to_pylist() for k in ("file", "start", "end", "records")), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    f.seek(start)
                    data = f.read(end - start)
                rows = []
                for r in records:
                    at = r["offset"] - start
                    fields, http, body = parse_record(zlib.decompress(data[at : at + r["length"]], 31))
                    ident = lambda k: int(x) if (x := fields[k][len("<urn:page:") : -1]) else None
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and _b32(hashlib.sha1(body).digest()) != digest:
                        raise ValueError(f"payload of {name} at {r['offset']} does not match its digest")
                    full = len(body) if kind == "response" else int(http["Content-Length"])
                    rows.append((ident("WARC-Record-ID"), fields.get("WARC-Target-URI"), body.decode() if kind == "response" else None, full, digest, kind, ident("WARC-Refers-To") if kind == "revisit" else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], READ_NAMES)

    return read


READ_NAMES = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def read_archives(index: DataFrame, folder: str, selected: Column | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the index rows for which ``selected`` holds (all by default).

    Responses come with their html, revisits with null; sizes and digests are those of
    the full payload. Digests of responses are verified. Records of a range are in one
    task, which holds about ``range_bytes`` or one longer record. The number of tasks
    follows the stored bytes.
    """
    chosen = index if selected is None else index.where(selected)
    stored = chosen.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-stored // TASK_BYTES), min(-(-stored // range_bytes), index.sparkSession.sparkContext.defaultParallelism), 1)
    place = F.floor(F.col("offset") / range_bytes)
    one = F.struct("offset", "length")
    ranges = chosen.groupBy("file", place.alias("place")).agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(one)).alias("records")
    )
    return ranges.select("file", "start", "end", "records").repartition(tasks, "file", "start").mapInArrow(
        _reader(folder), "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to a scratch folder and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hx FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY hx) AS first FROM p),
c AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(hx, (k * 5 + 1)::INT, 5))::BIGINT) AS parts FROM g)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[(j // 4 + 1)::INT] >> (15 - 5 * (j % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM c
"""
