"""WARC archives: written with an index, read back through coalesced byte ranges of that index."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.caches import values
from linkspark.plans.staging import broadcast_if_small, new_folder, stage

#: A file is closed at this size; ranges of one file never span two.
FILE_BYTES = 256 << 20
#: Ranges closer than this are read as one; a read stops growing at READ_BYTES.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Bytes of the archives that one task reads back.
TASK_BYTES = 128 << 20

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string"
INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string())])
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: object) -> str:
    """A header value on one line."""
    return "".join(" " if c in "\r\n" else c for c in str(value))


#: Pages come without a time of capture.
DATE = "1970-01-01T00:00:00Z"
_HTTP = "application/http; msgtype=response"


def _member(head: list[str], block: bytes) -> bytes:
    """One gzip member: header lines, the block and the two line ends behind it."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    lines = ["WARC/1.1", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", *head, f"Content-Length: {len(block)}"]
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def encode_info(name: str) -> bytes:
    """The record that opens a file."""
    return _member(["WARC-Type: warcinfo", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"software: linkspark\r\nformat: WARC File Format 1.1\r\n")


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, refers_url: str | None = None) -> bytes:
    """A response record, or a revisit record: the same HTTP header without the payload.

    Record ids are drawn anew for each record, as pages may repeat their ids;
    the page's own id and the one that it revisits have headers of their own.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Target-URI: {_header(url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}", f"Content-Type: {_HTTP}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Refers-To-Target-URI: {_header(refers_url or '')}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return _member(head, block)


def decode_record(member: bytes) -> tuple:
    """The fields of ``RECORD`` from one gzip member; digests of blocks and stored payloads are computed again."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or digest_of(block) != fields["WARC-Block-Digest"][5:]:
        raise ValueError("a WARC record does not end where its length says, or its block is damaged")
    http, _, body = block.partition(b"\r\n\r\n")
    size, digest = int(http.rpartition(b": ")[2]), fields["WARC-Payload-Digest"][5:]
    if fields["WARC-Type"] == "response":
        if digest_of(body) != digest or len(body) != size:
            raise ValueError("a WARC payload does not match its digest")
    else:
        body = None
    page, refers = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID")
    return int(page) if page else None, fields["WARC-Target-URI"], body, size, digest, fields["WARC-Type"], int(refers) if refers else None


#: Names of object stores to Hadoop, and to the file systems that workers use.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file"}


def worker_uri(uri: str) -> str:
    """A folder as Hadoop names it, as the workers' file systems name it."""
    scheme, _, rest = uri.partition(":")
    if "/" in scheme or not rest:
        return f"file://{uri}"
    if scheme not in _SCHEMES:
        raise ValueError(f"archives cannot be written to {scheme}: folders; spark.checkpoint.dir must name one of {', '.join(_SCHEMES)}")
    return f"{_SCHEMES[scheme]}://{rest.removeprefix('//')}"


def _filesystem(uri: str):
    """The file system and path of a shared folder, as the executors reach it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(worker_uri(uri))


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Append records to files of this attempt's own; only indexed files count, so a retry does no harm."""
    files, base = _filesystem(folder)
    files.create_dir(base, recursive=True)
    out, name, at = None, "", 0
    for batch in batches:
        rows = []
        for page_id, url, html, refers, refers_url, revisit in zip(*map(values, batch.columns), strict=True):
            payload = (html or "").encode()
            digest = digest_of(payload)
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.gz"
                out = files.open_output_stream(f"{base}/{name}", compression=None)
                info = encode_info(name)
                out.write(info)
                at = len(info)
            record = encode_record(page_id, url, payload, digest, refers, bool(revisit), refers_url)
            out.write(record)
            rows.append((page_id, url, name, at, len(record), digest, len(payload), "revisit" if revisit else "response"))
            at += len(record)
            if at >= FILE_BYTES:
                out.close()
                out = None
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 8, INDEX_ARROW, strict=True)], schema=INDEX_ARROW)
    if out is not None:
        out.close()


def write_archives(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame]:
    """Write every page as a WARC record; returns the folder and the staged index.

    Of pages with equal payloads of at least ``min_bytes`` the one with the
    smallest id is a response and the others revisit it. Only digests and ids
    are shuffled; the payloads go straight from the scan to the archives.
    The index row of a record is committed with its task, so files of lost or
    repeated attempts are never read.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    sha = F.unhex(F.sha1(F.col("html").cast("binary")))
    light = rows.select("page_id", "url", F.octet_length("html").alias("bytes"), sha.alias("digest")).where(F.col("bytes") >= min_bytes)
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    groups = light.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))
    groups = stage(groups, "warc-groups")
    folder = new_folder(pages.sparkSession, "warc")
    typed = rows.withColumn("digest", sha).join(broadcast_if_small(groups, 160), "digest", "left")
    revisit = F.coalesce(~F.col("first").eqNullSafe(F.col("page_id")) & F.col("first").isNotNull(), F.lit(False))
    typed = typed.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_url"), revisit.alias("revisit"))
    return folder, stage(typed.mapInArrow(lambda batches: _write(batches, folder), INDEX), "warc-index")


def coalesce_ranges(offsets: list[int], lengths: list[int], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int]]:
    """Sorted ranges merged into reads: ``(first range, range after the last, bytes)``."""
    reads, i = [], 0
    while i < len(offsets):
        j, end = i + 1, offsets[i] + lengths[i]
        while j < len(offsets) and offsets[j] - end <= gap and offsets[j] + lengths[j] - offsets[i] <= most:
            end = max(end, offsets[j] + lengths[j])
            j += 1
        reads.append((i, j, end - offsets[i]))
        i = j
    return reads


def _read(pdf: pd.DataFrame, folder: str, payloads: bool) -> pd.DataFrame:
    files, base = _filesystem(folder)
    pdf = pdf.sort_values("offset")
    offsets, lengths, rows = pdf["offset"].tolist(), pdf["length"].tolist(), []
    with files.open_input_file(f"{base}/{pdf['file'].iloc[0]}") as f:
        for i, j, size in coalesce_ranges(offsets, lengths):
            block = memoryview(f.read_at(size, offsets[i]))
            for k in range(i, j):
                at = offsets[k] - offsets[i]
                record = decode_record(block[at : at + lengths[k]])
                rows.append(record if payloads else (*record[:2], None, *record[3:]))
    out = pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_records(folder: str, selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the ``selected`` index rows, read by byte range.

    Rows are grouped by file and block of ``READ_BYTES``; each group sorts its
    ranges and merges neighbours into one read, so a task holds one block at a
    time. The groups are dealt to tasks by the bytes behind the index, not by
    its own few. ``payloads=False`` checks every payload but returns none.
    """
    size = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    least = min(selected.sparkSession.sparkContext.defaultParallelism, -(-size // READ_BYTES))
    block = F.floor(F.col("offset") / READ_BYTES).alias("block")
    dealt = selected.select("file", "offset", "length", block).repartition(max(1, least, -(-size // TASK_BYTES)), "file", "block")
    return dealt.groupBy("file", "block").applyInPandas(lambda pdf: _read(pdf, folder, payloads), RECORD)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, then read every record back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to, url)``.

    Null html counts as an empty payload and takes part in deduplication like
    any other. Null ids are archived; they revisit an equal payload
    that has an id, and are responses where none has. Repeated rows are
    records of their own; all rows with the smallest id are responses. Line breaks in urls become
    blanks. Other columns are not read. An empty table gives no rows.
    """
    folder, index = write_archives(pages, min_bytes)
    return read_records(folder, index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
