"""WARC archives by way of a chunked record table.

Writing: a page's payload becomes rows (rid, chunk_no, data) of at most
``chunk_bytes``; each row also carries the byte count and the SHA-1 of the
payload up to its end, so the last row of a record has both of the whole, and
no task ever holds more of a payload than a chunk (beyond the one table cell it
came in). From the last rows follows which record is a response and which
revisits one: the smallest (page_id, rid) of equal payloads, found by partial
aggregates, so a payload shared by a third of all pages is no hot group. Header
rows (chunk_no -1) and chunk rows then meet in one shuffle by rid, sorted by
(rid, chunk_no), and stream into one gzip archive per task, a member a record.
Archives get names of their own; a lost task's file is in no manifest.

Reading streams archives back into the same kind of table: digests are computed
anew from the payload bytes and compared with the headers.

Edge cases: a null html is an empty payload; a null url has no WARC-Target-URI;
repeated rows are records of their own (the first by rid is the response); a
null page_id sorts last and stays null; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalcat.llm.common import scratch, staged, store_of

CHUNK = 256 << 10
# Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %s\r\n\r\n"


def _base32(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def chunk_records(pages: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """(rid, page_id, url, chunk_no, is_last, bytes_so_far, digest_so_far,
    data): a row per chunk, at least one per page, those of a record one after
    another."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, size = hashlib.sha1(), 0
        for batch in batches:
            so_far, digests = [], []
            for no, data in zip(batch.column("chunk_no").to_pylist(), batch.column("data")):
                if no == 0:
                    sha, size = hashlib.sha1(), 0
                part = data.as_buffer()
                sha.update(part)
                size += part.size
                so_far.append(size)
                digests.append(_base32(sha))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(so_far, pa.int64()), pa.array(digests, pa.string()), batch.column("data")],
                names=["rid", "page_id", "url", "chunk_no", "is_last", "bytes_so_far", "digest_so_far", "data"],
            )

    rows = pages.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    last = F.floor((F.greatest(F.octet_length("payload"), F.lit(1)) - 1) / F.lit(chunk_bytes)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("payload"), i * chunk_bytes + 1, F.lit(chunk_bytes)))
    chunks = rows.select("rid", "page_id", "url", last.alias("last"), F.posexplode(cut).alias("chunk_no", "data")).select(
        "rid", "page_id", "url", "chunk_no", (F.col("chunk_no") == F.col("last")).alias("is_last"), "data"
    )
    return chunks.mapInArrow(digest, "rid long, page_id long, url string, chunk_no int, is_last boolean, bytes_so_far long, digest_so_far string, data binary")


def decide(chunks: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A row per record: which is a response, which revisits which. Payloads of
    fewer than ``min_bytes`` are all responses."""
    heads = chunks.where("is_last").select("rid", "page_id", "url", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("digest"))
    key = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "rid")
    firsts = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes").agg(F.min(key).alias("first"))
    other = F.col("first").isNotNull() & (F.col("first.rid") != F.col("rid"))
    return heads.join(firsts, ["digest", "payload_bytes"], "left").select(
        "rid", "page_id", "url", "payload_bytes", "digest",
        F.when(other, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(other, F.col("first.page_id")).alias("refers_to"),
        F.when(other, F.col("first.rid")).alias("refers_to_rid"),
    )


def _urn(page_id, rid):
    return F.concat(F.lit("<urn:evalcat:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), rid.cast("string"), F.lit(">"))


def header(date: str):
    """The WARC and HTTP header of a row of ``decide``."""
    http = F.format_string(_HTTP, F.col("payload_bytes").cast("string"))
    revisit = F.col("record_type") == "revisit"
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    # a line break in a url would start a header of its own
    url = F.regexp_replace(F.col("url"), r"[\r\n]", " ")
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"), F.col("rid"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("refers_to"), F.col("refers_to_rid")))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
    )
    return F.encode(F.concat(lines, F.lit("\r\n\r\n"), http), "UTF-8")


def write_archives(pages: DataFrame, path: str | None = None, min_bytes: int = 0, chunk_bytes: int = CHUNK, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of pages (page_id, url, html); returns the
    manifest (path, records)."""
    folder = path or scratch(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = member = None
        name, records, skip = f"{uuid.uuid4().hex}.warc.gz", 0, False
        for batch in batches:
            for no, revisit, data in zip(batch.column("chunk_no").to_pylist(), batch.column("revisit").to_pylist(), batch.column("data")):
                if out is None:
                    store, base = store_of(folder)
                    store.create_dir(base)
                    out = store.open_output_stream(f"{base}/{name}", buffer_size=1 << 20)
                if no < 0:
                    if member:
                        out.write(member.compress(b"\r\n\r\n") + member.flush())
                    member, skip = zlib.compressobj(6, zlib.DEFLATED, 31), revisit
                    records += 1
                if no < 0 or not skip:
                    out.write(member.compress(data.as_buffer()))
        if out:
            out.write(member.compress(b"\r\n\r\n") + member.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64())], names=["path", "records"])

    chunks = staged(chunk_records(pages, chunk_bytes), "warc-chunks")
    heads = decide(chunks, min_bytes).select("rid", F.lit(-1).alias("chunk_no"), (F.col("record_type") == "revisit").alias("revisit"), header(date).alias("data"))
    bodies = chunks.select("rid", "chunk_no", F.lit(None).cast("boolean").alias("revisit"), "data")
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = heads.unionByName(bodies).repartition(n, "rid").sortWithinPartitions("rid", "chunk_no")
    return staged(stream.mapInArrow(write, "path string, records long"), "warc-manifest")


_FIELDS = "record_id string, record_type string, page_id long, refers_to long, url string, chunk_no int, is_last boolean, payload_bytes long, payload_digest string, data binary"


def records_of(src, chunk_bytes: int, with_data: bool) -> Iterator[tuple]:
    """Rows of ``_FIELDS`` from an open archive, without holding a record.
    Payload bytes and digest run up to and with the row's chunk."""

    def fields() -> dict[bytes, bytes]:
        out = {}
        while (line := src.readline()).strip():
            key, _, value = line.partition(b":")
            out[key.strip().lower()] = value.strip()
        return out

    def page(urn: bytes | None):
        own = urn.decode().strip("<>").split(":")[-2] if urn else "null"
        return None if own == "null" else int(own)

    while line := src.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = fields()
        status, http, block = src.readline(), {}, len(b"")
        block = len(status)
        while (line := src.readline()) and line.strip():
            block += len(line)
            key, _, value = line.partition(b":")
            http[key.strip().lower()] = value.strip()
        block += len(line)
        left = int(head[b"content-length"]) - block
        kind, digest = head[b"warc-type"].decode(), head[b"warc-payload-digest"].decode().partition(":")[2]
        own = (head[b"warc-record-id"].decode(), kind, page(head[b"warc-record-id"]), page(head.get(b"warc-refers-to")), head[b"warc-target-uri"].decode() if b"warc-target-uri" in head else None)
        if kind == "revisit":
            yield (*own, 0, True, int(http[b"content-length"]), digest, b"")
            continue
        sha, size, no = hashlib.sha1(), 0, 0
        while True:
            data = src.read(min(left, chunk_bytes))
            if left and not data:
                raise ValueError("an archive ends within a record")
            sha.update(data)
            size, left = size + len(data), left - len(data)
            if not left and _base32(sha) != digest:
                raise ValueError(f"payload and digest differ in {own[0]}")
            yield (*own, no, not left, size, _base32(sha), data if with_data else b"")
            no += 1
            if not left:
                break


def read_archives(spark: SparkSession, manifest: DataFrame, chunk_bytes: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of all archives of a manifest; the last row of
    a record has its whole size and digest. ``with_data`` False leaves the
    bytes behind once they are counted and digested."""
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for uri in batch.column("path").to_pylist():
                store, name = store_of(uri)
                with store.open_input_stream(name, buffer_size=1 << 20) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) as src:
                    rows, held = [], 0
                    for row in records_of(src, chunk_bytes, with_data):
                        rows.append(row)
                        held += len(row[-1]) + 200
                        if held > 4 << 20:
                            yield made(rows)
                            rows, held = [], 0
                    if rows:
                        yield made(rows)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, _FIELDS)
