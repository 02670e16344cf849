"""WARC archives: one gzip member per record, written and read sequentially.

Of records with equal payloads (same SHA-256 and length) the one with the least
page_id is a response, the others revisit it. The reader inflates members one
after the other with an incremental decompressor, frames each record by its
Content-Length and checks the block and payload digests.

Scale: payload digests are aggregated to one row each with partial aggregation,
so a page copied a million times costs one row per task; the digest table is
computed before the join that brings it back, so Spark can split a hot digest. Archives are rows of about `archive_bytes` each.

Defined results: null html is an empty payload; a null url leaves out the
target URI. Repeated rows of the least page_id are responses each. A row
without page_id revisits the response if there is one, else is a response.
Payloads of fewer than `min_revisit` bytes are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.store import Scratch, short_batches

DATE = "2000-01-01T00:00:00Z"
ARCHIVE_BYTES = 4 << 20
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, response: int | None, date: str = DATE) -> bytes:
    """A record as one gzip member. response: the page that it revisits, None for a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if response is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if response is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{response}>"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time."""
    rest, ended = b"", False
    while not (ended and not rest):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest:
                rest = next(chunks, b"")
                ended = not rest
                if ended:
                    if not out:
                        return
                    raise ValueError("the archive ends within a record")
            out.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else b""
        yield b"".join(out)
        if not rest:
            rest = next(chunks, b"")
            ended = not rest


def headers(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}


def parse(member: bytes) -> dict:
    """A record's fields; ValueError if framing or a digest is wrong."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    of = headers(head)
    if not head.startswith(b"WARC/") or not gap:
        raise ValueError("not a WARC record")
    n = int(of["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't frame the record")
    if of.get("warc-block-digest") != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    response = of["warc-type"] == "response"
    if response and of["warc-payload-digest"] != f"sha1:{digest(payload)}":
        raise ValueError("payload digest differs")
    page = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    return {"page_id": page(of["warc-record-id"]), "url": of.get("warc-target-uri"), "payload_bytes": len(payload) if response else int(headers(http)["content-length"]), "payload_digest": of["warc-payload-digest"].removeprefix("sha1:"), "record_type": of["warc-type"], "refers_to": page(of.get("warc-refers-to"))}


def _write(batches: Iterator[pa.RecordBatch], archive_bytes: int) -> Iterator[pa.RecordBatch]:
    out: list[bytes] = []
    size = 0
    for batch in batches:
        for row in range(batch.num_rows):
            page_id, url, html, response = (batch.column(i)[row].as_py() for i in range(4))
            out.append(record(page_id, url, (html or "").encode(), response))
            size += len(out[-1])
            if size >= archive_bytes:
                yield pa.record_batch([pa.array([b"".join(out)], pa.binary())], ["archive"])
                out, size = [], 0
    if out:
        yield pa.record_batch([pa.array([b"".join(out)], pa.binary())], ["archive"])


def _read(batches: Iterator[pa.RecordBatch], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column(0):
            data = archive.as_buffer()
            chunks = (data.slice(i, min(CHUNK, data.size - i)).to_pybytes() for i in range(0, data.size, CHUNK))
            out = []
            for member in members(chunks):
                out.append(parse(member))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_pylist(out, fields)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, fields)


def classify(pages: DataFrame, scratch: Scratch, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """page_id, url, html and response (the page revisited, else null)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    payload = F.coalesce("html", F.lit(""))
    keys = [F.sha2(payload, 256).alias("sha"), F.octet_length(payload).alias("size")]
    first = scratch.hold(rows.select(*keys, "page_id").groupBy("sha", "size").agg(F.min("page_id").alias("first")), "first")
    revisits = (F.col("size") >= min_revisit) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("*", *keys).join(first, ["sha", "size"]).select("page_id", "url", "html", F.when(revisits, F.col("first")).alias("response"))


def write_archives(classified: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows `archive`: gzip members one after the other, each row a whole .warc.gz."""
    short_batches(classified.sparkSession)
    return classified.mapInArrow(lambda it: _write(it, archive_bytes), "archive binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the archives in the only column (such as content of a binaryFile source)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(RECORDS))
    return archives.mapInArrow(lambda it: _read(it, fields), RECORDS)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = scratch.keep(write_archives(classify(pages, scratch)), "archives")
    scratch.drop("first")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY sha256(b), octet_length(b)) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST(CAST('0x' || substr(h || '0', i * 5 // 4 + 1, 2) AS INTEGER) AS INTEGER) >> CAST(3 - (i * 5) % 4 AS INTEGER)) % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM k
"""
