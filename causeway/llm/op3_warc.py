"""WARC writing with revisit resolution.

Headers (payload digest, page_id, url) are shuffled by payload digest, without their payloads; each digest's smallest page_id
is the original response, and the records of other pages with that digest are joined to it as revisits, a frequent digest's
dealt over tasks. The pages then meet those decisions by page and digest, and tasks write gzip archives with fresh
headers: responses with their payload, revisits without. Payloads count as equal when their SHA-1 digests are.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, in_bitmap, narrow, read_blobs, shared_dir, small_batches, spread_join, staged, write_blob

FILE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload) -> F.Column:
    """Bare upper-case base32 of the SHA-1, from built-in functions: 5 hex digits make 4 letters."""
    h = F.sha1(payload)
    words = [F.conv(F.substring(h, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    letters = [F.substring(F.lit(_ALPHABET), F.shiftright(w, s).bitwiseAND(31) + 1, F.lit(1)) for w in words for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:unknown")


def record(row: dict, date: str, name: uuid.UUID) -> bytes:
    """One WARC/1.1 record, CRLF lines, two CRLFs at its end. name: an id of its own. A revisit names the original by target and date, and
    by page; record ids are only known once written, so none is guessed."""
    revisit = row["record_type"] == "revisit"
    block = _HTTP % row["payload_bytes"] + (b"" if revisit else row["payload"])
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(row['url'])}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if row["page_id"] is not None:
        head.append(f"X-Page-Id: {row['page_id']}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {_uri(row['origin_url'])}", f"WARC-Refers-To-Date: {date}"]
        if row["refers_to"] is not None:
            head.append(f"X-Refers-To-Page-Id: {row['refers_to']}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(blob: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each gzip member."""
    at = 0
    while at < len(blob):
        z, parts = zlib.decompressobj(31), []
        while not z.eof and at < len(blob):
            parts.append(z.decompress(blob[at : at + 65536]))
            at += 65536
        at = min(at, len(blob)) - len(z.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Each page with payload_bytes, payload_digest, record_type, refers_to and origin_url; payload only for responses.
    Of equal payloads of min_bytes or more the smallest page_id responds (a null page_id is smallest; rows
    that repeat it respond too); null html is an empty payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = narrow(pages, page_id="long", url="string", html="string").select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    headers = staged(rows.where(F.col("payload_bytes") >= min_bytes).select("page_id", "url", "payload_bytes", "payload_digest"))
    first = F.min(F.struct(F.col("page_id").isNotNull().alias("some"), "page_id", "url"))
    origins = staged(headers.groupBy("payload_digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = spread_join(headers, origins.select("payload_digest", "first"), "payload_digest", origins)
    # a page_id that isn't the smallest one is never null
    again = staged(met.where(~F.col("page_id").eqNullSafe(F.col("first.page_id"))).withColumn("pair", F.xxhash64("page_id", "payload_digest")))
    none = lambda kind: F.lit(None).cast(kind)
    fields = ["page_id", "url", "payload_bytes", "payload_digest"]
    # revisits are made of headers alone; payloads go through a shuffle only where the bitmap takes a page for a revisit
    revisits = again.select(*fields, F.lit("revisit").alias("record_type"), F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("origin_url"), none("binary").alias("payload"))
    pairs = again.select("page_id", "payload_digest", "pair").distinct()
    bits = bitmap_of(pairs, "pair")
    may = F.lit(True) if bits is None else in_bitmap(bits, F.xxhash64("page_id", "payload_digest"))
    responses = rows.where(may).join(pairs, ["page_id", "payload_digest"], "left_anti").select(rows.columns)
    if bits is not None:
        responses = rows.where(~may).union(responses)
    return responses.select(*fields, F.lit("response").alias("record_type"), none("long").alias("refers_to"), none("string").alias("origin_url"), "payload").union(revisits)


def write_archives(resolved: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the records; returns the staged manifest (path, n_records)."""
    small_batches(resolved.sparkSession)

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, out, parts, size, run, count = TaskContext.get().partitionId(), [], [], 0, uuid.uuid4(), 0

        def close() -> None:
            nonlocal parts, size
            out.append({"path": write_blob(folder, f"crawl-{part:06d}-{len(out):04d}.warc.gz", parts), "n_records": len(parts)})
            parts, size = [], 0

        for b in batches:
            for row in b.to_pylist():
                z, count = zlib.compressobj(3, zlib.DEFLATED, 31), count + 1
                parts.append(z.compress(record(row, date, uuid.uuid5(run, str(count)))) + z.flush())
                size += len(parts[-1])
                if size >= FILE_BYTES:
                    close()
        if parts:
            close()
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    return staged(resolved.mapInArrow(write, "path string, n_records long"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id. A response's size
    and digest are taken from the payload read back; one that doesn't match its header is an error."""

    def parse(blob: bytes) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string())])
        rows = []
        for fields, block in records(blob):
            head, _, payload = block.partition(b"\r\n\r\n")
            size, digest = int(head.rpartition(b"Content-Length: ")[2]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response":
                if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                    raise ValueError("payload and header differ")
            page, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
            rows.append({"page_id": page and int(page), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": to and int(to), "url": fields["WARC-Target-URI"], "record_id": fields["WARC-Record-ID"]})
        yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return read_blobs(manifest.select("path"), parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string")


def warc(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as deduplicated archives and reads them back. An empty table
    gives no archive and an empty result; other columns are not read."""
    return read_archives(write_archives(resolve(pages, min_bytes), folder or shared_dir(pages.sparkSession)))
