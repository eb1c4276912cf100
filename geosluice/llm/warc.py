"""WARC archives with segmented records, written and read back by Spark.

Writing: each page becomes an HTTP response in chunked transfer framing.  A
block longer than `segment_bytes` is split into a first record and continuation
records that name it as origin, count segments, and end with the total length.
Pages whose payload another page has already become revisit records.  Records
are written by Spark's text writer with CRLF as line end, so archives can lie in
any store that Spark knows, and commits are Spark's.

Reading: whole files are parsed by content length; segmented records are grouped
by origin identifier, ordered by segment number, checked for gaps and against
the total length, joined, and their chunked framing decoded.  Revisits find
their payload's length at the response they name.

Cases: null html is an empty payload; a null page_id is written as `null`, and
read back as null; a null url has no target; rows with the smallest page_id of a
payload are responses all; rows with equal page_id are told apart by a serial
number; segments missing or at odds with the total length give record_type
`damaged` with a null payload; a long payload is many segments, put together in one
task; extra columns are ignored whatever their names; no pages, no archives, an empty
result.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, table

SEGMENT = 16 << 10
CHUNK = 4 << 10
RECORDS_PER_FILE = 20_000
SMALLEST_REVISIT = 100
#: Payloads with several holders are broadcast up to this many (about 100 bytes each).
MOST_KNOWN = 250_000
READ = "record_id string, record_type string, page_id string, refers_to string, digest string, segment long, total long, block binary"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    out = []
    for i in range(0, len(body), size):
        part = body[i : i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def dechunked(data: bytes) -> bytes:
    """The body of a chunked message; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk length")
        out.append(data[at : at + size])
        at += size + 2


def _record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n"


def page_records(page, serial: int, url, body: bytes, digest: str, refers_to, segment_bytes: int) -> list[bytes]:
    """The records of one page, each without the last CRLF."""
    name = "null" if page is None else str(page)
    target = re.sub(r"[\r\n]+", " ", url) if url is not None else None
    own = f"<urn:x-page:{name}:{serial}>"
    common = [("WARC-Record-ID", own), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        return [_record("revisit", [*common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")], b"")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(body)
    common.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= segment_bytes:
        return [_record("response", common, block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record("response", [*common, ("WARC-Segment-Number", 1)], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        fields = [("WARC-Record-ID", f"{own[:-1]}:{i}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", i)]
        out.append(_record("continuation", fields + [("WARC-Segment-Total-Length", len(block))] * (i == len(parts)), part))
    return out


def look_up(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of known (keys, n rows of each, ...) for their keys, null if there are none.

    Up to MOST_KNOWN keys are broadcast, so rows with their bodies stay where they are; of more,
    only those of the most rows, which are at most so many, and the others meet by a shuffle."""
    if known.count() <= MOST_KNOWN:
        return rows.join(F.broadcast(known.drop("n")), keys, "left")
    often = known.agg(F.sum("n")).first()[0] // MOST_KNOWN
    hot, other = known.where(F.col("n") > often).drop("n"), known.where(F.col("n") <= often).drop("n")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(other, keys, "left")
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT, records_per_file: int = RECORDS_PER_FILE) -> None:
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("body"))
    p = p.withColumn("digest", F.sha2("body", 256))
    # a digest with one holder needs no look-up, so the joined side is as small as the repeats are
    first = p.where(F.octet_length("body") >= SMALLEST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    p = look_up(p, cut(first, "first"), ["digest"]).withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")
    p = p.withColumn("serial", F.monotonically_increasing_id())

    def run(batches):
        for batch in batches:
            out = []
            for page, serial, url, body, digest, refers in zip(*(batch.column(c).to_pylist() for c in range(6))):
                out += page_records(page, serial, url, body, digest, refers, segment_bytes)
            yield pa.record_batch([pa.array(out, pa.binary())], ["record"])

    records = p.select("page_id", "serial", "url", "body", "digest", "refers_to").mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def inflated(data: bytes, step: int = 1 << 20):
    """Decompressed pieces of one or more gzip members, or the data itself."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member = zlib.decompressobj(31)
        for i in range(0, len(data), step):
            yield member.decompress(data[i : i + step])
            if member.eof:
                data = member.unused_data + data[i + step :]
                break
        else:
            yield member.flush()
            return


def parse(data: bytes):
    """(header fields in lower case, block) of each record of an archive file."""
    held, source = bytearray(), inflated(data)
    at = 0

    def more() -> bool:
        nonlocal held, at
        piece = next(source, None)
        if piece is None:
            return False
        held = held[at:] + piece
        at = 0
        return True

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                return
        lines = bytes(held[at:end]).decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        at = end + 4
        while len(held) - at < size + 4:
            if not more():
                break
        yield fields, bytes(held[at : at + size])
        at = min(len(held), at + size + 4)


def _body(block: bytes | None) -> bytes | None:
    if block is None:
        return None
    head, _, rest = block.partition(b"\r\n\r\n")
    try:
        return dechunked(rest) if b"transfer-encoding: chunked" in head.lower() else rest
    except ValueError:
        return None


def read_archives(spark, path: str) -> DataFrame:
    """page_id, record_type, refers_to, digest (as recorded) and payload, null for revisits and damaged records."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for f, block in parse(content.as_py()):
                    origin, kind = f.get("warc-segment-origin-id", f["warc-record-id"]), f["warc-type"]
                    page = origin.removeprefix("<urn:x-page:").split(":")[0]
                    refers = f.get("warc-refers-to", "").removeprefix("<urn:x-page:").rstrip(">") or None
                    segment, total = (int(f[k]) if k in f else None for k in ("warc-segment-number", "warc-segment-total-length"))
                    whole = segment is None and kind == "response"
                    rows.append((origin, kind, page, refers, f.get("warc-payload-digest", "").removeprefix("sha256:") or None, segment, total, _body(block) if whole else block))
                    held += len(block)
                    if held > 8 << 20:
                        yield _read(rows)
                        rows, held = [], 0
                if rows:
                    yield _read(rows)

    def join(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["segment"])
        block = b"".join(r["block"] for r in rows)
        sound = [r["segment"] for r in rows] == list(range(1, len(rows) + 1)) and rows[-1]["total"] == len(block)
        body = _body(block) if sound else None
        top = rows[0] | {"record_type": "damaged" if body is None else "response", "block": body, "total": len(block), "segment": None}
        return pa.Table.from_pylist([top], schema=t.schema)

    parsed = files.mapInArrow(run, READ)
    whole = parsed.where("segment is null")
    joined = parsed.where("segment is not null").groupBy("record_id").applyInArrow(join, READ)
    both = whole.unionByName(joined)
    kind = F.when((F.col("record_type") == "response") & F.col("block").isNull(), "damaged").otherwise(F.col("record_type"))
    return both.select(F.expr("try_cast(page_id AS BIGINT)").alias("page_id"), kind.alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"), "digest", F.when(kind == "response", F.col("block")).alias("payload"))


def _read(rows) -> pa.RecordBatch:
    c = list(zip(*rows))
    text, whole = pa.string(), pa.int64()
    return pa.record_batch([pa.array(x, k) for x, k in zip(c, (text, text, text, text, text, whole, whole, pa.binary()))], ["record_id", "record_type", "page_id", "refers_to", "digest", "segment", "total", "block"])


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit takes its length from its response."""
    own = records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.coalesce(F.sha2("payload", 256), "digest").alias("payload_digest"), "record_type", "refers_to")
    own = cut(own, "records")  # archives are parsed once
    key = ["refers_to", "payload_digest"]
    known = own.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    seen = own.where("record_type = 'revisit'").drop("payload_bytes")
    named = seen.groupBy(*key).agg(F.count("*").alias("n")).join(known, key)
    found = look_up(seen, cut(named, "named"), key)
    return own.where("record_type <> 'revisit'").unionByName(found.select(*own.columns))


def op5_warc(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolved(read_archives(spark, path))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {SMALLEST_REVISIT} AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {SMALLEST_REVISIT} AND page_id <> low THEN low END AS refers_to
FROM m
"""
