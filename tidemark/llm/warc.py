"""WARC archives: write with revisit records and segments, read back with segment reassembly."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import salted_join, written
from tidemark.session import scratch_path

END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
SEGMENT, CHUNK, PER_FILE = 32 * 1024, 4096, 2048


def decisions(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, html, hex, record_type, refers_to`` per page.

    Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is the response.
    Groups of copies are aggregated before the shuffle; the join back spreads a hot payload over salts.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("hex", F.sha1("html")).withColumn("spread", F.xxhash64("page_id", "url"))
    copies = rows.filter(F.length("html") >= least).groupBy("hex").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
    joined = salted_join(rows, copies.filter("copies > 1").select("hex", "keeper"), "hex", "spread")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select(
        "page_id", "url", "html", "hex", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keeper")).alias("refers_to"))


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}/{digest}'.encode()).digest())}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP/1.1 chunked transfer coding."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decode chunked transfer coding; a broken frame raises."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        start, at = end + 2, end + 2 + n
        if len(body) < at + 2 or body[at:at + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[start:at])
        at += 2


def _record(kind: str, name: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", DATE), *fields, ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head)).encode() + b"\r\n" + block


def records(page_id, url: str, payload: bytes, kind: str, refers_to, segment: int = SEGMENT) -> Iterator[bytes]:
    """The record of one page, without the closing two line ends; a long one in segments."""
    sha = hashlib.sha1(payload).digest()
    digest = base64.b32encode(sha).decode()
    name = record_id(page_id, digest)
    shown = "" if page_id is None else page_id
    fields = [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", shown)]
    if kind == "revisit":
        yield _record(kind, name, [*fields, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                                   ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to),
                                   ("Content-Type", "application/http; msgtype=response")], HTTP + b"\r\n")
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= segment:
        yield _record(kind, name, fields, block)
        return
    pieces = [block[i:i + segment] for i in range(0, len(block), segment)]
    yield _record(kind, name, [*fields, ("WARC-Segment-Number", 1)], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if n == len(pieces) else []
        own = f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{name}/{n}'.encode()).digest())}>"
        yield _record("continuation", own, [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n), *last], piece)


def write(decided: DataFrame, path: str, segment: int = SEGMENT, per_file: int = PER_FILE) -> None:
    """Archives of at most ``per_file`` records, each record of at most about ``segment`` bytes.

    Spark's text writer puts the bytes of each row and the two line ends that close a WARC record, so the archives
    go to whatever file system the folder is on.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for r in records(*row, segment):
                    held.append(r)
                    size += len(r)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.binary())})
                        held, size = [], 0
        yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.binary())})

    rows = decided.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.options(
        lineSep=END.decode(), maxRecordsPerFile=per_file, compression="gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive: header fields and block; a broken record raises."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, at = end + 4, end + 4 + int(head["content-length"])
        if data[at:at + 4] != END:
            raise ValueError("a record is not closed")
        yield head, data[start:at]
        at += 4


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def reassembled(pieces: list[tuple[int, int | None, bytes]]) -> list[bytes]:
    """Blocks from the segments of one origin: in order of their number, the total length verified.

    Repeated pages write a record more than once; then every segment must be there as often, and as many blocks
    come out.
    """
    by: dict[int, list[bytes]] = {}
    for number, _, block in pieces:
        by.setdefault(number, []).append(block)
    totals = {t for _, t, _ in pieces if t is not None}
    times = {len(v) for v in by.values()}
    block = b"".join(by[n][0] for n in sorted(by))
    if sorted(by) != list(range(1, len(by) + 1)) or len(times) != 1 or totals != {len(block)}:
        raise ValueError("segments are missing or the total length differs")
    return [block] * times.pop()


_PARTS = "origin string, number int, total long, kind string, page_id long, refers_to long, refers string, digest string, n long, block binary"
_ARROW = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()),
                    ("refers_to", pa.int64()), ("refers", pa.string()), ("digest", pa.string()), ("n", pa.int64()), ("block", pa.binary())])
_JOINED = pa.schema([("origin", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("n", pa.int64())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Digest rows of every page in the archives: the payload's length and SHA-1 are computed
    from the reassembled payload and held against the digest in the header; a revisit takes its length from the
    response that it names."""
    def number(head, field):
        return int(head[field]) if head.get(field) else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                data, out = data.as_py(), []
                for head, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind, no = head["warc-type"], number(head, "warc-segment-number")
                    digest, n = head.get("warc-payload-digest", "").removeprefix("sha1:"), None
                    if kind == "response" and no is None:
                        n = _verified(payload_of(block), digest)
                    out.append((head.get("warc-segment-origin-id") or head["warc-record-id"], no, number(head, "warc-segment-total-length"), kind,
                                number(head, "x-page-id"), number(head, "x-refers-to-page-id"), head.get("warc-refers-to"), digest, n,
                                None if no is None else block))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW) if out else \
                    pa.RecordBatch.from_pylist([], schema=_ARROW)

    def join_segments(group: pa.Table) -> pa.Table:
        found = group.to_pylist()
        first = next((x for x in found if x["kind"] == "response"), None)
        if first is None:
            raise ValueError("an origin record is missing")
        blocks = reassembled([(x["number"], x["total"], x["block"]) for x in found])
        return pa.Table.from_pylist([
            {"origin": first["origin"], "kind": "response", "page_id": first["page_id"], "digest": first["digest"],
             "n": _verified(payload_of(b), first["digest"])} for b in blocks], schema=_JOINED)

    files = spark.read.format("binaryFile").load(path).select("content")
    parts = written(files.mapInArrow(rows, _PARTS), "warc-parts")
    whole = parts.filter("number IS NULL")
    segmented = parts.filter("number IS NOT NULL").select("origin", "number", "total", "kind", "page_id", "digest", "block")
    joined = segmented.groupBy("origin").applyInArrow(join_segments, "origin string, kind string, page_id long, digest string, n long")
    responses = whole.filter("kind = 'response'").select("origin", "kind", "page_id", "digest", "n").unionByName(joined)
    revisits = whole.filter("kind = 'revisit'").select("origin", "kind", "page_id", "digest", "refers_to", "refers")
    named = revisits.select("refers").distinct()
    sizes = named.join(responses.select(F.col("origin").alias("refers"), "n").dropDuplicates(["refers"]), "refers")
    resolved = salted_join(revisits, sizes, "refers", "origin")
    columns = ["page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type")]
    return responses.select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(resolved.select(*columns, "refers_to"))


def _verified(payload: bytes, digest: str) -> int:
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("payload digest differs")
    return len(payload)


def archive(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """Write all pages as WARC archives below the shared folder, read them back: one row per page.

    NULL html is an empty payload, NULL url an empty target; pages with NULL ids never count as the largest id, and
    a group with no id at all is all response; of repeated ids that are the largest, each row is a response; an empty
    table gives an empty result.  Long payloads go in segments, so no record exceeds the segment size.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    write(decisions(pages, least), path)
    return read(pages.sparkSession, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, upper(sha1(html)) AS h FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM d)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST(((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM g
"""
