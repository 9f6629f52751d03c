"""WARC archives: written from pages, read back with segments reassembled.

A page is a response record with an HTTP head and its payload, or a revisit record (identical payload
digest) that names the page it repeats. Payloads beyond ``segment`` bytes are cut: the first part is in the
response record (WARC-Segment-Number 1), the others in continuation records that name the first one as
WARC-Segment-Origin-ID, the last of them with WARC-Segment-Total-Length. The bodies of cut responses are in
chunked transfer framing, so that neither parts nor their borders follow the payload's.

Reading groups records by their origin identifier, orders them by segment number, verifies numbering and
total length, decodes the framing and verifies the payload digest. A group is one payload.

Records reach files through Spark's text writer, which ends each value with the record's last line feed:
the commit protocol, retries and any store come with it. Files are gzipped and bounded by ``per_file`` records
of ``segment`` bytes.

Nulls and edge cases: a null html is an empty payload, a null url an empty target; a null page_id is no
reference: such pages are responses unless a page with an id has the same payload; rows that share page_id
and payload are alike (all responses if the id is the largest); an empty table gives no records; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from base64 import b32encode
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.lineage import cut, discard, scratch

LEAST_REVISIT = 1000
SEGMENT, CHUNK, PER_FILE = 64 << 10, 8 << 10, 1024
#: Groups of equal payloads, 28 bytes each, that are sent to all tasks at most.
MOST_BROADCAST = 500_000
#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:end].split(b"\r\n")
        if first != VERSION:
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
        size = int(headers["content-length"])
        block = content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        if len(block) != size or content[at - 4 : at] != b"\r\n\r\n":
            raise ValueError(f"record cut short at byte {at}")
        yield headers, block


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        piece = body[line + 2 : line + 2 + size]
        if len(piece) != size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(piece)
        at = line + 4 + size


def digest_name(sha1: bytes) -> str:
    return "sha1:" + b32encode(sha1).decode()


def page_records(page_id: int | None, url: str, payload: bytes, refers_to: int | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page."""
    sha1 = hashlib.sha1(payload).digest()
    name = f"<urn:page:{'' if page_id is None else page_id}#{uuid.uuid4().hex}>"
    # a target is a line: what would end it is written in percent
    target = "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url)
    common = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest_name(sha1))]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        return [record([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], head + b"Content-Length: %d\r\n\r\n" % len(payload))]
    kind = [("WARC-Type", "response"), *common, ("Content-Type", "application/http; msgtype=response")]
    if len(payload) <= segment:
        return [record(kind, head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload)]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    out = [record([*kind, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(n)), *total], part))
    return out


def reassembled(segments: list[tuple[int, bytes, int | None]]) -> bytes:
    """One block from its segments (number, bytes, total length on the last)."""
    segments = sorted(segments, key=lambda s: s[0])
    block = b"".join(s[1] for s in segments)
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)) or segments[-1][2] != len(block):
        raise ValueError("segments are missing or of another length than stated")
    return block


def payload_of(block: bytes) -> tuple[bytes, int | None]:
    """The payload of an HTTP block, and the length that its head states."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding") == b"chunked":
        return dechunked(body), None
    return body, int(fields[b"content-length"])


def planned(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, refers_to: the page whose payload a page repeats, null for responses.

    Of pages with equal payloads of ``least`` bytes or more the largest page_id is the response. The groups are
    reduced to (digest, largest id) before their shuffle, and those of two or more pages are sent to all tasks if
    they are MOST_BROADCAST at most, so that no payload is shuffled. Beyond that pages that may repeat others meet
    them in a shuffle, and smaller ones pass it by.
    """
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    large = own.where(F.length("payload") >= least).withColumn("digest", F.unhex(F.sha1("payload")))
    groups = cut(large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null").select("digest", "response"))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("response")), F.col("response")).alias("refers_to")
    if groups.count() <= MOST_BROADCAST:
        named = own.withColumn("digest", F.when(F.length("payload") >= least, F.unhex(F.sha1("payload"))))
        return named.join(F.broadcast(groups), "digest", "left").select("page_id", "url", "payload", refers)
    small = own.where(F.length("payload") < least).select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    return large.join(groups, "digest", "left").select("page_id", "url", "payload", refers).unionByName(small)


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT, segment: int = SEGMENT, per_file: int = PER_FILE) -> None:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for k in range(batch.num_rows):
                page_id, url, payload, refers_to = (batch.column(c)[k].as_py() for c in range(4))
                for one in page_records(page_id, url, payload, refers_to, segment):
                    held.append(one[:-1])  # the writer ends it
                    size += len(one)
                if size > 8 << 20 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                    held, size = [], 0

    made = planned(pages, least).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _id(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").rstrip(">").partition("#")[0]
    return int(text) if text else None


def _page(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a whole record."""
    payload, stated = payload_of(block)
    named = headers["warc-payload-digest"]
    if headers["warc-type"] == "revisit":
        from base64 import b32decode

        return _id(headers["warc-record-id"]), stated, b32decode(named.removeprefix("sha1:")).hex(), "revisit", _id(headers["warc-refers-to"])
    sha1 = hashlib.sha1(payload)
    if digest_name(sha1.digest()) != named or stated not in (None, len(payload)):
        raise ValueError(f"payload of {headers['warc-record-id']} is not the one that its record names")
    return _id(headers["warc-record-id"]), len(payload), sha1.hexdigest(), "response", None


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page in the archives below ``path``."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for headers, block in records(gzip.decompress(content.as_py())):
                    if "warc-segment-number" in headers:
                        origin = headers.get("warc-segment-origin-id", headers["warc-record-id"])
                        total = headers.get("warc-segment-total-length")
                        rows.append((None, None, headers.get("warc-payload-digest"), headers["warc-type"], None, origin, int(headers["warc-segment-number"]), int(total) if total else None, block))
                    else:
                        rows.append((*_page(headers, block), None, None, None, None))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    # one pass over the archives: whole records are pages, segments wait for the others of their origin
    parsed = cut(files.mapInArrow(parse, _PAGE + ", origin string, number int, total long, block binary"))

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, named, parts in zip(*(batch.column(c).to_pylist() for c in ("origin", "digest", "parts")), strict=True):
                block = reassembled([(p["number"], p["block"], p["total"]) for p in parts])
                rows.append(_page({"warc-type": "response", "warc-record-id": origin, "warc-payload-digest": named}, block))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(k).type) for k, c in enumerate(columns)], names=schema.names[:5])

    segments = parsed.where("origin is not null").groupBy("origin").agg(F.max("payload_digest").alias("digest"), F.collect_list(F.struct("number", "block", "total")).alias("parts"))
    return parsed.where("origin is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(segments.mapInArrow(join, _PAGE))


def round_trip(pages: DataFrame, keep: str | None = None, **options: int) -> DataFrame:
    """Write archives of the pages and read them; without a folder to keep them in they are scratch and go afterwards."""
    spark = pages.sparkSession
    path = keep or scratch(spark, "warc")
    write(pages, path, **options)
    found = cut(read(spark, path))
    if not keep:
        discard(spark, path)
    return found


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS response FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN m.response IS NOT NULL AND d.page_id IS DISTINCT FROM m.response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.response IS NOT NULL AND d.page_id IS DISTINCT FROM m.response THEN m.response END AS refers_to
FROM d LEFT JOIN m ON d.payload_bytes >= 1000 AND d.payload_digest = m.payload_digest
"""
