"""WARC archives: written by Spark, read back, and assembled into captures.

Every page becomes three records: a request, a response (or a revisit of an equal
payload) and metadata, the first and last concurrent to the second. Records are text
lines to Spark's writer, whose line feed is the last byte of each record, so archives
are ordinary gzipped WARC/1.1 files on any file system that Spark writes to.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, releasing, slices
from millrace.sources.scratch import scratch_path

SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(kind: str, page_id: Column, digest: Column) -> Column:
    name = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in headers:
        lines += [F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n")]
    lines += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r")]
    return F.concat(*lines)


def with_record_types(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Add payload_bytes, payload_digest, record_type and refers_to.

    Among pages with equal payloads of ``min_bytes`` or more the largest page_id is
    the response; a null page_id ranks below all others. Groups are met by digest with
    salt, so a payload that a third of all pages share is spread over tasks.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    digested = pages.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn("payload_digest", F.sha1(payload))
    groups = digested.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("target"), F.count("*").alias("copies"))
    salted = groups.where("copies > 1").drop("copies").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = digested.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    met = dealt.join(salted, ["payload_digest", "payload_bytes", "salt"], "left").drop("salt")
    revisits = F.col("target").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("target")))
    return met.withColumn("record_type", F.when(revisits, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisits, F.col("target"))).drop("target")


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", bundle_bytes: int = 1 << 20, bundles_per_file: int = 64) -> None:
    """Write three records per row of ``pages`` (page_id, url, html).

    Records go to the text writer in bundles of at most ``bundle_bytes``, or of one
    longer record; a file has at most ``bundles_per_file``, so its size is bounded by
    bytes and not by records. Each file is one gzip member.
    """
    typed = with_record_types(pages.select("page_id", "url", "html"))
    uri = F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit(""))
    own = _record_id("capture", F.col("page_id"), F.col("payload_digest"))
    target = _record_id("capture", F.col("refers_to"), F.col("payload_digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    common = [("WARC-Target-URI", uri), ("WARC-Date", date)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))
    response = _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, digest, ("Content-Type", "application/http;msgtype=response")], F.concat(http, F.coalesce("html", F.lit(""))))
    revisit = _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, digest, ("WARC-Refers-To", target), ("WARC-Profile", PROFILE), ("Content-Type", "application/http;msgtype=response")], http)
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _record_id("request", F.col("page_id"), F.col("payload_digest"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")], F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id("metadata", F.col("page_id"), F.col("payload_digest"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")))
    records = typed.select(F.explode(F.array(request, F.when(F.col("record_type") == "revisit", revisit).otherwise(response), metadata)).alias("value"))

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, 0, bundle_bytes):
                for record in part.column(0).to_pylist():
                    if held and size + len(record) >= bundle_bytes:
                        yield pa.record_batch([pa.array(["\n".join(held)])], ["value"])
                        held, size = [], 0
                    held.append(record)
                    size += len(record) + 1
        if held:
            yield pa.record_batch([pa.array(["\n".join(held)])], ["value"])

    records.mapInArrow(releasing(bundled), "value string").write.option("compression", "gzip").option("maxRecordsPerFile", bundles_per_file).text(path)


def inflated(content: bytes, piece: int = 1 << 16) -> Iterator[bytes]:
    """An archive's bytes in pieces, plain or gzipped in one or many members."""
    view, at = memoryview(content), 0
    if content[:2] != b"\x1f\x8b":
        yield from (bytes(view[k : k + piece]) for k in range(0, len(view), piece))
        return
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(view):
                raise ValueError("a gzip member breaks off")
            part = view[at : at + piece]
            yield member.decompress(part)
            at += len(part) - len(member.unused_data)


class _Source:
    """Bytes that come in pieces, taken from the front."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held, self.place, self.taken = parts, b"", 0, 0

    def more(self, n: int = 1) -> bool:
        """Hold n bytes more than now, or all that are left; whether there were any."""
        parts, have = [], 0
        while have < n and (part := next(self.parts, None)) is not None:
            parts.append(part)
            have += len(part)
        self.held, self.place = b"".join([self.held[self.place :], *parts]), 0
        return have > 0

    @property
    def left(self) -> int:
        return len(self.held) - self.place

    def find(self, mark: bytes) -> int:
        """The bytes before the mark, or -1."""
        while (found := self.held.find(mark, self.place)) < 0:
            if not self.more(max(1, self.left)):
                return -1
        return found - self.place

    def take(self, n: int) -> bytes:
        if n > self.left:
            self.more(n - self.left)
        out = self.held[self.place : self.place + n]
        self.place += len(out)
        self.taken += len(out)
        return out


def parse_records(content: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (lower-case names, values in order) and block of each record of an
    archive, plain or gzipped; what is inflated ahead is about one record."""
    source = _Source(inflated(content))
    while source.left or source.more():
        end = source.find(b"\r\n\r\n")
        head = source.take(end + 4)
        if end < 0 or not head.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {source.taken - len(head)}")
        headers: dict[str, list[str]] = {}
        for line in head[:-4].split(b"\r\n")[1:]:
            name, _, value = line.decode().partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        block = source.take(int(headers["content-length"][0]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError(f"a record breaks off before byte {source.taken}")
        yield headers, block


RECORDS = "record_id string, warc_type string, target_uri string, warc_date string, concurrent_to array<string>, refers_to string, payload_bytes long, payload_digest string, fields string"


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``: ``RECORDS`` and, with
    ``payload``, the payload of responses. Payloads are checked against their digests."""
    schema = RECORDS + (", payload binary" if payload else "")
    kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * payload
    names = [f.split()[0] for f in schema.split(", ")]

    def row(headers: dict[str, list[str]], block: bytes) -> tuple:
        first = lambda name: headers.get(name, [None])[0]
        kind, size, digest, fields, body = first("warc-type"), None, None, None, None
        if kind in ("response", "revisit"):
            head, _, body = block.partition(b"\r\n\r\n")
            digest = (first("warc-payload-digest") or "").removeprefix("sha1:") or None
            if kind == "response":
                size, found = len(body), hashlib.sha1(body).hexdigest()
                if digest not in (None, found):
                    raise ValueError(f"{first('warc-record-id')}: its payload has another digest")
                digest = found
            else:
                lengths = [x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                size, body = int(lengths[0]) if lengths else None, None
        elif kind == "metadata":
            fields = block.decode(errors="replace")
        return (first("warc-record-id"), kind, first("warc-target-uri"), first("warc-date"), headers.get("warc-concurrent-to", []), first("warc-refers-to"), size, digest, fields, *([body] if payload else []))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                for headers, block in parse_records(content.as_py()):
                    rows.append(row(headers, block))
                    held += len(block) if payload else 0
                    if len(rows) >= 2000 or held >= 8_000_000:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc,txt}").load(path)
    return files.select("content").mapInArrow(releasing(read), schema)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture (a response or revisit record): its own columns, and the
    request and metadata records concurrent to it nested as structs.

    Concurrent records are reduced to one of each type per capture before the join, so
    every capture stays exactly once, with null where it has no such record. Captures
    that occur twice under one id stay twice.
    """
    beside = records.where(F.col("warc_type").isin("request", "metadata")).select("warc_type", "record_id", "target_uri", "warc_date", "fields", F.explode("concurrent_to").alias("capture_id"))
    nested = {kind: F.max(F.when(F.col("warc_type") == kind, F.struct("record_id", "target_uri", "warc_date", "fields"))).alias(kind) for kind in ("request", "metadata")}
    beside = beside.groupBy("capture_id").agg(nested["request"], nested["metadata"])
    captures = records.where(F.col("warc_type").isin("response", "revisit")).drop("concurrent_to", "fields")
    return captures.join(beside, captures.record_id == beside.capture_id, "left").drop("capture_id")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared scratch folder, read the archives back, and
    return what they say of each page: page_id, payload_bytes, payload_digest,
    record_type and refers_to (a page_id).

    A null html is an empty payload; a null page_id stays null; repeated rows come
    back as often as they went in, all of them responses where no larger page_id has
    their payload; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    page_id = F.expr("try_cast(nullif(trim(regexp_extract(metadata.fields, '(?m)^page-id:([^\\r\\n]*)', 1)), '') AS BIGINT)")
    captures = assemble(read_archives(spark, path, payload=False)).select(page_id.alias("page_id"), "record_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to").alias("target_id"))
    captures = materialize(captures, "warc-captures")
    wanted = captures.where("record_type = 'revisit'").select(F.col("target_id").alias("record_id")).distinct()
    targets = captures.where("record_type = 'response'").join(wanted, "record_id").groupBy(F.col("record_id").alias("target_id")).agg(F.max("page_id").alias("refers_to"))
    salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = captures.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["target_id", "salt"], "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: :func:`archive_round_trip` of ``pages`` in DuckDB SQL.
ORACLE = """
WITH digested AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS target FROM digested
), typed AS (
  SELECT *, payload_bytes >= 1000 AND target IS NOT NULL AND page_id IS DISTINCT FROM target AS again FROM grouped
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN target END AS refers_to
FROM typed"""
