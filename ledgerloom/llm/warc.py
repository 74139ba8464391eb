"""WARC archives and their revisit resolution.

Archives are written by Spark's text writer: a record is its header block and its content block, and the writer's line separator is
the blank line that ends a WARC record. So they go to any file system that Spark can write, through its commit protocol.

Resolution shuffles headers alone, by payload digest; the first response of a digest (smallest page id, then archive and offset;
null ids last) stays a response, the other responses become revisits that refer to it, and revisits that the archives held already refer to it
from then on. Only a response is an original: a revisit whose original is not in these archives stays as it is, digest and fields included, and so do requests, metadata and all other
records. Headers are written afresh (type, digests, lengths, what is referred to); ids, dates and other fields of a record stay, so records that name one another still do.
Blocks are bytes throughout, of any encoding.

Defined results: a null payload is empty; a null url leaves WARC-Target-URI out; a null page_id leaves WARC-Page-ID out and reads back
null; equal rows are records of their own, of which one is the response; no pages make no records; a revisit that says neither its payload's length nor its
digest reads null there. An archive is inflated as a stream: a task holds its compressed bytes and one record. Archives hold about ARCHIVE_BYTES at the mean record's size, and at most ARCHIVE_RECORDS.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, materialize, scratch_path, slices, table

#: Records and, at their mean size, bytes before compression in one archive.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 2000, 128 << 20
#: Revisits up to this number (of some 300 bytes each) are broadcast to the archives, which then stay where they are read; beyond it, archives are joined by shuffle.
BROADCAST_REVISITS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRAWLED = "2024-01-01T00:00:00Z"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string: each 5 hex digits are 4 base32 digits."""
    code = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(code, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = CRAWLED) -> None:
    """A response record for each page (text or bytes). No shuffle: each task writes the pages it reads."""
    mean = pages.agg(F.avg(F.octet_length(html_col))).first()[0]
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    page = pages.select(
        F.col(id_col).cast("string").alias("id"),
        F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("body"),
    ).withColumn("digest", payload_digest(F.col("body")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"))
    key = F.md5(F.concat_ws("|", "id", "url", "digest", F.monotonically_increasing_id().cast("string")))  # equal rows are records of their own
    code = F.concat_ws("-", *[F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), code, F.lit(f">\r\nWARC-Date: {date}\r\n"),
        field("WARC-Target-URI", F.col("url")), field("WARC-Page-ID", F.col("id")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length("http") + F.octet_length("body")).cast("string"),
        F.lit("\r\n\r\n"), F.col("http"), F.col("body"),
    )
    _write(page.withColumn("http", http).select(record.alias("value")), path, mean)


def _write(records: DataFrame, path: str, mean: float | None) -> None:
    many = max(1, min(ARCHIVE_RECORDS, int(ARCHIVE_BYTES / max(1.0, mean or 1.0))))
    (records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .option("maxRecordsPerFile", many).text(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select(F.col("path").alias("archive"), "content")


@dataclass
class Record:
    """A record: where it begins, its version line, its fields in their order, its block."""

    offset: int
    version: str
    fields: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        """The first field of a name, whatever its case."""
        return next((v for k, v in self.fields if k.lower() == name), None)

    @property
    def kind(self) -> str:
        return (self.get("warc-type") or "").lower()

    def http(self) -> tuple[bytes, bytes]:
        """HTTP header and payload; no header where the block is not an HTTP message."""
        if (self.get("content-type") or "").lower().startswith("application/http"):
            head, _, payload = self.block.partition(b"\r\n\r\n")
            return head, payload
        return b"", self.block


def records(archive: bytes, chunk: int = 1 << 20) -> Iterator[Record]:
    """The records of a gzip archive in one or many members, inflated as they are read."""
    held, offset, rest, member = bytearray(), 0, archive, zlib.decompressobj(31)

    def more() -> bool:
        nonlocal rest, member
        if member.eof:
            if not member.unused_data:
                return False
            rest, member = member.unused_data, zlib.decompressobj(31)
        if rest:
            held.extend(member.decompress(rest, chunk))
            rest = member.unconsumed_tail
            return True
        tail = member.flush()
        held.extend(tail)
        return bool(tail)

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if held.strip():
                raise ValueError(f"an unfinished WARC record at byte {offset}")
            return
        head = held[:end].decode("utf-8", "surrogateescape").lstrip("\r\n").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {offset}")
        lines: list[str] = []
        for line in head[1:]:  # a line that begins with white space goes on the one before
            if line[:1] in (" ", "\t") and lines:
                lines[-1] += " " + line.strip()
            else:
                lines.append(line)
        fields = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines)]
        record = Record(offset, head[0], fields, b"")
        stop = end + 4 + int(record.get("content-length") or 0)
        while len(held) < stop + 4 and more():
            pass
        record.block = bytes(held[end + 4 : stop])
        offset += min(stop + 4, len(held))
        del held[: stop + 4]
        yield record


_HEADER = "archive string, offset long, record_id string, record_type string, page_id string, url string, date string, payload_bytes long, payload_digest string, refers_to string"


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record. Size and digest are of the full payload: measured where the record holds it, from the fields of a revisit."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _HEADER.split(", ")]
        for batch in batches:
            for part in slices(batch):
                for archive, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    rows = [(archive, *_header(record)) for record in records(content.as_py())]
                    kinds = [pa.int64() if n in ("offset", "payload_bytes") else pa.string() for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)

    return map_batches(_files(spark, path), parse, _HEADER)


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _said(text: str | None) -> str | None:
    """A field's text as it goes into a table: bytes that are no UTF-8 are replaced there, not in the archives."""
    return None if text is None else text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _header(record: Record) -> tuple:
    http, payload = record.http()
    if record.kind == "revisit":
        told = [record.get("warc-payload-length")] + [line.split(b":", 1)[1].decode("ascii", "replace") for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size = next((int(t) for t in told if t and t.strip().isdigit()), None)
        digest = record.get("warc-payload-digest")
        digest = digest.removeprefix("sha1:") if digest else None
    else:
        size, digest = len(payload), _sha1(payload)
    seen = (record.get(n) for n in ("warc-record-id", "warc-page-id", "warc-target-uri", "warc-date", "warc-refers-to-page-id"))
    record_id, page_id, url, date, refers_to = map(_said, seen)
    return record.offset, record_id, record.kind, page_id, url, date, size, _said(digest), refers_to


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Headers of the responses (of at least min_bytes) that repeat another and of the revisits whose original is here, with original_id, original_record, original_url and original_date.

    Headers are shuffled by digest and reduced before that, so a digest that a third of all records have is one row for each
    task. The table of repeated digests is written, so both sides of the join are shuffled anew and adaptive execution can
    split a digest of many records.
    """
    order = F.struct(F.col("page_id").isNull(), F.col("page_id").cast("long"), "page_id", "archive", "offset", "record_id", "url", "date")
    is_response = F.col("record_type") == "response"
    concerned = headers.where(F.col("record_type").isin("response", "revisit") & F.col("payload_digest").isNotNull())
    first = concerned.groupBy("payload_digest").agg(F.min(F.when(is_response, order)).alias("o"), F.count("*").alias("n")).where("n > 1 AND o IS NOT NULL")
    first = materialize(
        first.select(
            "payload_digest", F.col("o.archive").alias("o_archive"), F.col("o.offset").alias("o_offset"), F.col("o.page_id").alias("original_id"),
            F.col("o.record_id").alias("original_record"), F.col("o.url").alias("original_url"), F.col("o.date").alias("original_date"),
        ),
        "warc-originals",
    )
    return (concerned.where(~is_response | (F.col("payload_bytes") >= min_bytes)).join(first, "payload_digest")
            .where("archive <> o_archive OR offset <> o_offset").drop("o_archive", "o_offset"))


def dedupe_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Read the archives of `source`, and write them to `target` with repeated payloads as revisits."""
    headers = materialize(read_headers(spark, source), "warc-headers")
    found = materialize(resolve_revisits(headers, min_bytes), "warc-revisits")
    few, mean = found.count() <= BROADCAST_REVISITS, headers.agg(F.avg("payload_bytes")).first()[0]
    revisits = found.groupBy("archive").agg(
        F.collect_list(F.struct("offset", "original_id", "original_record", "original_url", "original_date", "payload_digest")).alias("revisits")
    )  # no more than an archive has records

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, found in zip(batch.column("content"), batch.column("revisits"), strict=True):
                of = {x["offset"]: x for x in found.as_py() or ()}
                out, size = [], 0
                for record in records(content.as_py()):
                    out.append(_fresh(record, of.get(record.offset)))
                    size += len(out[-1])
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    joined = _files(spark, source).join(F.broadcast(revisits) if few else revisits, "archive", "left").select("content", "revisits")
    _write(map_batches(joined, rewrite, "value binary").select(F.col("value").cast("string").alias("value")), target, mean)


#: Fields that are written anew.
_OWN = {"warc-type", "warc-payload-digest", "warc-payload-length", "warc-block-digest", "warc-profile", "warc-refers-to", "warc-refers-to-target-uri", "warc-refers-to-date", "warc-refers-to-page-id", "content-length"}


def _fresh(record: Record, original: dict | None) -> bytes:
    """A record under new headers: a response as it is, or a revisit that keeps its HTTP header and drops its payload. All else passes unchanged."""
    if original is None and record.kind != "response":
        fields, block = record.fields, record.block
    else:
        http, payload = record.http()
        block = record.block if original is None or record.kind == "revisit" else http + b"\r\n\r\n"
        _, _, kind, _, _, _, size, digest, _ = _header(record)
        fields = [(k, v) for k, v in record.fields if k.lower() not in _OWN]
        fields.insert(0, ("WARC-Type", "revisit" if original else kind))
        fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
        if record.get("warc-block-digest"):
            fields.append(("WARC-Block-Digest", f"sha1:{_sha1(block)}"))
        if original:
            known = {"WARC-Payload-Length": size, "WARC-Profile": record.get("warc-profile") or PROFILE, "WARC-Refers-To": original["original_record"], "WARC-Refers-To-Target-URI": original["original_url"]}
            known |= {"WARC-Refers-To-Date": original["original_date"], "WARC-Refers-To-Page-ID": original["original_id"]}
            fields += [(k, str(v)) for k, v in known.items() if v is not None]
        fields.append(("Content-Length", str(len(block))))
    head = "\r\n".join([record.version, *(f"{k}: {v}" for k, v in fields)])
    return head.encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, deduplicate the archives, and read them back."""
    raw, deduped = scratch_path(spark, "warc"), scratch_path(spark, "warc-deduped")
    write_archives(table(spark, sf_dir, "pages"), raw)
    dedupe_archives(spark, raw, deduped)
    back = read_headers(spark, deduped)
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = """
WITH page AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT page_id, strlen(body) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INT), 1)), '') AS payload_digest
  FROM page
),
first AS (SELECT payload_digest, min(page_id) AS original FROM coded GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM coded JOIN first USING (payload_digest)
"""
