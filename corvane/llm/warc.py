"""WARC archives: writing captures, reading records, joining them to transactions.

A page becomes a request, a response (or, if an earlier page has the same payload, a revisit) and a
metadata record, tied by WARC-Concurrent-To. Records are put together as strings; each is a gzip
member of its own, as the format asks for, and an empty member stands after each. To gzip this member
is no data; to the reader it is the line separator of a text file, so archives of any size are split
over tasks and need no bound on their records or bytes. A separator can't arise within text, and a
record cut at a wrong place fails its checksum. Archives from elsewhere (plain or gzip) without
separators are read as one row a file, at most 2 GB each. Reading parses records by their
Content-Length; assembly groups records by the response they name.

Null html is an empty payload; a null url leaves WARC-Target-URI out, a null page_id its field. Rows
without page_id revisit the page with that payload that has one. Repeated rows are the same record
written again: each comes back as a row of its own, and those of the smallest page_id are all
responses. An empty table gives archives without records and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_task, work_path

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Digits that conv() writes in base 32, and those of RFC 4648.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: A gzip member without data, with a fixed header: what stands after each record's member.
SEPARATOR = bytes.fromhex("1f8b08000000000000ff 0300 00000000 00000000")
TEXT_OPTIONS = {"lineSep": SEPARATOR.decode("latin-1"), "encoding": "ISO-8859-1"}

#: Bytes of records that a batch holds about.
BATCH_BYTES = 8 << 20


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, by five bytes at a time."""
    digest = F.sha1(payload)
    fifths = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*fifths), CONV_DIGITS, BASE32_DIGITS)


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, record_id: Column, headers: list[tuple[str, Column]], body: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), body, F.lit(CRLF * 2))


def _members(batches):
    """Batches of records as batches of gzip members."""

    def made(members):
        return pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["member"])

    members, held = [], 0
    for batch in batches:
        for record in batch.column(0).cast(pa.large_binary()):
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            members.append(pack.compress(record.as_buffer()) + pack.flush())
            held += len(members[-1])
            if held > BATCH_BYTES:
                yield made(members)
                members, held = [], 0
    if members:
        yield made(members)


def write_archives(pages: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", revisit_from: int = 0) -> None:
    """Writes archives of page_id, url, html; payloads of at least revisit_from bytes are stored once."""
    page = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.regexp_replace("url", r"[\r\n]+", " ").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    narrow = page.select("page_id", "url", "digest", F.octet_length("html").alias("bytes")).filter(F.col("bytes") >= revisit_from)
    firsts = (
        narrow.groupBy("digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))).alias("first"), F.count("*").alias("n"))
        .filter((F.col("n") > 1) & F.col("first").isNotNull())
    )
    revisits = narrow.select("page_id", "digest").join(firsts.select("digest", "first"), "digest").filter(~F.col("page_id").eqNullSafe(F.col("first.page_id"))).distinct()
    revisits = revisits.select(F.col("page_id").alias("r_page_id"), F.col("digest").alias("r_digest"), "first")
    both = page.join(revisits, (F.col("digest") == F.col("r_digest")) & F.col("page_id").eqNullSafe(F.col("r_page_id")), "left")

    is_revisit = F.col("first").isNotNull()
    response_id = _urn("response", F.col("page_id"), F.col("url"), F.col("digest"))
    uri = ("WARC-Target-URI", F.col("url"))
    common = [("WARC-Date", F.lit(date)), uri]
    ties = [*common, ("WARC-Concurrent-To", response_id)]
    path_of = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]+://[^/]*(/[^\s]*)", 1), F.lit("")), F.lit("/"))
    host_of = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]+://([^/\s]*)", 1)
    request = _record(
        F.lit("request"), _urn("request", response_id), [*ties, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), path_of, F.lit(f" HTTP/1.1{CRLF}Host: "), host_of, F.lit(CRLF * 2)),
    )
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF * 2))
    response = _record(
        F.when(is_revisit, "revisit").otherwise("response"), response_id,
        [*common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
         ("WARC-Profile", F.when(is_revisit, PROFILE)),
         ("WARC-Refers-To", F.when(is_revisit, _urn("response", F.col("first.page_id"), F.col("first.url"), F.col("digest")))),
         ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(is_revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    fields = F.concat_ws(
        "",
        F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)),
        F.concat(F.lit("payload-bytes: "), F.octet_length("html").cast("string"), F.lit(CRLF)),
        F.concat(F.lit("refers-to-page: "), F.when(is_revisit, F.col("first.page_id").cast("string")), F.lit(CRLF)),
    )
    metadata = _record(F.lit("metadata"), _urn("metadata", response_id), [*ties, ("Content-Type", F.lit("application/warc-fields"))], fields)
    records = both.select(F.explode(F.array(request, response, metadata)).alias("value"))
    packed = records.mapInArrow(arrow_task(_members), "member binary")
    packed.select(F.col("member").cast("string").alias("value")).write.options(**TEXT_OPTIONS).text(path)


RECORDS = (
    "record_id string, record_type string, date string, target_uri string, concurrent_to string, refers_to string, "
    "header_digest string, content_type string, fields map<string,string>, payload binary, payload_bytes bigint, payload_digest string"
)


def parse_archive(stream: io.BufferedIOBase):
    """(headers with lower-case names, block) of each record of a plain stream of WARC records."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        yield headers, block


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = headers.get("warc-type", "")
    payload, fields = None, None
    if kind in ("response", "request", "revisit"):
        payload = block.partition(b"\r\n\r\n")[2]
    elif headers.get("content-type") == "application/warc-fields":
        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k]
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else None
    return (
        headers.get("warc-record-id"), kind, headers.get("warc-date"), headers.get("warc-target-uri"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
        headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, headers.get("content-type"), fields,
        payload if with_payload else None, None if payload is None else len(payload), digest,
    )


def _opened(content: pa.Buffer) -> io.BufferedIOBase:
    """The plain bytes of one record's member, or of a whole archive, plain or gzip."""
    if content[:2].to_pybytes() != b"\x1f\x8b":
        return io.BytesIO(content)
    unpack = zlib.decompressobj(31)
    plain = unpack.decompress(content, BATCH_BYTES)
    if unpack.eof and not unpack.unused_data:
        return io.BytesIO(plain)
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))


def read_records(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives (plain or gzip) under path."""
    parts = spark.read.options(**TEXT_OPTIONS).option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").text(path)
    schema = T.StructType.fromDDL(RECORDS)
    arrow = to_arrow_schema(schema)

    def run(batches):
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        rows, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                if content.as_buffer().size == 0:
                    continue
                for headers, block in parse_archive(_opened(content.as_buffer())):
                    rows.append(_row(headers, block, with_payload))
                    held += len(block) if with_payload else 200
                    if held > BATCH_BYTES or len(rows) >= 4000:
                        yield made(rows)
                        rows, held = [], 0
        if rows:
            yield made(rows)

    return parts.select(F.col("value").cast("binary")).mapInArrow(arrow_task(run), schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata.

    A request or metadata record whose response is absent gives a row with a null response;
    a record that was written k times gives k equal rows.
    """
    kind = F.col("record_type")
    answer = kind.isin("response", "revisit")
    core = ["record_id", "record_type", "date", "target_uri", "concurrent_to", "refers_to", "header_digest", "content_type", "fields", "payload", "payload_bytes", "payload_digest"]
    whole = F.struct(*core)
    grouped = records.groupBy(F.when(answer, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")).alias("capture_id")).agg(
        F.first(F.when(answer, whole), ignorenulls=True).alias("response"),
        F.first(F.when(kind == "request", whole), ignorenulls=True).alias("request"),
        F.first(F.when(kind == "metadata", whole), ignorenulls=True).alias("metadata"),
        F.count_if(answer).alias("copies"),
    )
    return grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)).cast("int")))).drop("copies", "copy")


def page_report(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of captures that write_archives wrote."""
    field = lambda name: F.try_element_at("metadata.fields", F.lit(name)).cast("bigint")
    stored = F.col("response.record_type") == "response"
    return captures.select(
        field("page-id").alias("page_id"),
        F.when(stored, F.col("response.payload_bytes")).otherwise(field("payload-bytes")).alias("payload_bytes"),
        F.when(stored, F.col("response.payload_digest")).otherwise(F.col("response.header_digest")).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        field("refers-to-page").alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of the pages to the shared folder, reads them back and reports on each page."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write_archives(pages, path)
    return page_report(assemble(read_records(spark, path, with_payload=False)))
