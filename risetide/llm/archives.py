"""Legacy archive converter: ARC files to WARC files.

ARC files of version 1 (five header fields) and 2 (ten) are read by the version block each begins with,
and each record by the length its header line declares. A converted record gets a WARC identifier made
from its content, its 14-digit date as a timestamp, payload and block digests, and a type: of records
with equal payloads the one with the smallest page id is a response and the others are revisits of it.

Spark reads whole files as binary rows and writes records as text rows, gzip-compressed, with the
formats' own record separators between them. A task streams through its file record by record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risetide.llm.work import delete_path, new_path

#: The header fields that the version blocks announce.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Payloads of this size or more are revisited.
LEAST_REVISITED = 0
DATE = "20240101000000"
_BATCH_BYTES = 4_000_000
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_COMPRESSED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def _safe(url: str | None) -> str:
    """A header line's field: no space or control characters."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "unknown:"


def _http(page_id: int | None, payload_bytes: int) -> str:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n{own}\r\n"


def arc_record(version: int, url: str, page_id: int | None, html: str) -> str:
    body = _http(page_id, len(html.encode("utf-8"))) + html
    length = len(body.encode("utf-8"))
    fields = [_safe(url), "0.0.0.0", DATE, "text/html"]
    fields += [str(length)] if version == 1 else ["200", "-", "-", "0", "pages.arc", str(length)]
    return " ".join(fields) + "\n" + body


def arc_version_block(version: int, name: str) -> str:
    body = f"{version} 0 pages\n{ARC_FIELDS[version]}\n"
    fields = [f"filedesc://{name}", "0.0.0.0", DATE, "text/plain"]
    fields += [str(len(body))] if version == 1 else ["200", "-", "-", "0", name, str(len(body))]
    return " ".join(fields) + "\n" + body


def write_arcs(pages: DataFrame, path: str) -> None:
    """One ARC file for each task, versions 1 and 2 in turn; a null html is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        begun = False
        for batch in batches:
            out = [] if begun else [arc_version_block(version, f"pages-{part:05d}.arc")]
            begun = True
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                out.append(arc_record(version, url, page_id, html))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")) \
        .mapInArrow(run, "value string").write.options(**_COMPRESSED).option("lineSep", "\n").text(path)


def read_arc(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by name, body) of each record but the version block."""
    fields: list[str] = []
    while line := file.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        values = line.decode("utf-8").split(" ")
        if not fields and values[0].startswith("filedesc://"):
            told = file.read(int(values[-1])).decode("utf-8").split("\n")
            version = int(told[0].split(" ")[0])
            fields = told[1].split(" ")
            if ARC_FIELDS.get(version) != told[1]:
                raise ValueError(f"unknown ARC version block: {told[:2]}")
            continue
        if len(values) != len(fields):
            raise ValueError(f"an ARC header line has {len(values)} fields where {len(fields)} are announced")
        header = dict(zip(fields, values))
        size = int(header["Archive-length"])
        body = file.read(size)
        if len(body) != size:
            raise ValueError("an ARC record is shorter than it declares")
        yield header, body


def _split_http(body: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = body.partition(b"\r\n\r\n")
    pairs = (line.partition(": ") for line in head.decode("utf-8").split("\r\n")[1:])
    return {k.lower(): v for k, _, v in pairs}, payload


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _opened(content: bytes) -> io.BufferedIOBase:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content))


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of bounded bytes; size: the column whose text counts."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 200 + (len(row[size]) if row[size] is not None else 0)
        if weight > _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_ARC_COLUMNS = "page_id long, uri string, ip string, stamp string, digest string, size long, record_id string, payload string"
_ARC_SCHEMA = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in ("uri", "ip", "stamp", "digest")), ("size", pa.int64()),
                         ("record_id", pa.string()), ("payload", pa.string())])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def parsed_arcs(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of ARC files, with what WARC asks for: identifier, timestamp, payload digest."""

    def rows(content: bytes) -> Iterator[tuple]:
        for header, body in read_arc(_opened(content)):
            http, payload = _split_http(body)
            digest = sha1_base32(payload)
            page = http.get("x-page-id")
            date = header["Archive-date"]
            stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
            name = f"{header['URL']} {date} {page} {digest}".encode()
            record = f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name).digest()[:16], version=5)}>"
            yield (int(page) if page is not None else None, header["URL"], header["IP-address"], stamp, digest, len(payload),
                   record, payload.decode("utf-8") if payloads else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _batched(rows(content.as_py()), _ARC_SCHEMA, 7)

    return _files(spark, path).mapInArrow(run, _ARC_COLUMNS)


def warc_record(row: dict) -> str:
    """A response, or a revisit without its payload."""
    http = _http(row["page_id"], row["size"])
    lines = []
    if row["revisit"]:
        block = http
        lines = [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {row['first_record']}", f"WARC-Refers-To-Target-URI: {row['first_uri']}",
                 f"WARC-Refers-To-Date: {row['first_stamp']}"]
        if row["first_page"] is not None:
            lines.append(f"X-Refers-To-Page-Id: {row['first_page']}")
    else:
        block = http + row["payload"]
    data = block.encode("utf-8")
    head = [
        "WARC/1.0", f"WARC-Type: {'revisit' if row['revisit'] else 'response'}", f"WARC-Record-ID: {row['record_id']}",
        f"WARC-Date: {row['stamp']}", f"WARC-Target-URI: {row['uri']}", f"WARC-IP-Address: {row['ip']}",
        f"WARC-Payload-Digest: sha1:{row['digest']}", f"WARC-Block-Digest: sha1:{sha1_base32(data)}", *lines,
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(data)}"]
    return "\r\n".join(head) + "\r\n\r\n" + block


def _warcinfo(part: int) -> str:
    body = "software: risetide\r\nformat: WARC File Format 1.0\r\nconversion: from ARC\r\n"
    own = uuid.UUID(bytes=hashlib.sha256(f"warcinfo {part}".encode()).digest()[:16], version=5)
    return "\r\n".join([
        "WARC/1.0", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{own}>",
        f"WARC-Date: {DATE[:4]}-{DATE[4:6]}-{DATE[6:8]}T00:00:00Z", "Content-Type: application/warc-fields",
        f"Content-Length: {len(body)}"]) + "\r\n\r\n" + body


def convert(spark: SparkSession, arcs: str, warcs: str, least: int = LEAST_REVISITED) -> None:
    """Write the WARC files of the ARC files in a folder. Payloads are equal if digest and size are."""
    known = parsed_arcs(spark, arcs, payloads=False)
    firsts = (
        known.where(F.col("size") >= least).groupBy("digest", "size")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "record_id", "uri", "stamp")).alias("first"))
        .select("digest", "size", F.col("first.page_id").alias("first_page"), F.col("first.record_id").alias("first_record"),
                F.col("first.uri").alias("first_uri"), F.col("first.stamp").alias("first_stamp"))
    )
    revisit: Column = F.coalesce(F.col("first_record").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page")), F.lit(False))
    rows = parsed_arcs(spark, arcs).join(firsts, ["digest", "size"], "left").withColumn("revisit", revisit)
    rows = rows.withColumn("payload", F.when(F.col("revisit"), F.lit(None)).otherwise(F.col("payload")))
    order = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        begun = False
        for batch in batches:
            out = [] if begun else [_warcinfo(part)]
            begun = True
            out += [warc_record(dict(zip(order, row))) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    rows.mapInArrow(run, "value string").write.options(**_COMPRESSED).option("lineSep", "\r\n\r\n").text(warcs)


def read_warc(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record."""
    while line := file.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record begins with its version")
        headers = {}
        while line := file.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = file.read(size)
        if len(block) != size:
            raise ValueError("a WARC record is shorter than it declares")
        yield headers, block


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records of WARC files. A
    response's size and digest are those of the payload read; its digest header must say the same."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])

    def rows(content: bytes) -> Iterator[tuple]:
        for headers, block in read_warc(_opened(content)):
            kind = headers["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            http, payload = _split_http(block)
            digest = headers["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response" and sha1_base32(payload) != digest:
                raise ValueError(f"{headers['warc-record-id']}: its payload is not what its digest says")
            size = len(payload) if kind == "response" else int(http["content-length"])
            page, first = http.get("x-page-id"), headers.get("x-refers-to-page-id")
            yield int(page) if page is not None else None, size, digest, kind, int(first) if first is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _batched(rows(content.as_py()), schema, 2)

    return _files(spark, path).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as ARC files, those converted to WARC files, and those read back:
    (page_id, payload_bytes, payload_digest, record_type, refers_to) for every page.

    A null html is an empty payload, and empty payloads are equal like others. Rows with equal payloads
    and the same smallest page_id are all responses. A null page_id is never the smallest unless all
    are null; then all those rows are responses. A url's spaces and control characters are escaped, a
    missing url is "unknown:". Empty table: no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    arcs, warcs = new_path(spark, "arc"), new_path(spark, "warc")
    write_arcs(pages, arcs)
    convert(spark, arcs, warcs)
    delete_path(spark, arcs)
    return read_warcs(spark, warcs)
