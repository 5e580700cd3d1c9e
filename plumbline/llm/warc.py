"""Legacy archive converter (operator 2): ARC files in, WARC files out.

An ARC file begins with a version block, "filedesc://" and a line that gives the version and names the fields of its
header lines. Version 1 lines hold URL, IP address, date, content type and length; version 2 lines also hold result code,
checksum, location, offset and file name. The converter reads the fields by the names that the block gives, takes the
declared length of content and goes on after it. What a server answered begins with the lines of its HTTP headers; they
are parted from the payload, which alone is digested and compared. Of each record it makes a WARC record: an identifier from
the digest of its URL, date and payload (so reruns agree), a timestamp from the 14-digit date, a type by scheme and content
(response with application/http where there are HTTP headers, else resource with the archive's own content type), and digests
of payload and block. Equal payloads become revisits of the one whose page comes first, with its identifier, URL and date,
and keep their HTTP headers. IP address, result code, checksum, location and the other fields go into headers of their own;
each version block of a file, if it says something new, into a warcinfo record.

ARC files may be plain or gzip files of any number of members. Only where a version block names this module as the
origin does a URL end in a page number; other records have no page.

Both kinds of files are written by Spark's text writer, one record a row, so that commits survive lost executors; they are
compressed, at most FILE_RECORDS records a file, as a file is read back as a whole.

Defined results: a null html is an empty payload; a null url is written as "dns:null" and read back as null; rows with
equal page_id are records of their own, and where their payloads are equal all but one are revisits of that same id;
a null page_id comes after all others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, delete_path, new_path, stored, table

FILE_RECORDS = 2_000
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
EPOCH_DATE = "19960101000000"
#: HTTP headers of pages, which come without.
ANSWER = "HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ORIGIN = "plumbline"


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    content_type: str
    content: bytes
    offset: int
    #: (field, value) of all further fields that say something.
    more: tuple[tuple[str, str], ...] = ()
    #: The version block's origin.
    origin: str = ""


def arc_version_block(version: int, name: str = "archive") -> bytes:
    body = f"{version} 0 {ORIGIN}\n{' '.join(FIELDS[version])}\n".encode()
    line = {1: f"filedesc://{name} 0.0.0.0 {EPOCH_DATE} text/plain {len(body)}", 2: f"filedesc://{name} 0.0.0.0 {EPOCH_DATE} text/plain 200 - - 0 {name} {len(body)}"}[version]
    return line.encode() + b"\n" + body


def arc_records(data: bytes, blocks: bool = False) -> Iterator[ArcRecord]:
    """The records of an ARC file of either version, by the field names of the version block last seen; the version blocks too if asked for."""
    at, fields, origin = 0, FIELDS[1], ""
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at {at} does not end")
        line = data[at:end].decode("utf-8", "surrogateescape")
        if not line.strip():
            at = end + 1
            continue
        parts = line.split(" ")
        length = int(parts[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) != length:
            raise ValueError(f"record at {at} is cut off: {len(content)} of {length} bytes")
        if line.startswith("filedesc:"):
            version, names = [*content.split(b"\n"), b""][:2]
            fields = tuple(names.decode().split()) if names.strip() else FIELDS[int(version.split()[0])]
            origin = b" ".join(version.split()[2:]).decode("utf-8", "surrogateescape")
            if blocks:
                yield ArcRecord(parts[0], *parts[1:4], content, at, (), origin)
        else:
            if len(parts) > len(fields):  # a content type may hold spaces
                kind = fields.index("Content-type")
                extra = len(parts) - len(fields)
                parts[kind : kind + extra + 1] = [" ".join(parts[kind : kind + extra + 1])]
            got = dict(zip(fields, parts, strict=True))
            more = tuple((k, v) for k, v in got.items() if k not in FIELDS[1] and v not in ("", "-"))
            yield ArcRecord(got["URL"], got["IP-address"], got["Archive-date"], got["Content-type"], content, at, more, origin)
        at = end + 1 + length


def parted(content: bytes) -> tuple[bytes, bytes]:
    """(HTTP headers with their blank line, payload); no headers where the content isn't an answer of a server."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    ends = [i + len(e) for e in (b"\r\n\r\n", b"\n\n") if (i := content.find(e)) >= 0]
    at = min(ends, default=len(content))
    return content[:at], content[at:]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(url: str, date: str, digest: str, number: int | str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {number}')}>"


def warc_date(arc_date: str) -> str:
    d = (arc_date + EPOCH_DATE[len(arc_date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at {at}")
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        length = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 4 + length
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record before {at} has no end")
        at += 4


def _write(df: DataFrame, path: str, separator: str) -> None:
    """df (record binary) as one-member gzip files of whole records."""
    (
        df.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", separator)
        .option("maxRecordsPerFile", FILE_RECORDS)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .text(path)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _unzipped(content: pa.Scalar) -> bytes:
    """A plain file as it is, a gzip file with all its members."""
    data = content.as_buffer()
    if bytes(data[:2]) != b"\x1f\x8b":
        return data.to_pybytes()
    member = zlib.decompressobj(31)
    first = member.decompress(data)
    if not member.eof:
        raise ValueError("gzip file is cut off")
    if not member.unused_data:
        return first
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as members:
        return members.read()


def write_arc(pages: DataFrame, path: str, version: int = 1) -> None:
    """Writes pages (page_id, url, html) as ARC files, as legacy crawls left them; each record's URL line leads to its page by number.

    A record is a row's header line and content; each carries a version block, so every file can be cut and joined.
    """
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    url = F.regexp_replace(F.coalesce("url", F.lit("dns:null")), r"[\s\x00-\x1F]", "%20")
    html = F.coalesce("html", F.lit(""))
    middle = " 0.0.0.0 19960101000000 text/html " if version == 1 else " 0.0.0.0 19960101000000 text/html 200 - - 0 archive "
    size = F.octet_length(html) + len(ANSWER)
    line = F.concat(url, F.lit("#page="), number, F.lit(middle), size.cast("string"), F.lit("\n" + ANSWER), html)
    block = arc_version_block(version).decode()
    _write(pages.select(F.concat(F.lit(block), F.lit("\n"), line).cast("binary").alias("record")), path, "\n")


OWN_PAGE = re.compile(r"#page=(null|-?\d+)\Z")
CONVERTED = "file string, at bigint, page_id bigint, url string, date string, content_type string, payload_bytes bigint, payload_digest string, payload binary, kind string, ip string, more string, head binary"


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files under path: place, page, URL, date, type, digest, payload, kind and further fields.

    kind: "page" for records of this module's own writer, "record" for others, "info" for version blocks.
    """

    def rows(batch: pa.RecordBatch):
        for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
            out, size, told = [], 0, set()
            for r in arc_records(_unzipped(content), blocks=True):
                url, page, kind = r.url, None, "record"
                if r.url.startswith("filedesc:"):
                    if (r.url, r.content) in told:
                        continue
                    told.add((r.url, r.content))
                    kind = "info"
                elif r.origin == ORIGIN and (m := OWN_PAGE.search(r.url)):
                    kind, url = "page", r.url[: m.start()]
                    page, url = None if m[1] == "null" else int(m[1]), None if url == "dns:null" else url
                head, payload = parted(r.content) if kind != "info" else (b"", r.content)
                more = "\r\n".join(f"X-Arc-{k}: {v}" for k, v in r.more)
                out.append((name, r.offset, page, url, r.date, r.content_type, len(payload), payload_digest(payload), payload, kind, r.ip, more, head))
                size += len(r.content)
                if size > 1 << 22:
                    yield _batch(out, CONVERTED)
                    out, size = [], 0
            if out:
                yield _batch(out, CONVERTED)

    return arrow_map(_files(spark, path), rows, CONVERTED)


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _number(file: str, at: int, kind: str, page_id: int | None) -> int | str:
    """What tells records of one URL, date and payload apart."""
    return f"{file} {at}" if kind != "page" else page_id if page_id is not None else -1


def converted(r: dict, payload: pa.Scalar) -> bytes:
    """The WARC record of an ARC record: a response, a resource, a revisit without the payload, or a version block's warcinfo."""
    number = _number(r["file"], r["at"], r["kind"], r["page_id"])
    headers = [("WARC-Record-ID", record_id(r["url"] or "", r["date"], r["payload_digest"], number)), ("WARC-Date", warc_date(r["date"]))]
    if r["kind"] == "info":
        return warc_record("warcinfo", [*headers, ("WARC-Filename", r["url"].removeprefix("filedesc://")), ("Content-Type", r["content_type"])], payload.as_py())
    block = r["head"] if r["again"] else r["head"] + payload.as_py()
    headers += [
        ("WARC-Target-URI", r["url"] if r["url"] is not None else "dns:null"),
        ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block) if r['head'] or r['again'] else r['payload_digest']}"),
        ("Content-Type", "application/http; msgtype=response" if r["head"] else r["content_type"]),
        ("X-Payload-Length", str(r["payload_bytes"])),
    ]
    if r["kind"] == "page":
        headers.append(("X-Page-Id", str(r["page_id"])))
    if r["ip"] not in ("", "-", "0.0.0.0"):
        headers.append(("WARC-IP-Address", r["ip"]))
    headers += [(k, v) for k, _, v in (x.partition(": ") for x in r["more"].split("\r\n")) if k]
    if not r["again"]:
        return warc_record("response" if r["head"] else "resource", headers, block)
    first = _number(r["first_file"], r["first_at"], r["first_kind"], r["refers_to"])
    headers += [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", record_id(r["first_url"] or "", r["first_date"], r["payload_digest"], first)),
        ("WARC-Refers-To-Target-URI", r["first_url"] if r["first_url"] is not None else "dns:null"),
        ("WARC-Refers-To-Date", warc_date(r["first_date"])),
    ]
    if r["kind"] == "page":
        headers.append(("X-Refers-To-Page-Id", str(r["refers_to"])))
    return warc_record("revisit", headers, block)


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Writes the WARC files of all ARC files under arc_path.

    Which record of equal payloads is the response is a pre-aggregated least over digests; only records that revisit
    another carry that over, by their own place, so a payload that a third of all records share makes no hot group.
    """
    index = stored(read_arc(spark, arc_path).filter("kind != 'info'").select("file", "at", "page_id", "payload_digest", "url", "date", "kind"), "arc-index")
    last = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "file", "at", "url", "date", "kind")
    firsts = index.select("payload_digest", last.alias("here")).groupBy("payload_digest").agg(F.min("here").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    revisits = index.select("file", "at", "payload_digest").join(firsts, "payload_digest").filter((F.col("file") != F.col("first.file")) | (F.col("at") != F.col("first.at")))
    revisits = revisits.select("file", "at", F.col("first.page_id").alias("refers_to"), *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("file", "at", "url", "date", "kind")], F.lit(True).alias("again"))
    marked = read_arc(spark, arc_path).join(revisits, ["file", "at"], "left")

    def rows(batch: pa.RecordBatch):
        out, size = [], 0
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != "payload"}
        for i, payload in enumerate(batch.column("payload")):
            out.append(converted({n: c[i] for n, c in columns.items()}, payload))
            size += len(out[-1])
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    _write(arrow_map(marked, rows, "record binary"), warc_path, "\r\n\r\n")


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """What the WARC files say of each record; digests are checked against payloads."""

    def number(text: str | None) -> int | None:
        return None if text in (None, "None") else int(text)

    def rows(batch: pa.RecordBatch):
        for content in batch.column("content"):
            out = []
            for headers, block in warc_records(_unzipped(content)):
                if headers["warc-type"] == "warcinfo":
                    continue
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                kind = headers["warc-type"]
                payload = parted(block)[1] if headers["content-type"].startswith("application/http") else block
                if kind != "revisit" and (payload_digest(payload) != digest or len(payload) != int(headers["x-payload-length"])):
                    raise ValueError(f"{headers['warc-record-id']}: payload and digest differ")
                url = headers["warc-target-uri"]
                out.append((number(headers.get("x-page-id")), None if url == "dns:null" else url, int(headers["x-payload-length"]), digest, kind, number(headers.get("x-refers-to-page-id"))))
            if out:
                yield _batch(out, READ)

    return arrow_map(_files(spark, path), rows, READ)


def archive_pages(pages: DataFrame, version: int = 1) -> DataFrame:
    """Pages to ARC files, those to WARC files, and these read back."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages.select("page_id", "url", "html"), arc, version)
    convert(spark, arc, warc)
    delete_path(spark, arc)
    return read_warc(spark, warc)


def op2_archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
