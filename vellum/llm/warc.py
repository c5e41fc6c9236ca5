"""Legacy ARC archives to WARC: parsing by version and declared length, conversion, writing, revisits, reading back.

ARC version 1 record lines have five fields (url, address, date, type, length); version 2 has ten (url, address, date,
type, result code, checksum, location, offset, file name, length). The body is exactly as long as declared.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

VERSION_FIELDS = {1: ("url", "address", "date", "type", "length"), 2: ("url", "address", "date", "type", "code", "checksum", "location", "offset", "file", "length")}
END = b"\r\n\r\n"
CRLF = "\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_record(version: int, url: str, date: str, kind: str, body: bytes, address: str = "0.0.0.0") -> bytes:
    values = {"url": url, "address": address, "date": date, "type": kind, "code": "200", "checksum": "-", "location": "-", "offset": "0", "file": "-", "length": str(len(body))}
    return " ".join(values[f] for f in VERSION_FIELDS[version]).encode("utf-8", "replace") + b"\n" + body + b"\n"


def parse_arc(data: bytes, version: int | None = None) -> Iterator[dict]:
    """The records of an ARC file or of one bare record; the version comes from the file's own first record if it has one.

    A url with blanks is read by counting the other fields from the right. A record whose declared length is not a
    number or passes the end of the data ends the parse with a row that carries ``error``.
    """
    at = 0
    while at < len(data):
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r").split(" ")
        kind = version
        if line[0].startswith("filedesc:"):
            kind = 1
        elif kind is None:
            kind = 2 if len(line) >= 10 else 1
        fields = VERSION_FIELDS[kind]
        extra = len(line) - len(fields)
        if extra < 0 or not line[-1].isdigit() or stop + 1 + int(line[-1]) > len(data):
            yield {"url": line[0], "error": f"bad record line at byte {at}"}
            return
        row = dict(zip(fields, [" ".join(line[: extra + 1]), *line[extra + 1 :]], strict=True))
        body = data[stop + 1 : stop + 1 + int(row["length"])]
        at = stop + 1 + len(body)
        if row["url"].startswith("filedesc:"):
            version = int(body[:1]) if body[:1] in (b"1", b"2") else 1
            continue
        yield row | {"body": body, "error": None}


def warc_date(date: str) -> str:
    """An ARC date (up to 14 digits) as a WARC date; missing parts take their least value, an unusable date the epoch."""
    d = date + "00000101000000"[len(date) :] if date.isdigit() and 4 <= len(date) <= 14 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(key: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}"


def warc_record(row_id: int | None, arc: dict, refers_to: int | None) -> bytes:
    """A response record with the body, or a revisit without one that names the record it repeats. Without a row id its name comes from its content."""
    body = arc["body"]
    content = b"" if refers_to is not None else body
    named = str(row_id) if row_id is not None else f"{arc['url']} {digest(body)}"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <{record_id(named)}>", f"WARC-Date: {warc_date(arc['date'])}",
        f"WARC-Target-URI: {arc['url']}", f"WARC-IP-Address: {arc['address']}", f"WARC-Payload-Digest: sha1:{digest(body)}", f"X-Payload-Length: {len(body)}", f"Content-Type: {arc['type']}",
    ]
    if row_id is not None:
        head += [f"X-Row-Id: {row_id}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{record_id(str(refers_to))}>", f"X-Refers-To-Row-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return CRLF.join([*head, f"Content-Length: {len(content)}", "", ""]).encode("utf-8", "replace") + content


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of a WARC file by their declared lengths: ``headers`` with lower-case names, and ``body``."""
    at = 0
    while at < len(data):
        stop = data.find(END, at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:stop].decode("utf-8", "replace").split(CRLF)[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(headers["content-length"])
        yield {"headers": headers, "body": data[stop + 4 : stop + 4 + n]}
        at = stop + 4 + n
        if data[at : at + 4] != END:
            raise ValueError(f"record at byte {at} is not closed")
        at += 4


def _arc_of(b: pa.RecordBatch, i: int, version: int) -> bytes:
    url = (b.column("url")[i].as_py() or "").replace("\n", "%0A").replace("\r", "%0D") or "unknown:"
    return arc_record(version, url, "20240101000000", "text/html", (b.column("html")[i].as_py() or "").encode("utf-8", "replace"))


def _file_of(records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([END.join(records).decode()], pa.string())], names=["value"])


def archived(pages: DataFrame, least: int = 0, file_bytes: int = 16 << 20) -> DataFrame:
    """Write pages (page_id, url, html) through ARC records into WARC files, read these back, a row for each record.

    Records whose payloads are equal and of at least ``least`` bytes are revisits of the one with the largest id. A
    null html is an empty payload, a null url becomes ``unknown:``, line ends in a url are escaped. Rows that repeat the
    largest id are responses all of them; of rows that repeat an id each goes by its own payload. A row with a null
    page_id has a record that carries no row id; it revisits the largest id with an equal payload, and without any such id
    it is a response. The files hold records of ``file_bytes`` before compression, or one larger record, so that
    writing and reading back stay bounded.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.sha2(body, 256).alias("sum"))
    hashed = own.where(F.length(F.coalesce(F.col("html"), F.lit("")).cast("binary")) >= least).select("page_id", "sum")
    owner = hashed.groupBy("sum").agg(F.max("page_id").alias("last"), F.min("page_id").alias("low"), F.count_if(F.col("page_id").isNull()).alias("nameless")).where("last <> low or (last is not null and nameless > 0)").select("sum", "last")
    again = hashed.join(owner, "sum").where("page_id is null or page_id <> last").select(F.col("page_id").alias("_id"), F.col("sum").alias("_sum"), "last").distinct()
    wide = own.join(again, own["page_id"].eqNullSafe(again["_id"]) & (own["sum"] == again["_sum"]), "left").select("page_id", "url", "html", "last")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in small_batches(batches, 200):
            ids, last = b.column("page_id").to_pylist(), b.column("last").to_pylist()
            for i in range(b.num_rows):
                version = 1 + (ids[i] or 0) % 2
                record = warc_record(ids[i], next(parse_arc(_arc_of(b, i, version), version)), last[i])
                if held and size + len(record) > file_bytes:
                    yield _file_of(held)
                    held, size = [], 0
                held.append(record)
                size += len(record) + len(END)
        if held:
            yield _file_of(held)

    path = scratch.path("warc")
    # A row is a whole file.
    wide.mapInArrow(convert, "value string").write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            for i in range(b.num_rows):
                rows = []
                for r in parse_warc(zlib.decompress(b.column("content")[i].as_buffer(), 47)):
                    h, response = r["headers"], r["headers"]["warc-type"] == "response"
                    sha = h["warc-payload-digest"].removeprefix("sha1:")
                    if response and digest(r["body"]) != sha:
                        raise ValueError(f"digest of record {h['warc-record-id']}")
                    rows.append((int(h["x-row-id"]) if "x-row-id" in h else None, len(r["body"]) if response else int(h["x-payload-length"]), sha, h["warc-type"], int(h["x-refers-to-row-id"]) if not response else None))
                c = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string()), pa.array(c[4], pa.int64())], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
