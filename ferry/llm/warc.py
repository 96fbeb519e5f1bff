"""Legacy archives to WARC: parse ARC records, synthesise WARC records.

An ARC file starts with a version block, whose second line names the version:
version 1 header lines have 5 fields (URL, address, date, type, length),
version 2 has 10, the length last in both.  Payloads are taken by declared
length only, so anything may stand in them.  The converter gives each record
an identifier (a UUID from URL, date and digest, so a repeated task writes the
same record), the date in WARC form, a type and base32 SHA-1 digests; copies
of a payload become revisits of the record with the largest id.

WARC files are written by Spark's text writer: a record ends in CR LF CR LF,
so the writer's line end is a record's last byte and a part file is a plain
gzipped WARC file.  They are read back with Spark's binary reader and parsed
by length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.llm.shared import fresh_path

#: Bytes of ARC payload that one archive in a task holds before it is converted.
ARCHIVE_BYTES = 4 << 20
#: Records of one WARC file at most.
FILE_RECORDS = 2000

# Header lines of the two ARC versions, and the WARC version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def arc_version_block(version: int, date: str = "19960101000000", name: str = "pages.arc") -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    middle = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, payload: bytes, date: str, kind: str = "text/html", address: str = "0.0.0.0", offset: int = 0, name: str = "pages.arc") -> bytes:
    """One ARC record; blanks and line ends in a URL are escaped."""
    url = "".join(f"%{b:02X}" if b <= 0x20 else chr(b) for b in (url or "-").encode("utf-8")).encode("latin-1")
    middle = b"" if version == 1 else f" 200 {payload_digest(payload)} - {offset} {name}".encode()
    return url + f" {address} {date} {kind}".encode() + middle + f" {len(payload)}\n".encode() + payload + b"\n"


def read_arc(archive: bytes) -> Iterator[dict]:
    """The records of an ARC file; later version blocks may change the version.

    A header line whose number of fields is not its version's, or a length
    beyond the end, is an error, never a skipped record.
    """
    version, at = None, 0
    while at < len(archive):
        if archive[at : at + 1] == b"\n":
            at += 1
            continue
        end = archive.index(b"\n", at)
        fields = archive[at:end].split(b" ")
        size = int(fields[-1])
        body = archive[end + 1 : end + 1 + size]
        if len(body) != size:
            raise ValueError(f"record at byte {at} declares {size} bytes, {len(body)} are left")
        at = end + 1 + size
        if fields[0].startswith(b"filedesc://"):
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        if version is None or len(fields) != len(ARC_FIELDS[version].split(" ")):
            raise ValueError(f"header line at byte {end} has {len(fields)} fields")
        yield {"version": version, "url": fields[0].decode("utf-8"), "address": fields[1].decode(), "date": fields[2].decode(), "type": fields[3].decode(), "payload": body}


def warc_date(date: str) -> str:
    """14 digits (shorter ones are filled up) as the ISO form."""
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(url: str, date: str, digest: str, key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {key}')}>"


def warc_record(record: dict, key: int | None, refers_to: int | None) -> bytes:
    """A WARC record from a parsed ARC record; ``key`` is its page id and
    ``refers_to`` the page id of the response that it revisits."""
    payload, digest, date = record["payload"], payload_digest(record["payload"]), warc_date(record["date"])
    revisit = refers_to is not None
    body = b"" if revisit else payload
    lines = [
        WARC_VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(record['url'], date, digest, key)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {record['url']}",
        f"WARC-IP-Address: {record['address']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(body)}",
        f"Content-Type: {record['type']}",
        f"X-Page-ID: {'' if key is None else key}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if line.rstrip() != WARC_VERSION.encode():
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield headers, block


# ------------------------------------------------------------------ Spark


def legacy_date(key: int | None) -> str:
    """The capture date that the legacy archive of a page gets, from its id."""
    day, second = divmod(abs(key or 0), 86_400)
    return f"{1996 + day // 336 % 20:04d}{1 + day // 28 % 12:02d}{1 + day % 28:02d}{second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d}"


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, url, html, refers_to): a legacy archive per few megabytes,
    parsed again and written as WARC records."""
    for batch in batches:
        ids, urls, pages, refs = (batch.column(k).to_pylist() for k in range(4))
        first = 0
        while first < len(ids):
            version = 1 + (ids[first] or 0) % 2
            archive, last = [arc_version_block(version)], first
            size = 0
            while last < len(ids) and size < ARCHIVE_BYTES:
                raw = (pages[last] or "").encode("utf-8")
                archive.append(arc_record(version, urls[last], raw, legacy_date(ids[last]), offset=size))
                size += len(raw) + 1
                last += 1
            records = [warc_record(r, ids[k], refs[k]) for k, r in zip(range(first, last), read_arc(b"".join(archive)))]
            # The text writer's line end is the last byte of each record.
            yield pa.RecordBatch.from_arrays([pa.array([r[:-1].decode("utf-8") for r in records], pa.string())], names=["value"])
            first = last


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> None:
    """Convert ``pages`` to gzipped WARC files below ``path``.

    Of records with equal payloads of at least ``least`` bytes the one with
    the largest id is a response and the others are revisits; the id's group
    comes from lengths and SHA-1 sums, aggregated before they are shuffled.
    Rows that repeat an id and a payload are all responses if the id is the
    largest; rows without an id are responses, or revisits of the largest id.
    Null pages and URLs are empty.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keyed = rows.select("id", F.octet_length("html").alias("n"), F.sha1(F.encode("html", "UTF-8")).alias("sum")).where(f"n >= {int(least)}")
    groups = keyed.groupBy("n", "sum").agg(F.max("id").alias("head"), F.count("*").alias("copies")).where("copies > 1")
    copies = keyed.join(groups, ["n", "sum"]).where("head is not null and not id <=> head").select("id", F.struct("n", "sum").alias("key"), "head").distinct()
    # An id names one row in general; the payload's length and sum tell rows of one id apart.
    told = rows.join(copies.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "head"))).alias("heads")).withColumnRenamed("id", "of"), F.expr("id <=> of"), "left")
    ref = F.when(F.col("heads").isNotNull(), F.col("heads")[F.struct(F.octet_length("html").alias("n"), F.sha1(F.encode("html", "UTF-8")).alias("sum"))])
    told.select("id", "url", "html", ref.alias("refers_to")).mapInArrow(_converted, "value string").write.option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS
    ).text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            rows = []
            with gzip.GzipFile(fileobj=io.BytesIO(raw.as_py())) as f:
                for h, block in read_warc(f):
                    if payload_digest(block) != h["warc-block-digest"].removeprefix("sha1:"):
                        raise ValueError(f"record {h['warc-record-id']} does not have its digest")
                    rows.append(
                        (
                            int(h["x-page-id"]) if h["x-page-id"] else None,
                            int(h["x-payload-length"]),
                            h["warc-payload-digest"].removeprefix("sha1:"),
                            h["warc-type"],
                            int(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None,
                            h["warc-record-id"],
                            h["warc-date"],
                            h["warc-target-uri"],
                        )
                    )
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


_NAMES = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "record_date", "target_uri"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files below ``path``; block digests are
    checked, and a broken record is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(
        _read, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, record_date string, target_uri string"
    )


def legacy_to_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as WARC files in the shared folder and read them back:
    (id, payload_bytes, payload_digest, record_type, refers_to, record_id,
    record_date, target_uri) per record.  An empty table gives no record."""
    path = fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path, id_col, url_col, html_col)
    return read_warc_files(pages.sparkSession, path).withColumnRenamed("id", id_col)
