"""Legacy archive converter: ARC records to WARC records.

ARC files start with a version block that says how header lines are read: version 1 has
url, address, date, type and length, version 2 also result code, checksum, location,
offset and file name.  A record's body is as long as its header line declares.  Parsing
streams: a task holds one record, whatever the size of the file.

The converter gives each record a WARC identifier (derived from its content, so a
retried task makes the same one), an ISO date, a type and base32 SHA-1 digests.  Of
records with equal payloads that with the largest order value is the response, the
others are revisits that refer to it.

Files are written and read with Spark's text source (gzip, so that a file is one task's
input) and a record separator for line ends, hence in any store that Spark reaches and
with its commit protocol.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoclass.llm.common import batch_of, cut, drop, prepare
from duoclass.session import checkpoint_root

# Field names of ARC header lines by version, and the WARC names (fixed values).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
WARC_END = "\r\n\r\n"
BATCH_BYTES = 8 << 20
BROADCAST_PAYLOADS = 100_000  # repeated payloads (some 300 bytes each) that are broadcast


def base32_sha1(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


# ------------------------------------------------------------------ ARC

def arc_header(version: int, url: str, ip: str, date: str, mime: str, status: str, body: bytes, offset: int,
               name: str) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    mid = [status, base32_sha1(body), "-", str(offset), name] if version == 2 else []
    return " ".join([url, ip or "0.0.0.0", date, mime, *mid, str(len(body))]).encode()


def _arc_rows(versions: tuple[int, ...]):
    """(id, url, date, payload) rows to ARC records; the version block comes first."""
    def run(batches):
        version = versions[TaskContext.get().partitionId() % len(versions)]
        name = f"{uuid.uuid4().hex}.arc"
        block = f"{version} 0 converter\n{ARC_FIELDS[version]}\n".encode()
        head = arc_header(version, f"filedesc://{name}", "0.0.0.0", "20000101000000", "text/plain", "200", block, 0, name)
        out, at = [head + b"\n" + block], 0
        size = at = len(out[0]) + 1
        for rb in batches:
            for key, url, date, payload in zip(*(rb.column(i).to_pylist() for i in range(4))):
                payload = payload or b""
                body = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                        f"X-Row-Id: {'-' if key is None else key}\r\n\r\n").encode() + payload
                rec = arc_header(version, url or "-", "0.0.0.0", date, "text/html", "200", body, at, name) + b"\n" + body
                out.append(rec)
                at += len(rec) + 1
                size += len(rec)
                if size > BATCH_BYTES:
                    yield batch_of(["value"], pa.array(out, pa.binary()))
                    out, size = [], 0
        if out:
            yield batch_of(["value"], pa.array(out, pa.binary()))

    return run


def _write_text(records: DataFrame, path: str, sep: str) -> None:
    """gzip at its fastest level: archives are written once and read once or twice."""
    (records.select(F.col("value").cast("string")).write.option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").option("lineSep", sep).text(path))


def write_arc(rows: DataFrame, path: str, versions: tuple[int, ...] = (1, 2)) -> None:
    """``rows``: id, url, date (14 digits), payload (binary) in this order; a file a task,
    the files in turn of each version."""
    prepare(rows.sparkSession)
    _write_text(rows.mapInArrow(_arc_rows(versions), "value binary"), path, "\n")


def parse_arc_line(line: bytes, version: int | None) -> dict | None:
    """A header line as a dict, or None if it isn't one of that version."""
    p = line.rstrip(b"\r").split(b" ")
    if version is None:
        version = {5: 1, 10: 2}.get(len(p))
    if version is None or len(p) != len(ARC_FIELDS[version].split()) or length_of(p[-1].decode("ascii", "replace")) is None or not re.fullmatch(rb"\d{12,14}", p[2]):
        return None
    names = ARC_FIELDS[version].split()
    return dict(zip(names, (x.decode("utf-8", "replace") for x in p))) | {"length": int(p[-1])}


def arc_records(lines):
    """(header, body, whole?) of the records in an ARC file's lines (without line ends).

    A body shorter than declared (the file ends) is given with whole = False; after a
    length that doesn't end at a line end, reading goes on at the next header line.
    """
    version, head, body, got = None, None, [], 0
    for line in lines:
        if head is None:
            if not line.strip():
                continue
            first = line.startswith(b"filedesc://")
            head = parse_arc_line(line, None if first else version)
            body, got = [], 0
            if head and not head["length"]:
                yield head, b"", True
                head = None
            continue
        body.append(line)
        got += len(line) + 1
        if got <= head["length"]:
            continue
        whole = b"\n".join(body)
        if head["URL"].startswith("filedesc://"):
            version = 2 if whole.startswith(b"2") else 1
        else:
            yield head, whole[:head["length"]], True
        head = None
    if head and not head["URL"].startswith("filedesc://"):
        yield head, b"\n".join(body)[:head["length"]], False


def split_http(body: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, payload) of an HTTP response; all payload if none."""
    if not body.startswith(b"HTTP/"):
        return {}, body
    head, _, payload = body.partition(b"\r\n\r\n")
    fields = {}
    for x in head.split(b"\r\n")[1:]:
        k, _, v = x.decode("utf-8", "replace").partition(":")
        fields[k.strip().lower()] = v.strip()
    return fields, payload


_ID = re.compile(r"-?\d{1,18}")


def row_id_of(text: str | None) -> int | None:
    """A row id from a header field; None where it is no integer."""
    return int(text) if text and _ID.fullmatch(text) else None


def length_of(text: str | None) -> int | None:
    """A declared length; None where it is missing or no number of bytes."""
    return int(text) if text and re.fullmatch(r"[0-9]{1,18}", text) else None


def iso_date(d: str) -> str:
    """An ARC date (12 or 14 digits) in WARC form."""
    d = d.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts) -> str:
    """An identifier that follows from the record (the same for every attempt)."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(chr(0).join(map(str, parts)).encode()).digest()[:16], version=5)}>"


def _files(rb_iter, per_file):
    """Apply ``per_file`` to each file's chunks: rows come in file order, one file after another."""
    def chunks():
        for rb in rb_iter:
            yield from zip(rb.column(0).to_pylist(), rb.column(1).to_pylist())

    it = chunks()
    ahead = next(it, None)
    while ahead is not None:
        name, nxt = ahead[0], ahead

        def one():
            nonlocal nxt
            while nxt is not None and nxt[0] == name:
                yield nxt[1]
                nxt = next(it, None)

        inner = one()
        yield from per_file(inner)
        for _ in inner:
            pass
        ahead = nxt


ARC_OUT = "record string, uri string, ip string, date string, row_id long, digest string, n_payload long, whole boolean, body binary"


def _read_arc(with_body: bool):
    names = [x.split()[0] for x in ARC_OUT.split(", ")]

    def rows(chunks):
        for head, body, whole in arc_records(chunks):
            http, payload = split_http(body)
            key = http.get("x-row-id", "-")
            digest = base32_sha1(payload)
            yield (record_id(head["URL"], head["Archive-date"], key, digest), head["URL"], head["IP-address"],
                   iso_date(head["Archive-date"]), row_id_of(key), digest, len(payload), whole,
                   body if with_body else None)

    def run(batches):
        out, size = [], 0
        for r in _files(batches, rows):
            out.append(r)
            size += 200 + len(r[-1] or b"")
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=names)

    return run


_TYPES = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]


def _lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return (spark.read.option("lineSep", sep).option("recursiveFileLookup", "true").text(path)
            .select("_metadata.file_path", F.col("value").cast("binary")))


def read_arc(spark: SparkSession, path: str, with_body: bool = True) -> DataFrame:
    """Records of the gzip ARC files below ``path``: identifier, header fields, digest, body."""
    prepare(spark)
    return _lines(spark, path, "\n").mapInArrow(_read_arc(with_body), ARC_OUT)


# ------------------------------------------------------------------ WARC

def _warc_rows(batches):
    for rb in batches:
        out, size = [], 0
        for r in rb.to_pylist():
            body = r["body"] or b""
            head = ["WARC/1.0", "WARC-Type: " + ("revisit" if r["to_record"] else "response"),
                    "WARC-Record-ID: " + r["record"], "WARC-Date: " + r["date"], "WARC-Target-URI: " + r["uri"],
                    "WARC-IP-Address: " + r["ip"], "WARC-Payload-Digest: sha1:" + r["digest"]]
            if r["to_record"]:
                body = body[:len(body) - r["n_payload"]]
                head += ["WARC-Profile: " + REVISIT_PROFILE, "WARC-Refers-To: " + r["to_record"],
                         "WARC-Refers-To-Target-URI: " + r["to_uri"], "WARC-Refers-To-Date: " + r["to_date"]]
            if not r["whole"]:
                head.append("WARC-Truncated: unspecified")
            kind = "application/http; msgtype=response" if body.startswith(b"HTTP/") else "application/octet-stream"
            head += ["WARC-Block-Digest: sha1:" + base32_sha1(body), "Content-Type: " + kind, f"Content-Length: {len(body)}"]
            out.append("\r\n".join(head).encode() + WARC_END.encode() + body)
            size += len(out[-1])
            if size > BATCH_BYTES:
                yield batch_of(["value"], pa.array(out, pa.binary()))
                out, size = [], 0
        if out:
            yield batch_of(["value"], pa.array(out, pa.binary()))


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    """Convert all ARC records below ``arc_path`` to WARC files in ``warc_path``.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the
    largest row id (a missing id counts as the smallest) is the response.  Copies of
    that row are responses too.
    """
    pick = (read_arc(spark, arc_path, with_body=False).where(F.col("n_payload") >= min_bytes).groupBy("digest")
            .agg(F.max(F.struct(F.coalesce("row_id", F.lit(-(1 << 63))).alias("k"), "record", "uri", "date")).alias("to"),
                 F.count("*").alias("n")).where("n > 1").select("digest", "to"))
    # only digests that occur again: with few of them the bodies aren't shuffled
    pick = cut(pick, "warc-payloads")
    small = F.broadcast(pick) if pick.count() <= BROADCAST_PAYLOADS else pick
    recs = read_arc(spark, arc_path).join(small, "digest", "left")
    other = F.col("to").isNotNull() & (F.col("n_payload") >= min_bytes) & (F.coalesce("row_id", F.lit(-(1 << 63))) != F.col("to.k"))
    recs = recs.select("record", "uri", "ip", "date", "digest", "n_payload", "whole", "body",
                       *[F.when(other, F.col(f"to.{c}")).alias(f"to_{c}") for c in ("record", "uri", "date")])
    _write_text(recs.mapInArrow(_warc_rows, "value binary"), warc_path, WARC_END)
    drop(pick)


def warc_records(chunks):
    """(header fields, block, whole?) of the records in a WARC file cut at empty lines.

    A record whose length is missing or no number has an empty block and whole = False;
    reading goes on at the next record.
    """
    head, body, got = None, [], 0
    for chunk in chunks:
        if head is None:
            if not chunk.startswith(b"WARC/"):
                continue
            head = {}
            for x in chunk.split(b"\r\n")[1:]:
                k, _, v = x.decode("utf-8", "replace").partition(":")
                head[k.strip().lower()] = v.strip()
            body, got = [], -len(WARC_END)
            continue
        body.append(chunk)
        got += len(WARC_END) + len(chunk)
        n = length_of(head.get("content-length"))
        if n is None:
            yield head, b"", False
            head = None
        elif got >= n:
            yield head, WARC_END.encode().join(body)[:n], got == n
            head = None
    if head:
        yield head, WARC_END.encode().join(body), False


WARC_OUT = ("record string, type string, date string, uri string, digest string, refers_to string, row_id long, "
            "n_payload long, whole boolean, payload binary")
_WARC_TYPES = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]


def _read_warc(batches):
    names = [x.split()[0] for x in WARC_OUT.split(", ")]

    def rows(chunks):
        for h, block, whole in warc_records(chunks):
            http, payload = split_http(block)
            key = http.get("x-row-id", "-")
            kind = h.get("warc-type")
            # a revisit's block has no payload; its HTTP header still says the length
            n = length_of(http.get("content-length")) if kind == "revisit" else len(payload)
            whole = whole and n is not None
            digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
            if kind == "response" and base32_sha1(payload) != digest:
                whole = False
            yield (h.get("warc-record-id"), kind, h.get("warc-date"), h.get("warc-target-uri"), digest, h.get("warc-refers-to"),
                   row_id_of(key), n, whole, payload if kind == "response" else None)

    out, size = [], 0
    for r in _files(batches, rows):
        out.append(r)
        size += 300 + len(r[-1] or b"")
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _WARC_TYPES)], names=names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _WARC_TYPES)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the gzip WARC files below ``path``; ``whole`` is false where a length or
    payload digest doesn't hold."""
    prepare(spark)
    return _lines(spark, path, WARC_END).mapInArrow(_read_warc, WARC_OUT)


def archive_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Write ``pages`` to ARC files (of versions 1 and 2 in turn), convert them, and read
    the WARC files back: (record, type, ..., row_id, n_payload, payload, refers_id).

    A null payload is empty, a null url is ``-``; a null id is written as ``-`` and read
    as null.  Other columns aren't read.  ``refers_id`` is the row id of the response that a
    revisit refers to.
    """
    spark = pages.sparkSession
    base = f"{checkpoint_root(spark)}/llm-archives-{uuid.uuid4().hex}"
    key = F.col(id_col).cast("long")
    # the dates of the crawl aren't in the table: seconds from a fixed start, by id
    date = F.date_format(F.timestamp_seconds(F.lit(946684800) + F.pmod(F.coalesce(key, F.lit(0)), F.lit(1 << 29))), "yyyyMMddHHmmss")
    rows = pages.select(key.alias("id"), F.col(url_col).alias("url"), date.alias("date"), F.col(html_col).cast("binary").alias("payload"))
    write_arc(rows, f"{base}/arc")
    convert(spark, f"{base}/arc", f"{base}/warc")
    back = read_warc(spark, f"{base}/warc")
    to = back.where("type = 'response'").groupBy(F.col("record").alias("refers_to")).agg(F.max("row_id").alias("refers_id"))
    # records that refer to nothing, most of them, get keys of their own that match nothing
    key = F.coalesce("refers_to", F.concat(F.lit("-"), F.col("record")))
    return back.join(to.withColumnRenamed("refers_to", "to_record"), key == F.col("to_record"), "left").select(*back.columns, "refers_id")
