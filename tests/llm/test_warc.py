"""Legacy archives: version-specific parsing, lengths, conversion and the round trip."""

import gzip
import hashlib
import os

import duckdb
import pytest

from duoclass.llm import queries as Q
from duoclass.llm import warc as W
from tests.conftest import SF001

SCHEMA = "page_id long, url string, html string, digest string"


def arc(version, *records):
    """Bytes of an ARC file; records are (url, body)."""
    block = f"{version} 0 test\n{W.ARC_FIELDS[version]}\n".encode()
    mid = " 200 - - 0 f.arc" if version == 2 else ""
    out = f"filedesc://f.arc 0.0.0.0 20050102030405 text/plain{mid} {len(block)}\n".encode() + block + b"\n"
    for url, body in records:
        out += f"{url} 1.2.3.4 20050102030405 text/html{mid} {len(body)}\n".encode() + body + b"\n"
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_declared_lengths(version):
    bodies = [b"", b"\n", b"a\nb\n\n", "é\r\n\r\n漢".encode(), b"http://x 1.2.3.4 20050102030405 text/html 3\nabc", b"\xff\x00\n"]
    lines = arc(version, *[(f"http://h/{i}", b) for i, b in enumerate(bodies)]).split(b"\n")
    got = list(W.arc_records(lines[:-1]))
    assert [(h["URL"], b, ok) for h, b, ok in got] == [(f"http://h/{i}", b, True) for i, b in enumerate(bodies)]
    assert all(h["IP-address"] == "1.2.3.4" and ("Checksum" in h) == (version == 2) for h, _, _ in got)


def test_header_lines_are_read_by_version():
    one, two = b"http://a 1.1.1.1 20000101000000 t/h 5", b"http://a 1.1.1.1 20000101000000 t/h 200 - - 0 f 5"
    assert W.parse_arc_line(one, 1)["length"] == 5 and W.parse_arc_line(two, 2)["Result-code"] == "200"
    assert W.parse_arc_line(one, 2) is None and W.parse_arc_line(two, 1) is None
    assert W.parse_arc_line(b"no header line at all", 1) is None


def test_cut_file():
    lines = arc(1, ("http://a", b"x" * 50)).split(b"\n")
    lines[-2] = lines[-2][:20]
    assert [(b, ok) for _, b, ok in W.arc_records(lines[:-1])] == [(b"x" * 20, False)]


def test_reads_on_after_a_wrong_length():
    data = arc(1, ("http://a", b"x" * 30), ("http://b", b"yes"))
    data = data.replace(b"text/html 30", b"text/html 10")
    assert [h["URL"] for h, _, _ in W.arc_records(data.split(b"\n")[:-1])] == ["http://a", "http://b"]


def test_converts_files_of_both_versions(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/arc")
    http = b"HTTP/1.0 200 OK\r\nX-Row-Id: %d\r\nContent-Length: 5\r\n\r\nhello"
    for v in (1, 2):
        with gzip.open(f"{tmpdir_path}/arc/{v}.arc.gz", "wb") as f:
            f.write(arc(v, ("http://a/", http % v), ("http://raw/", b"no http \xff")))
    W.convert(spark, f"{tmpdir_path}/arc", f"{tmpdir_path}/warc")
    rows = W.read_warc(spark, f"{tmpdir_path}/warc").collect()
    assert len(rows) == 4 and all(r["whole"] for r in rows)
    by = {(r["uri"], r["row_id"]): r for r in rows}
    assert by["http://a/", 2]["type"] == "response" and by["http://a/", 1]["type"] == "revisit"
    assert by["http://a/", 1]["refers_to"] == by["http://a/", 2]["record"]
    assert by["http://a/", 2]["date"] == "2005-01-02T03:04:05Z"
    raw = [r for r in rows if r["uri"] == "http://raw/"]
    assert len(raw) == 2 and all(bytes(r["payload"]) == b"no http \xff" for r in raw if r["type"] == "response")


def test_round_trip_of_awkward_pages(spark):
    same = "<p>same</p>\n"
    rows = [
        (1, "http://a/", same, "x"), (2, "http://b/ c\td", same, "x"), (3, None, same, "x"), (4, "", "", "x"), (5, "http://e", None, "x"),
        (6, "http://f", "\r\n\r\n", "x"), (7, "http://g", "WARC/1.0\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n", "x"),
        (8, "http://h", "filedesc://x\n1 0\n\n\n", "x"), (9, "http://i", "é漢😀" * 50_000, "x"), (10, "http://j", "\ufeffbom\x00nul", "x"),
        (11, "http://k", "HTTP/1.1 200 OK\r\n\r\nnested", "x"), (None, "http://l", "only", "x"), (None, "http://m", same, "x"),
        (-3, "http://n", "minus", "x"), (12, "http://o", "line\nline\r\nline", "x")]
    df = spark.createDataFrame(rows + [rows[8]], SCHEMA).repartition(3)
    got = W.archive_pages(df, "page_id", "url", "html").collect()
    assert len(got) == len(rows) + 1 and all(r["whole"] for r in got)
    for r in got:
        html = {k: h for k, _, h, _ in rows}.get(r["row_id"]) or ""
        if r["row_id"] is None:
            html = same if r["type"] == "revisit" else "only"
        b = html.encode()
        assert (r["n_payload"], r["digest"]) == (len(b), W.base32_sha1(b))
        if r["type"] == "response":
            assert bytes(r["payload"]) == b
    kinds = {r["row_id"]: (r["type"], r["refers_id"]) for r in got if r["row_id"] is not None}
    assert kinds[1] == kinds[2] == ("revisit", 3) and kinds[3] == ("response", None)
    assert kinds[4] == ("revisit", 5) and kinds[5] == ("response", None)
    assert sorted((r["type"], r["refers_id"] or 0) for r in got if r["row_id"] is None) == [("response", 0), ("revisit", 3)]


def test_query_matches_payloads(spark):
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in Q.op6_warc(spark, SF001).collect()}
    import base64

    for k, h in duckdb.sql(f"SELECT page_id, html FROM '{SF001}/pages.parquet'").fetchall():
        b = (h or "").encode()
        assert got[k] == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())


def test_empty_table(spark):
    assert W.archive_pages(spark.createDataFrame([], SCHEMA), "page_id", "url", "html").count() == 0


def test_record_ids_are_urns():
    x = W.record_id("http://a", "2005", 1, "D")
    assert x == W.record_id("http://a", "2005", 1, "D") != W.record_id("http://a", "2005", 2, "D")
    assert x.startswith("<urn:uuid:") and x.endswith(">")


def test_malformed_fields_are_not_whole():
    """A foreign archive's bad length or row id doesn't end the job."""
    assert [W.length_of(x) for x in ("12", "abc", "-1", "", None, "1.5")] == [12, None, None, None, None, None]
    assert [W.row_id_of(x) for x in ("-7", "--5", "5x", "", None, "9" * 30)] == [-7, None, None, None, None, None]
    chunks = [b"WARC/1.0\r\nContent-Length: abc", b"lost body", b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4", b"body", b"WARC/1.0\r\nX: y"]
    got = list(W.warc_records(chunks))
    assert [(b, ok) for _, b, ok in got] == [(b"", False), (b"body", True), (b"", False)]
    body = b"HTTP/1.1 200 OK\r\nX-Row-Id: --5\r\nContent-Length: q\r\n\r\npay"
    head = b"WARC/1.0\r\nWARC-Type: revisit\r\nContent-Length: %d" % len(body)
    import pyarrow as pa
    rows = [("f", c) for c in [head, *body.split(b"\r\n\r\n"), b""]]
    rb = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([x for _, x in rows])], names=["f", "v"])
    out = [r for b in W._read_warc([rb]) for r in b.to_pylist()]
    assert len(out) == 1 and out[0]["row_id"] is None and out[0]["n_payload"] is None and out[0]["whole"] is False
