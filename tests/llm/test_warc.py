from __future__ import annotations

import io

import pytest

from hecespark.llm import warc

PAGES = "page_id bigint, url string, html string"


def records(data: bytes):
    return list(warc.read_records(io.BytesIO(data)))


def rec(body: bytes, **head) -> bytes:
    return warc.record("resource", "http://x/", body, "text/plain", "2024-01-01T00:00:00Z", "urn:x:1", **head)


def test_round_trip_of_bytes_across_chunks():
    bodies = [b"", b"x", bytes(range(256)) * 3000, b"\r\n\r\n" * 10, b"WARC/1.0\r\n\r\n\x1f\x8b\x08"]
    got = records(b"".join(warc.member(rec(b)) for b in bodies))
    assert [r["payload"] for r in got] == bodies
    assert {r["status"] for r in got} == {"ok"}
    assert all(r["position"] < s["position"] for r, s in zip(got, got[1:]))


def test_broken_records_have_a_status_and_reading_goes_on():
    good = warc.member(rec(b"good"))
    wrong = warc.member(rec(b"abcd").replace(b"\r\n\r\nabcd", b"\r\n\r\nabce"))
    short = warc.member(rec(b"abcd" * 9)[:-20])
    plain = warc.member(b"no warc at all\r\n\r\n")
    bare = warc.member(b"WARC/1.0\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")
    no_length = warc.member(b"WARC/1.0\r\nWARC-Type: x\r\n\r\nhi")
    got = records(good + wrong + short + b"junk between" + plain + bare + no_length + good)
    assert [r["status"] for r in got] == ["ok", "digest_mismatch", "truncated", "bad_header", "no_digest", "bad_header", "ok"]


def test_a_damaged_member_does_not_hide_the_next():
    import os

    noise = warc.member(rec(os.urandom(3000)))
    damaged = noise[:400] + bytes(255 - b for b in noise[400:420]) + noise[420:]
    got = records(damaged + warc.member(rec(b"after")))
    assert got[-1]["payload"] == b"after" and got[-1]["status"] == "ok"
    assert got[0]["status"] in ("bad_gzip", "digest_mismatch", "truncated")


def test_cut_file():
    data = warc.member(rec(b"first")) + warc.member(rec(b"second" * 1000))
    got = records(data[:-30])
    assert got[0]["status"] == "ok" and got[1]["status"] in ("truncated", "bad_gzip", "digest_mismatch")
    assert records(b"") == [] and records(b"nothing here") == []


@pytest.mark.parametrize("rows", [[], [(None, None, None)]])
def test_no_pages(spark, tmp_path, rows):
    files = warc.write(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}")
    assert warc.read(spark, files).count() == 0


def test_pages_with_nulls_repeats_long_and_clashing_columns(spark, tmp_path):
    rows = [(1, "http://a/", "<p>ü"), (1, "http://a/", "<p>ü"), (2, None, ""), (None, "http://b/\r\nX: y", "x" * 3_000_000), (3, "http://c/", None)]
    pages = spark.createDataFrame([(*r, "f", "ok") for r in rows], PAGES + ", file string, status string")
    got = warc.read(spark, warc.write(pages, f"file://{tmp_path}")).collect()
    assert sorted(len(r["payload"]) for r in got) == sorted(len(h.encode()) for _, _, h in rows if h is not None)
    assert {r["status"] for r in got} == {"ok"} and {r["http_status"] for r in got} == {200}
    assert sum(r["record_id"] == "urn:hecespark:page:1" for r in got) == 2
    assert [r["target_uri"] for r in got if r["record_id"] == "urn:hecespark:page:2"] == [None]


def test_file_of_another_writer(spark, tmp_path):
    """Records as other crawlers write them: gzip headers with a name and time, other record types, folded headers, lower case, digests of other spellings, chunked bodies as they are."""
    import base64
    import gzip
    import hashlib

    def member(head: str, block: bytes) -> bytes:
        out = io.BytesIO()
        with gzip.GzipFile("crawl.warc", "wb", 9, out, mtime=1) as f:
            f.write(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
        return out.getvalue()

    body = b"5\r\nhello\r\n0\r\n\r\n"
    http = b"HTTP/1.1 404 Not Found\r\nTransfer-Encoding: chunked\r\n\r\n" + body
    sha = base64.b32encode(hashlib.sha1(http).digest()).decode()
    ask = b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"
    data = b"".join((
        member("WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 13", b"software: x\r\n"),
        member(f"WARC/1.1\r\nwarc-type: response\r\nwarc-record-id: <urn:uuid:2>\r\nWARC-Target-URI: http://x/\r\n  folded\r\nWARC-Block-Digest: sha1:{sha.lower()}\r\ncontent-type: application/http; msgtype=response\r\ncontent-length: {len(http)}", http),
        member(f"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:uuid:3>\r\nContent-Type: application/http; msgtype=request\r\nContent-Length: {len(ask)}", ask),
        member("WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:4>\r\nContent-Length: 0", b""),
    ))
    (tmp_path / "crawl.warc.gz").write_bytes(data)
    got = {r["record_id"]: r for r in warc.read(spark, [str(tmp_path / "crawl.warc.gz")]).collect()}
    assert [(r["type"], r["status"], r["http_status"]) for r in got.values()] == [("warcinfo", "no_digest", None), ("response", "ok", 404), ("request", "no_digest", None), ("revisit", "no_digest", None)]
    assert bytes(got["urn:uuid:2"]["payload"]) == body and got["urn:uuid:2"]["target_uri"] == "http://x/ folded" and bytes(got["urn:uuid:1"]["payload"]) == b"software: x\r\n"
