"""WARC derivatives against a plain re-reading of the records: links, headers, codings, and what is malformed."""

from __future__ import annotations

import gzip
import json
import re
import zlib
from collections import Counter

from tallyglass.llm import warc

PAGE = "<html><head><title>A &amp; B</title></head><body><a href='/x?a=1&amp;b=2'>link</a><a name=t>no</a><img alt=i src=/i.png><p>Ünï text</p></body></html>"


def message(body: bytes, *headers: str) -> bytes:
    return "\r\n".join(("HTTP/1.1 200 OK", *headers)).encode("latin-1") + b"\r\n\r\n" + body


def response(block: bytes, *more: tuple[str, str], kind: str = "response") -> bytes:
    return warc.record([("WARC-Type", kind), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", "http://e.org/"), *more], block)


def derived(spark, *raw):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "page_id long, record binary")
    return warc.derivatives(rows).orderBy("page_id", "record_type").collect()


def text_of(rows):
    return [next(warc.parse(bytes(r["record"])))[1].decode() for r in rows if r["record_type"] == "conversion"]


def test_codings_and_charsets(spark):
    plain = PAGE.encode()
    chunked = b"".join(b"%x;q=1\r\n%s\r\n" % (len(plain[i : i + 50]), plain[i : i + 50]) for i in range(0, len(plain), 50)) + b"0\r\n\r\n"
    blocks = [
        message(plain, "Content-Type: text/html; charset=utf-8"), message(gzip.compress(plain), "Content-Encoding: gzip", "Content-Type:text/html"),
        message(chunked, "Transfer-Encoding:chunked"), message(zlib.compress(plain), "content-encoding: deflate"),
        message(PAGE.encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1"), message(PAGE.replace("<title>", '<meta charset="utf-16-le"><title>').encode("utf-16")),
        message(PAGE.replace("<head>", '<head><meta charset="cp1252">').encode("cp1252")), message(b"\xef\xbb\xbf" + plain, "Content-Type: text/html; charset=nonsense"),
    ]
    rows = derived(spark, *map(response, blocks))
    assert text_of(rows) == ["linkno\nÜnï text"] * len(blocks) and not any(r["problem"] for r in rows)
    broken = derived(spark, response(message(b"\x1f\x8bnot it", "Content-Encoding: gzip")), response(message(b"x", "Content-Encoding: br")))
    assert all(r["problem"].startswith("content coding") for r in broken) and len(broken) == 4


def test_headers_and_links_are_preserved(spark):
    http = ["Set-Cookie: a=1", "Set-Cookie:b=2", "Link: <x>; rel=y", "X-Long: one", "\ttwo", "Odd: \xe9"]
    rows = derived(spark, response(message(PAGE.encode(), *http), ("WARC-Concurrent-To", "<urn:uuid:2>"), ("WARC-Concurrent-To", "<urn:uuid:3>")))
    facts = json.loads(next(warc.parse(bytes(next(r for r in rows if r["record_type"] == "metadata")["record"])))[1])["Envelope"]
    assert [v for k, v in facts["WARC-Header-Metadata"] if k == "WARC-Concurrent-To"] == ["<urn:uuid:2>", "<urn:uuid:3>"]
    found = facts["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert found["Headers"] == [["Set-Cookie", "a=1"], ["Set-Cookie", "b=2"], ["Link", "<x>; rel=y"], ["X-Long", "one two"], ["Odd", "é"]]
    assert found["HTML-Metadata"] == {"Title": "A & B", "Links": [{"path": "A@/href", "url": "/x?a=1&b=2"}, {"path": "IMG@/src", "url": "/i.png"}]}
    assert {r["refers_to"] for r in rows} == {"<urn:uuid:1>"} and {r["n_links"] for r in rows} == {2}


def test_digests(spark):
    payload = PAGE.encode()
    sha = warc.digest(payload)
    for declared, ok in ((sha, True), (sha.lower(), True), ("sha256:00", False), ("crc:1", None), ("sha1:" + __import__("hashlib").sha1(payload).hexdigest(), True)):
        assert {r["source_digest_ok"] for r in derived(spark, response(message(payload), ("WARC-Payload-Digest", declared)))} == {ok}


def test_malformed_records_are_quarantined(spark, tmp_path):
    good = response(message(PAGE.encode()))
    no_size = re.sub(rb"Content-Length: \d+\r\n", b"", good, count=1)
    cut, endless = good[:-60], b"WARC/1.0\r\nWARC-Type: response"
    latin = response(message(PAGE.encode()), ("X-Name", "caf")).replace(b"X-Name: caf", b"X-Name: caf\xe9")
    rows = derived(spark, None, b"", b"junk", good + no_size + good, good + cut, endless, latin, response(b"{}", kind="metadata"), response(b""))
    kinds = {i: Counter(r["record_type"] for r in rows if r["page_id"] == i) for i in range(9)}
    both = {"metadata": 1, "conversion": 1}
    assert kinds[0] == kinds[1] == kinds[7] == {} and kinds[2] == kinds[5] == {"quarantine": 1} and kinds[6] == kinds[8] == both
    assert kinds[3] == {"metadata": 2, "conversion": 2, "quarantine": 1} and kinds[4] == {**both, "quarantine": 1}
    assert {r["problem"] for r in rows if r["problem"]} == {"no record begins here", "no valid Content-Length", "cut short", "headers without an end"}
    # files: plain, compressed by members, and with a member that breaks off
    (tmp_path / "a.warc").write_bytes(good + b"\r\n" + no_size + good)
    (tmp_path / "b.warc.gz").write_bytes(warc.member(good) + warc.member(good))
    (tmp_path / "c.warc.gz").write_bytes(warc.member(good) + warc.member(good)[:-40])
    for stream in (True, False):
        found = warc.read_records(spark, str(tmp_path), stream).collect()
        by = {n: [(bytes(r["record"]) == good, r["problem"] is None) for r in found if f"/{n}." in r["file"]] for n in "abc"}
        assert by["a"] == [(True, True), (False, False), (True, True)] and by["b"] == [(True, True)] * 2 and by["c"][0] == (True, True) and by["c"][-1] == (False, False)


def test_chunks_meet_anywhere():
    raw = b"".join(response(message(f"<p>{i}</p>".encode() * i)) for i in range(5))
    for data in (raw, b"".join(warc.member(response(message(f"<p>{i}</p>".encode() * i))) for i in range(5))):
        for size in (1, 7, 1000):
            got = list(warc.parse(data[i : i + size] for i in range(0, len(data), size)))
            assert [(dict(h), b, p) for h, b, p in got] == [(dict(h), b, p) for h, b, p in warc.parse(raw)] and len(got) == 5 and not any(p for *_, p in got)


def test_ids_follow_content_and_rows_stay(spark):
    rows = [(1, "http://e.org/a b\r\nX: y", "<p>one</p>", "x"), (1, "http://e.org/a b\r\nX: y", "<p>two</p>", "x"), (None, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "u", "<p>" + "long " * 300_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string")
    made = warc.responses(pages)
    out = warc.derivatives(made).collect()
    assert len(out) == 2 * len(rows) and all(r["source_digest_ok"] and not r["problem"] for r in out)
    ids = Counter(r["refers_to"] for r in out)
    assert len(ids) == 5 and max(ids.values()) == 4
    assert {r["target_uri"] for r in out} == {"http://e.org/a%20b%0D%0AX:%20y", "", "u"}
    assert max(r["content_length"] for r in out if r["record_type"] == "conversion") == 5 * 300_000 - 1
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
