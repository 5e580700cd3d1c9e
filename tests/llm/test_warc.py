import base64
import hashlib

import pytest

from plumbline.llm import warc as W

SCHEMA = "page_id bigint, url string, html string, file string, payload string"


def pages():
    same = "<p>same \r\n\r\n WARC/1.1 é</p>"
    texts = [same, "a", None, "", same, "x" * 200_000, "a", "line\n\nfiledesc://x 1\n", same]
    rows = [(10 - i, None if i == 3 else f"http://h/{i} b\n", t, "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, (None, "http://h/n", "a", "c", "c"), (2, "http://h/again", same, "c", "c")]


def expected(rows):
    out, first = [], {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (r[2] or "").encode()
        kind = "revisit" if data in first else "response"
        out.append((r[0], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, first.get(data)))
        first.setdefault(data, r[0])
    return sorted(out, key=str)


@pytest.mark.parametrize("version", [1, 2])
def test_there_and_back(spark, version):
    got = W.archive_pages(spark.createDataFrame(pages(), SCHEMA), version).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(pages())


def test_empty(spark):
    assert W.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_both_versions_are_parsed_by_their_fields():
    body = b"HTTP/1.0 200 OK\r\n\r\nhi"
    one = W.arc_version_block(1) + b"\nhttp://a/ 1.2.3.4 19990102030405 text/html; x=1 %d\n" % len(body) + body + b"\n"
    two = W.arc_version_block(2) + b"\nhttp://b/ 1.2.3.4 2001 text/html 200 sum - 12 f.arc %d\n" % len(body) + body + b"\n"
    found = list(W.arc_records(one + two))
    assert [(r.url, r.date, r.content_type, r.content) for r in found] == [("http://a/", "19990102030405", "text/html; x=1", body), ("http://b/", "2001", "text/html", body)]
    assert [W.warc_date(r.date) for r in found] == ["1999-01-02T03:04:05Z", "2001-01-01T00:00:00Z"]


def test_cut_off_records_are_an_error():
    with pytest.raises(ValueError, match="cut off"):
        list(W.arc_records(b"http://a/ 0.0.0.0 19990102030405 text/html 10\nshort"))
    with pytest.raises(ValueError, match="no record"):
        list(W.warc_records(b"WARC/1.0x"))


def test_identifiers_repeat():
    assert W.record_id("u", "d", "x", 1) == W.record_id("u", "d", "x", 1) != W.record_id("u", "d", "x", 2)


ONE = b"""filedesc://IA-1.arc 0.0.0.0 19960923142103 text/plain 75
1 0 Alexa Internet
URL IP-address Archive-date Content-type Archive-length

http://www.dryswamp.edu:80/index.html#page=two 127.10.100.2 19961104142103 text/html 29
HTTP/1.0 200 OK\r
\r
<b>Hi</b>

http://a.example/x.pdf#page=3 127.10.100.3 19961104142104 text/html; charset=x 9
<i>y</i>

"""
TWO = b"""filedesc://IA-2.arc 0.0.0.0 19970923142103 text/plain 200 - - 0 IA-2.arc 121
2 0 Alexa Internet
URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

http://b.example/old 1.2.3.4 19971104142103 text/html 302 fac069150613fe55599cc7fa88aa089d http://b.example/new 209 IA-2.arc 9
<i>y</i>

"""


@pytest.mark.parametrize("how", ["plain", "one member", "member a record"])
def test_archives_of_others(spark, tmp_path, how):
    import gzip
    import re

    (tmp_path / "arc").mkdir()
    for name, data in (("one.arc", ONE), ("two.arc", TWO)):
        starts = [m.start() for m in re.finditer(rb"^(?:filedesc|http)://\S+ \d+\.\d+\.\d+\.\d+ ", data, re.M)]
        members = [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
        assert len(members) == (3 if name == "one.arc" else 2)
        data = {"plain": data, "one member": gzip.compress(data), "member a record": b"".join(map(gzip.compress, members))}[how]
        (tmp_path / "arc" / (name if how == "plain" else name + ".gz")).write_bytes(data)
    W.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    found = [x for p in sorted((tmp_path / "warc").glob("part-*")) for x in W.warc_records(gzip.decompress(p.read_bytes()))]
    by = {h.get("warc-target-uri") or h["warc-filename"]: (h, b) for h, b in found}
    assert len(found) == len(by) == 5 and len({h["warc-record-id"] for h, _ in found}) == 5
    assert by["IA-1.arc"][0]["warc-type"] == by["IA-2.arc"][0]["warc-type"] == "warcinfo" and by["IA-1.arc"][1].startswith(b"1 0 Alexa Internet\n")
    h, block = by["http://www.dryswamp.edu:80/index.html#page=two"]
    assert h["warc-type"] == "response" and block == b"HTTP/1.0 200 OK\r\n\r\n<b>Hi</b>\n" and h["warc-ip-address"] == "127.10.100.2" and h["warc-date"] == "1996-11-04T14:21:03Z"
    assert h["content-type"] == "application/http; msgtype=response" and h["warc-payload-digest"] == "sha1:" + W.payload_digest(b"<b>Hi</b>\n") and h["warc-block-digest"] == "sha1:" + W.payload_digest(block)
    assert by["http://a.example/x.pdf#page=3"][0]["content-type"] == "text/html; charset=x" and by["http://a.example/x.pdf#page=3"][0]["warc-type"] == "resource"
    h, block = by["http://b.example/old"]
    assert h["warc-type"] == "revisit" and block == b"" and h["warc-refers-to-target-uri"] == "http://a.example/x.pdf#page=3"
    assert h["warc-refers-to"] == by["http://a.example/x.pdf#page=3"][0]["warc-record-id"] and h["warc-refers-to-date"] == "1996-11-04T14:21:04Z"
    assert (h["x-arc-result-code"], h["x-arc-checksum"], h["x-arc-location"], h["x-arc-offset"], h["x-arc-filename"]) == ("302", "fac069150613fe55599cc7fa88aa089d", "http://b.example/new", "209", "IA-2.arc")
    got = W.read_warc(spark, f"file://{tmp_path}/warc").collect()
    assert sorted(r["record_type"] for r in got) == ["resource", "response", "revisit"] and {r["page_id"] for r in got} == {None}


def test_http_headers_dns_and_metadata(spark, tmp_path):
    """Equal bodies behind different headers are one payload; dns and metadata records are resources of their own type; a cut header block is no payload."""
    import gzip

    def record(url, kind, content):
        return f"{url} 9.9.9.9 20010203040506 {kind} {len(content)}\n".encode() + content + b"\n"

    body = b"<html>same\n\nbody</html>"
    data = W.arc_version_block(1) + b"\n" + b"".join([
        record("http://x/1", "text/html", b"HTTP/1.1 200 OK\r\nServer: a\r\n\r\n" + body),
        record("https://x/2", "text/html", b"HTTP/1.0 203 Odd\nServer: b\n\n" + body),
        record("dns:x", "text/dns", b"20010203040506\nx. 60 IN A 9.9.9.9\n"),
        record("metadata://x/m", "application/xml", b"<m/>"),
        record("http://x/3", "no-type", b"HTTP/1.1 304 Not Modified\r\nServer: a\r\n"),
    ])
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc").write_bytes(data)
    W.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    found = [x for p in sorted((tmp_path / "warc").glob("part-*")) for x in W.warc_records(gzip.decompress(p.read_bytes()))]
    by = {h.get("warc-target-uri"): (h, b) for h, b in found}
    kinds = {u: (h["warc-type"], h["content-type"], b) for u, (h, b) in by.items() if u}
    http = "application/http; msgtype=response"
    assert kinds == {
        "http://x/1": ("response", http, b"HTTP/1.1 200 OK\r\nServer: a\r\n\r\n" + body),
        "https://x/2": ("revisit", http, b"HTTP/1.0 203 Odd\nServer: b\n\n"),
        "dns:x": ("resource", "text/dns", b"20010203040506\nx. 60 IN A 9.9.9.9\n"),
        "metadata://x/m": ("resource", "application/xml", b"<m/>"),
        "http://x/3": ("response", http, b"HTTP/1.1 304 Not Modified\r\nServer: a\r\n"),
    }
    got = {r["url"]: r for r in W.read_warc(spark, f"file://{tmp_path}/warc").collect()}
    assert got["https://x/2"]["payload_digest"] == got["http://x/1"]["payload_digest"] == W.payload_digest(body) and got["http://x/3"]["payload_bytes"] == 0
