import gzip
import hashlib
import zlib
from html.parser import HTMLParser

from tidegauge.llm import warc

DATE = "2024-01-01T00:00:00Z"


class Reader(HTMLParser):
    """A plain reader of well-formed pages, for comparison."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.silent, self.text, self.title, self.in_title, self.links = 0, "", "", False, []

    def handle_starttag(self, tag, attrs):
        if tag in warc.SILENT.split("|"):
            self.silent += 1
        self.in_title |= tag == "title"
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])
        self.text += "\n" * bool(not self.silent and warc._BLOCK.fullmatch(f"<{tag}>"))

    def handle_startendtag(self, tag, attrs):
        self.text += "\n" * bool(not self.silent and warc._BLOCK.fullmatch(f"<{tag}>"))

    def handle_endtag(self, tag):
        if tag in warc.SILENT.split("|"):
            self.silent -= 1
        if tag == "title":
            self.in_title = False
        self.text += "\n" * bool(not self.silent and warc._BLOCK.fullmatch(f"<{tag}>"))

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.silent:
            self.text += data


def read(page):
    r = Reader()
    r.feed(page)
    r.close()
    lines = (" ".join(x.split()) for x in (r.title + "\n" + r.text).split("\n"))
    return "\n".join(x for x in lines if x), r.links


def test_pages_against_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {warc.record_id("response", str(p.page_id), p.url, warc.digest(p.html.encode())): p for p in pages.collect()}
    rows = warc.derive(warc.responses(pages, DATE)).collect()
    assert len(rows) == 2 * len(source)
    for r in rows:
        page = source[r.refers_to]
        text, links = read(page.html)
        assert (r.target_uri, r.warc_date, r.source_payload_digest) == (page.url, DATE, warc.digest(page.html.encode()))
        assert r.block_digest == warc.digest(bytes(r.block)) and r.source_block_digest.startswith("sha1:")
        if r.warc_type == "conversion":
            assert bytes(r.block).decode() == text
        else:
            fields = [x.split(": ", 1) for x in bytes(r.block).decode().split("\r\n")[:-1]]
            assert [v for k, v in fields if k == "outlink"] == [" ".join(x.split()) for x in links]
            assert ["http-status", "HTTP/1.1 200 OK"] in fields and ["http-header-content-type", "text/html; charset=utf-8"] in fields


def test_round_trip(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    records = warc.responses(pages, DATE)
    every = records.union(warc.derive(records))
    want = sorted(map(str, every.collect()))
    packed = [bytes(r.record) for r in warc.serialise(every).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(packed[:40]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, packed[40:])))
    assert sorted(map(str, warc.parse(spark.read.format("binaryFile").load(str(tmp_path))).collect())) == want


def test_hard_pages():
    assert warc.plain_text("a<b>b</b>c &amp; d<br>e<script>var x='<p>';</script>f<!-- <p>g -->h<style>i") == "abc & d\ne f h"
    assert warc.plain_text("1 < 2 and <p>unclosed <a href=x") == "1 < 2 and\nunclosed <a href=x"
    assert warc.decoded([("Content-Type", "text/html; charset=latin-1")], b"\xe9") == "é"
    assert warc.decoded([], b'<meta charset="no-such">\xff') == '<meta charset="no-such">�'
    assert warc.split_http(b"HTTP/1.0 404 Not Found\nA: b\n\nbody") == ("HTTP/1.0 404 Not Found", [("A", "b")], b"body")
    assert warc.split_http(b"plain") == ("", [], b"plain")
    assert list(warc.split_records(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc")) == []


def test_awkward_rows(spark):
    ddl = "page_id bigint, url string, html string, block string"
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "http://a", "", "x"), (2, "http://b", "<p>" * 50000 + "deep", "x"), (2, "http://b", "<p>" * 50000 + "deep", "x")], ddl)
    rows = warc.derive(warc.responses(pages, DATE)).collect()
    assert len(rows) == 8 and sorted(bytes(r.block) for r in rows if r.warc_type == "conversion") == [b"", b"", b"deep", b"deep"]
    assert warc.derive(warc.responses(spark.createDataFrame([], ddl), DATE)).count() == 0
    assert hashlib.sha1(b"").hexdigest() and warc.digest(b"") == "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_damaged_records_do_not_end_the_reading():
    def record(length, block, *more):
        return "\r\n".join(["WARC/1.0", "WARC-Type: response", f"Content-Length: {length}", *more]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    blocks = [r[6] for r in warc.split_records(record(3, b"one") + record("many", b"two") + record(-40, b"three") + record("9" * 5000, b"x") + record(4, b"four"))]
    assert blocks == [b"one", b"four"]
    members = [gzip.compress(bytes(range(256)) * 3 + str(i).encode() * 70000) for i in range(4)]
    broken = members[1][:40] + b"\xff" * 60 + members[1][100:]
    whole = [gzip.decompress(members[i]) for i in (0, 2, 3)]
    assert warc.inflated(members[0] + broken + members[2] + members[3]) == b"".join(whole)
    assert warc.inflated(members[0] + members[2][:50]).startswith(whole[0])
    assert warc.inflated(b"plain") == b"plain" and warc.inflated(b"\x1f\x8b\x08broken") == b""


def test_encodings_of_payloads():
    for name in ("idna", "undefined", "hex", "punycode", "no-such"):
        assert "<p>\N{BULLET}" in warc.decoded([("Content-Type", f"text/html; charset={name}")], "<p>\N{BULLET}\xff..".encode())
    page = b"<p>some text</p>" * 20
    chunked = b"".join(b"%x;note=1\r\n%s\r\n" % (len(page[i:i + 33]), page[i:i + 33]) for i in range(0, len(page), 33)) + b"0\r\n\r\n"
    zipped = gzip.compress(page)
    raw = zlib.compressobj(wbits=-15)
    assert warc.bare([("Transfer-Encoding", "chunked")], chunked) == page
    assert warc.bare([("Transfer-Encoding", "chunked"), ("content-encoding", "GZIP")], b"%X\r\n%s\r\n0\r\n\r\n" % (len(zipped), zipped)) == page
    assert warc.bare([("Content-Encoding", "deflate")], zlib.compress(page)) == warc.bare([("Content-Encoding", "deflate")], raw.compress(page) + raw.flush()) == page
    assert warc.bare([("Transfer-Encoding", "chunked"), ("Content-Encoding", "gzip")], page) == page
    assert warc.unchunked(b"ff\r\ntoo short") == b"ff\r\ntoo short"


def test_source_headers_stay(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=idna\r\n\r\n<title>T</title>\xff"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-IP-Address: 10.0.0.1\r\nwarc-truncated: length\r\nContent-Length: {len(block)}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(head.encode() + block + b"\r\n\r\n")
    records = warc.parse(spark.read.format("binaryFile").load(str(tmp_path)))
    assert [r.headers for r in records.collect()] == ["WARC-IP-Address: 10.0.0.1\nwarc-truncated: length"]
    derived = warc.derive(records)
    assert {r.headers for r in derived.collect()} == {"X-Source-WARC-IP-Address: 10.0.0.1\nX-Source-warc-truncated: length"}
    assert all(b"X-Source-WARC-IP-Address: 10.0.0.1\r\n" in bytes(r.record) for r in warc.serialise(derived).collect())
