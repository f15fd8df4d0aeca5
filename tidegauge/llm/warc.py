"""WARC records as rows, and the derivatives of responses: linked metadata and plain-text conversion records.

A record is a row of RECORD_DDL. `responses` makes response records of web pages, `derive` a metadata and a conversion record of
each response, `serialise` the bytes of records in WARC/1.0 and `parse` records of such bytes, also gzipped ones of several members.
Derived records name their response in `refers_to` and keep its URI, date, source headers and digests: `headers` holds the
header lines of a record that have no column of their own, in a derived record those of its response under X-Source-. Ids are
name-based, so a task that runs again makes the same records.

Cases: a null or empty payload gives records with an empty text; a null URI is an empty one; a response without an HTTP head
is all payload; undecodable bytes and texts in an encoding that is none become replacement signs or UTF-8. Chunks and gzip or
deflate encodings of a payload are undone; one that is damaged counts as it stands. In a file, a record whose length is no number is left
out, and so is a gzip member that is damaged; reading goes on after it. Every record is handled on its own; a payload is held whole.
"""

import base64
import hashlib
import html
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RECORD_DDL = ("record_id string, warc_type string, target_uri string, warc_date string, refers_to string, content_type string, block binary, "
              "block_digest string, payload_digest string, source_block_digest string, source_payload_digest string, headers string")
NAMES = [f.split()[0] for f in RECORD_DDL.split(", ")]
FIELDS = pa.schema([(n, pa.binary() if n == "block" else pa.string()) for n in NAMES])
# The name space of URLs, elements without readable text, and elements that break a line.
NAMESPACE = uuid.NAMESPACE_URL
SILENT = "script|style|noscript|template|iframe|svg|head"
BLOCKS = ("address|article|aside|blockquote|body|br|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|"
          "li|main|nav|ol|option|p|pre|section|select|summary|table|tbody|td|tfoot|th|thead|title|tr|ul")
NO_CHARSETS = ("idna", "punycode", "raw_unicode_escape", "undefined", "unicode_escape")  # codecs that no page is written in
_SILENT = re.compile(rf"<!--.*?(?:-->|\Z)|<({SILENT})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.I | re.S)
_BLOCK = re.compile(rf"</?(?:{BLOCKS})\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_SPACE = re.compile(r"[^\S\n]+")
_LENGTH = re.compile(r"[0-9]{1,18}")
_CHUNK = re.compile(rb"([0-9a-fA-F]{1,15})[^\r\n]*\r?\n")
PIECE = 1 << 16


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(10).join(names))}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP message."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        head, _, payload = block.partition(b"\n\n")
    status, *lines = head.decode("latin-1").splitlines()
    headers = [(k.strip(), v.strip()) for k, found, v in (line.partition(":") for line in lines) if found]
    return status, headers, payload


def header(headers: list[tuple[str, str]], name: str) -> str:
    return next((v for k, v in headers if k.lower() == name), "")


def unchunked(payload: bytes) -> bytes:
    """The content of a chunked body; the body itself if it isn't one to its end."""
    at, out = 0, []
    while (size := _CHUNK.match(payload, at)) is not None:
        n = int(size[1], 16)
        if n == 0:
            return b"".join(out)
        out.append(payload[size.end():size.end() + n])
        at = size.end() + n
        if len(out[-1]) < n:
            break
        at += 2 if payload[at:at + 2] == b"\r\n" else payload[at:at + 1] == b"\n"
    return payload


def bare(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without transfer and content encodings, the last one first."""
    if "chunked" in header(headers, "transfer-encoding").lower():
        payload = unchunked(payload)
    for name in reversed(header(headers, "content-encoding").lower().replace(" ", "").split(",")):
        try:
            if name in ("gzip", "x-gzip"):
                payload = zlib.decompress(payload, 31)
            elif name == "deflate":
                payload = zlib.decompress(payload, 15 if payload[:1] == b"\x78" else -15)
        except zlib.error:
            break
    return payload


def decoded(headers: list[tuple[str, str]], payload: bytes) -> str:
    kind = header(headers, "content-type")
    named = _CHARSET.search(kind) or _CHARSET.search(payload[:1024].decode("latin-1"))
    charset = named[1].lower().replace("-", "_") if named else "utf-8"
    try:
        return payload.decode("utf-8" if charset in NO_CHARSETS else charset, "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """Readable lines of a page: block elements break lines, white space is one space, empty lines go."""
    title = _TITLE.search(page)
    body = _TAG.sub("", _BLOCK.sub("\n", _SILENT.sub(" ", page)))
    text = html.unescape((title[1] if title else "") + "\n" + body)
    return "\n".join(line for line in (x.strip() for x in _SPACE.sub(" ", text).split("\n")) if line)


def metadata_fields(status: str, headers: list[tuple[str, str]], page: str, text: str) -> bytes:
    """Lines `name: value`: what the source said of itself, then title, sizes and links in order."""
    title = _TITLE.search(page)
    fields = [("http-status", status)] + [(f"http-header-{k.lower()}", v) for k, v in headers]
    fields += [("title", html.unescape(title[1] if title else "")), ("characters", str(len(text))), ("lines", str(text.count("\n") + bool(text)))]
    fields += [("outlink", html.unescape(next(x for x in m.groups() if x is not None))) for m in _LINK.finditer(page)]
    return "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode("utf-8", "replace")


def _by_row(make):
    """mapInArrow function that makes a list of record tuples of each row, given as a dict."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = [r for row in batch.slice(start, 256).to_pylist() for r in make(row)]
                columns = list(zip(*rows)) or [()] * len(NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS)], schema=FIELDS)
    return run


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Response records of pages(page_id, url, html) fetched at `date`."""
    def make(row):
        url, payload = row["url"] or "", (row["html"] or "").encode("utf-8", "surrogatepass")
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        block = head + payload
        return [(record_id("response", str(row["page_id"]), url, digest(payload)), "response", url, date, None, "application/http; msgtype=response", block,
                 digest(block), digest(payload), None, None, None)]
    return pages.select("page_id", "url", "html").mapInArrow(_by_row(make), RECORD_DDL)


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record of every response record; other records give none."""
    def make(row):
        if row["warc_type"] != "response":
            return []
        block = row["block"] or b""
        status, headers, payload = split_http(block)
        page = decoded(headers, bare(headers, payload))
        text = plain_text(page)
        about, body = metadata_fields(status, headers, page, text), text.encode("utf-8", "replace")
        of, uri, date = row["record_id"] or "", row["target_uri"] or "", row["warc_date"]
        sources = (row["block_digest"] or digest(block), row["payload_digest"] or digest(payload))
        kept = "\n".join(f"X-Source-{line}" for line in (row["headers"] or "").split("\n") if line) or None
        return [(record_id(kind, of, digest(data)), kind, uri, date, of, content, data, digest(data), digest(data), *sources, kept)
                for kind, content, data in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", body))]
    return records.select(*NAMES).where(F.col("warc_type") == "response").mapInArrow(_by_row(make), RECORD_DDL)


# Names of header lines, in the order they are written; the last two are extensions.
HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "warc_date": "WARC-Date", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
           "content_type": "Content-Type", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest",
           "source_block_digest": "X-Source-Block-Digest", "source_payload_digest": "X-Source-Payload-Digest"}


def serialise(records: DataFrame) -> DataFrame:
    """record_id and `record`: the bytes of each record."""
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                block = row["block"] or b""
                lines = [f"{HEADERS[k]}: {' '.join(row[k].split())}\r\n" for k in HEADERS if row[k]]
                lines += [f"{line}\r\n" for line in (row["headers"] or "").split("\n") if line]
                out.append(("WARC/1.0\r\n" + "".join(lines) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n")
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(out, pa.binary())], names=["record_id", "record"])
    return records.select(*NAMES).mapInArrow(run, "record_id string, record binary")


def inflated(data: bytes) -> bytes:
    """The content of gzip members one after another, without damaged ones; other bytes as they are."""
    out, at = io.BytesIO(), 0
    while data[at:at + 2] == b"\x1f\x8b":
        member, here, content = zlib.decompressobj(31), at, []
        try:
            while not member.eof and here < len(data):
                content.append(member.decompress(data[here:here + PIECE]))
                here += PIECE
            at = min(here, len(data)) - len(member.unused_data)
            out.writelines(content)
        except zlib.error:
            at = data.find(b"\x1f\x8b\x08", at + 1)
            if at < 0:
                return out.getvalue()
    return out.getvalue() + data[at:]


def split_records(data: bytes):
    """Record tuples of the bytes of one or more records; a torn last record ends the reading."""
    at = 0
    back = {v.lower(): k for k, v in HEADERS.items()}
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        row: dict = dict.fromkeys(NAMES)
        length, further = "0", []
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            if name.lower() == "content-length":
                length = value.strip()
            elif name.lower() in back:
                row[back[name.lower()]] = value.strip()
            elif name.strip():
                further.append(" ".join(line.split()))
        if not _LENGTH.fullmatch(length):
            at = end + 4
            continue
        at = end + 4 + int(length)
        if at > len(data):
            return
        row["block"], row["headers"] = data[end + 4:at], "\n".join(further) or None
        yield tuple(row[n] for n in NAMES)


def parse(files: DataFrame, column: str = "content") -> DataFrame:
    """Records of rows of bytes, as `spark.read.format("binaryFile")` reads WARC files."""
    return files.select(F.col(column).alias("content")).mapInArrow(_by_row(lambda row: split_records(inflated(row["content"] or b""))), RECORD_DDL)
