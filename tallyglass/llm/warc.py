"""WARC derivatives: linked metadata and plain-text conversion records of responses.

A response record holds an HTTP message. Its metadata record is JSON with the source's WARC and HTTP headers in their order,
digests, the page's title and its links; its conversion record is the page's text, markup left out, after transfer and
content codings and the charset are undone. Both name the response in WARC-Refers-To, carry its target URI and date, and
have digests of their own. Records are bytes, ready to be concatenated or compressed member by member; parse() reads them
back, whole or as a stream, and reports what is malformed instead of failing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import html, tokens

#: Date of responses whose table has none.
DATE = "1970-01-01T00:00:00Z"
#: Bytes read and inflated at a time, and the most that the headers of a record may take.
CHUNK, HEADER_BYTES = 1 << 20, 1 << 20
_BLANK = re.compile(rb"\r?\n\r?\n")
_NEXT = re.compile(rb"(?<=\n)WARC/[0-9]")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_META = re.compile(rb"<meta[^>]{0,300}?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


class Headers(list):
    """(name, value) pairs in their order; looked up by name, the first one wins and case doesn't matter."""

    def get(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self if k.lower() == name.lower()), default)

    def __getitem__(self, name):
        if not isinstance(name, str):
            return super().__getitem__(name)
        value = self.get(name)
        if value is None:
            raise KeyError(name)
        return value


def _headers(lines: list[bytes]) -> Headers:
    """Pairs from header lines; folded lines continue a value, lines without a colon are left out."""
    out = Headers()
    for raw in lines:
        try:
            line = raw.decode()
        except UnicodeDecodeError:
            line = raw.decode("latin-1")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def agrees(declared: str | None, data: bytes) -> bool | None:
    """Whether data has the digest declared for it, in base 32 or hexadecimal; null for algorithms unknown here."""
    kind, _, value = (declared or "").partition(":")
    if kind.lower() not in ("sha1", "sha256", "sha512", "md5"):
        return None
    found = hashlib.new(kind.lower(), data, usedforsecurity=False).digest()
    return value.strip().upper().rstrip("=") in (base64.b32encode(found).decode().rstrip("="), found.hex().upper())


def _name(*parts: str) -> str:
    """A record id that follows from what the record is of."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.blake2b('|'.join(parts).encode(), digest_size=16).digest(), version=5)}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in (*headers, ("Content-Length", str(len(block))))]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a file whose members may be compressed one by one; raises zlib.error where a member is broken."""
    one, packed, begun, start = None, None, False, b""
    for data in chunks:
        if packed is None:
            data = start = start + data
            if len(start) < 2:
                continue
            packed = start[:2] == b"\x1f\x8b"
        if not packed:
            yield data
            continue
        while data:
            if one is None:
                one, begun, data = zlib.decompressobj(31), True, data.lstrip(b"\0")
                if not data:
                    one, begun = None, False
                    break
            yield one.decompress(data, CHUNK)
            data = one.unconsumed_tail or one.unused_data
            if one.eof:
                one, begun = None, False
    if packed is None:
        yield start
    if begun:
        raise zlib.error("incomplete member")


def parse(data: bytes | Iterable[bytes]) -> Iterator[tuple[Headers, bytes, str | None]]:
    """Headers, block and what is wrong (nothing: null) for each record of a file, given whole or in chunks.

    A record is held whole, the file isn't. Without a valid length a block reaches to the next record; bytes that belong to
    no record come without headers.
    """
    chunks, left, broken = _inflated([data] if isinstance(data, bytes) else data), bytearray(), None

    def more() -> bool:
        nonlocal broken
        try:
            left.extend(next(chunks))
        except StopIteration:
            return False
        except zlib.error as e:
            broken = f"compression: {e}"
            return False
        return True

    def to_next(at: int) -> int:
        """Where the next record begins, or the end."""
        while not (found := _NEXT.search(left, at)):
            at = max(at, len(left) - 8)
            if not more():
                return len(left)
        return found.start()

    while True:
        gap = len(left) - len(left.lstrip(b"\r\n"))
        del left[:gap]
        if len(left) < 6 and more():
            continue
        if not left:
            break
        if not left.startswith(b"WARC/"):
            to = to_next(0)
            yield Headers(), bytes(left[:to]), broken or "no record begins here"
            del left[:to]
            continue
        at = 0
        while not (end := _BLANK.search(left, at)) and len(left) < HEADER_BYTES:
            at = max(0, len(left) - 4)
            if not more():
                break
        if not end:
            to = to_next(5)
            yield Headers(), bytes(left[:to]), broken or "headers without an end"
            del left[:to]
            continue
        headers = _headers(re.split(rb"\r?\n", bytes(left[: end.start()]))[1:])
        size = headers.get("Content-Length", "")
        if not (size.isascii() and size.isdigit()):
            to = to_next(end.end())
            yield headers, bytes(left[end.end() : to]).rstrip(b"\r\n"), "no valid Content-Length"
            del left[:to]
            continue
        stop = end.end() + int(size)
        while len(left) < stop and more():
            pass
        yield headers, bytes(left[end.end() : stop]), (broken or "cut short") if len(left) < stop else None
        del left[:stop]
    if broken:
        yield Headers(), b"", broken


def plain_text(page: str) -> str:
    """The page's visible text, a line for each block."""
    return "\n".join(b.text for b in html.parsed(page).blocks)


def response(url: str, key: str, page: str, date: str = DATE) -> bytes:
    """A response record; its id follows from the address, the key and the content, so equal rows give equal records."""
    payload, url = page.encode(), _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", _name("response", url, key, digest(payload))), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"),
    ]
    return record(headers, block)


def _unchunked(data: bytes) -> bytes:
    """A chunked body put together; what doesn't follow the coding is left as it is."""
    out, at = [], 0
    while (end := data.find(b"\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return data
        if size < 0 or size > len(data) - end - 1:
            return data
        if not size:
            return b"".join(out)
        out.append(data[end + 1 : end + 1 + size])
        at = end + 1 + size
        at += 2 if data[at : at + 2] == b"\r\n" else int(data[at : at + 1] == b"\n")
    return data


def _decoded(body: bytes, coding: str) -> tuple[bytes, str | None]:
    """The body without its content codings, and what could not be undone."""
    for name in reversed([c.strip().lower() for c in coding.split(",") if c.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                body = zlib.decompressobj(31).decompress(body)
            elif name == "deflate":
                body = zlib.decompressobj(15 if body[:1] == b"\x78" else -15).decompress(body)
            elif name == "zstd":
                import zstandard

                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            elif name != "identity":
                return body, f"content coding {name} is unknown"
        except Exception as e:  # noqa: BLE001 - the codecs raise errors of their own
            return body, f"content coding {name}: {e}"
    return body, None


def _charset(kind: str, body: bytes) -> str:
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    if body[:3] == b"\xef\xbb\xbf":
        return "utf-8-sig"
    if body[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    found = named[1] if named else (m[1].decode("latin-1") if (m := _META.search(body[:4096])) else "utf-8")
    try:
        "".encode(found)
    except (LookupError, UnicodeError):
        return "utf-8"
    # web pages that say Latin-1 mean its superset
    return "cp1252" if found.lower() in ("iso-8859-1", "latin1", "latin-1", "us-ascii", "ascii") else found


class Message:
    """An HTTP message: status line, headers, the payload as it stands, without its transfer coding, and as text."""

    def __init__(self, block: bytes):
        end = _BLANK.search(block)
        head, self.payload = (block[: end.start()], block[end.end() :]) if end else (block, b"")
        status, *lines = re.split(rb"\r?\n", head)
        self.status, self.headers = status.decode("latin-1"), _headers(lines)
        self.body = _unchunked(self.payload) if "chunked" in self.headers.get("Transfer-Encoding", "").lower() else self.payload
        whole, self.problem = _decoded(self.body, self.headers.get("Content-Encoding", ""))
        self.text = whole.decode(_charset(self.headers.get("Content-Type", ""), whole), "replace")


def derive(headers: Headers, block: bytes) -> list[tuple[list[tuple[str, str]], bytes, dict]]:
    """The metadata and the conversion record of a response: headers, block and a few facts for each."""
    message = Message(block)
    page = html.parsed(message.text)
    source, target, date = headers.get("WARC-Record-ID", ""), headers.get("WARC-Target-URI", ""), headers.get("WARC-Date", DATE)
    found = [(tag, html.LINKS[tag], html.attribute(attributes, html.LINKS[tag])) for tag, attributes in page.links]
    links = [{"path": f"{tag.upper()}@/{name}", "url": url} for tag, name, url in found if url is not None]
    actual, declared = digest(message.payload), headers.get("WARC-Payload-Digest")
    facts = {
        "Envelope": {
            "WARC-Header-Metadata": list(headers),
            "Payload-Metadata": {
                "Actual-Payload-Digest": actual, "HTTP-Response-Metadata": {
                    "Response-Message": message.status, "Headers": list(message.headers), "Entity-Length": len(message.body),
                    "HTML-Metadata": {"Title": page.title or "", "Links": links},
                },
            },
        }
    }
    # writers differ in whether the digest covers the transfer coding
    told = [agrees(declared, x) for x in ((message.payload,) if message.body is message.payload else (message.payload, message.body))]
    out = []
    text = "\n".join(b.text for b in page.blocks)
    for kind, content, body in (("metadata", "application/json", json.dumps(facts, ensure_ascii=False, sort_keys=True).encode()), ("conversion", "text/plain; charset=utf-8", text.encode())):
        own = [
            ("WARC-Type", kind), ("WARC-Record-ID", _name(kind, source)), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", source),
            ("WARC-Refers-To-Date", date), ("WARC-Refers-To-Target-URI", target), ("WARC-Block-Digest", digest(body)), ("Content-Type", content),
        ]
        ok = declared is None or (None if None in told else any(told))
        out.append((own, body, {"source_digest": actual, "ok": ok, "source_type": message.headers.get("Content-Type"), "n_links": len(links), "problem": message.problem}))
    return out


_FIELDS = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, "
    "source_digest string, source_digest_ok boolean, source_content_type string, n_links long, problem string, record binary"
)
_KINDS = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.binary()]
_COLUMNS = ["page_id", *(f.split(" ")[0] for f in _FIELDS.split(", "))]


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record) with a response record for every row of pages (page_id, url, html); nulls are empty.

    Rows are neither merged nor dropped; equal rows give equal records. White space and control characters in an address
    are percent-encoded. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.slices(batch, "html", 8 << 20):
                made = [response(u or "", str(i), h or "") for i, u, h in zip(*(c.to_pylist() for c in piece.columns))]
                yield pa.RecordBatch.from_arrays([piece.column(0), tokens.blobs(made)], names=["page_id", "record"])

    needed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return needed.mapInArrow(run, "page_id long, record binary")


def _rows(key: int | None, raw: bytes, with_record: bool) -> Iterator[tuple]:
    for headers, block, problem in parse(raw):
        if problem:
            yield key, "quarantine", headers.get("WARC-Record-ID"), None, headers.get("WARC-Target-URI"), headers.get("WARC-Date"), None, len(block), None, None, None, None, None, problem, block if with_record else None
        elif headers.get("WARC-Type") == "response":
            for own, body, facts in derive(headers, block):
                named, full = dict(own), record(own, body) if with_record else None
                yield (
                    key, named["WARC-Type"], named["WARC-Record-ID"], named["WARC-Refers-To"], named["WARC-Target-URI"], named["WARC-Date"], named["Content-Type"],
                    len(body), named["WARC-Block-Digest"], facts["source_digest"], facts["ok"], facts["source_type"], facts["n_links"], facts["problem"], full,
                )


def derivatives(records: DataFrame, with_record: bool = True) -> DataFrame:
    """Two rows, metadata and conversion, for every response in the column record; other whole records give none.

    A malformed record gives one row of record_type 'quarantine' with its bytes and, in problem, what is wrong; problem also
    tells of a content coding that could not be undone. page_id, if there, is carried; a null record gives none.
    source_digest_ok tells whether the payload has the digest that its header declares (null for unknown algorithms). Rows
    are neither merged nor dropped, a record is converted whole, other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.slices(batch, "record", 8 << 20):
                rows = [r for key, raw in zip(piece.column(0).to_pylist(), piece.column(1)) if raw.is_valid for r in _rows(key, raw.as_buffer().to_pybytes(), with_record)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=_COLUMNS)

    key = F.col("page_id").cast("long") if "page_id" in records.columns else F.lit(None).cast("long")
    return records.select(key.alias("page_id"), F.col("record").cast("binary").alias("record")).mapInArrow(run, f"page_id long, {_FIELDS}")


def read_records(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """(file, record, problem): every record of the WARC files at a path, compressed or not.

    Spark lists the files; each is then read as a stream, a record at a time, from a file system that Arrow can open. Where
    Arrow has no access, ``stream=False`` lets Spark read them, each whole and below 2 GB. A malformed record comes as the
    bytes of its block with what is wrong in problem.
    """

    def chunks(name: str) -> Iterator[bytes]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(name)
        with system.open_input_stream(place, compression=None) as source:
            while data := source.read(CHUNK):
                yield data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for headers, block, problem in parse(chunks(file) if stream else content.as_buffer().to_pybytes()):
                    whole = block if problem else record([(k, v) for k, v in headers if k.lower() != "content-length"], block)
                    columns = [pa.array([file]), tokens.blobs([whole]), pa.array([problem], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "record", "problem"])

    files = spark.read.format("binaryFile").load(path)
    if stream:
        listed = files.select(F.regexp_replace("path", r"^file:/+", "file:///").alias("path"), F.lit(None).cast("binary").alias("content"))
        return listed.repartition(F.col("path")).mapInArrow(run, "file string, record binary, problem string")
    return files.select("path", "content").mapInArrow(run, "file string, record binary, problem string")


def member(data: bytes) -> bytes:
    """A record as a compressed member of its own, as WARC files hold them."""
    return gzip.compress(data, mtime=0)
