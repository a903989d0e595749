"""WARC derivatives: metadata and plain-text conversion records of response records.

``responses_of_files`` reads the response records of WARC files (plain or gzip members), ``write_record`` writes
records. ``derive`` makes two records of every response: a ``metadata`` record (``application/warc-fields``) that
keeps the response's own WARC headers and the digests that they declare, its HTTP status and headers, its digests
as computed, title, language and outgoing links, and a ``conversion`` record with the text of an HTML or plain
payload. Both name the response in WARC-Refers-To and keep its target URI and date; record ids are made from the
response's id, so a repeated run gives the same records. Digests are labelled base-32 SHA-1, as usual in WARC
files, and are those of the bytes as stored. Payloads stay bytes throughout: chunked, gzip and deflate bodies are
undone for the text, which is decoded by the charset of the HTTP header, else of the page, else as UTF-8.

The text: comments, scripts, styles, templates and other tags go; block elements part lines; character
references are resolved; runs of white space become one space and empty lines vanish.

Defined cases: a null payload is empty; a null URI stays null and its header is left out; a null record id is
named after URI and payload digest; payloads that are neither HTML nor text get a conversion record without
text, as do bodies whose coding can't be undone; bytes that aren't of the charset become U+FFFD; malformed markup is text from its ``<`` on; repeated rows get repeated records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, modest_batches

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)(?=[\s/>])[^<>]*>.*?(?:</\1\s*>|\Z)|<[!?][^<>]*>|</?([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>",
    re.S | re.I,
)
_BLOCK = frozenset("address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_TITLE = re.compile(r"<title[^<>]*>(.*?)</title", re.S | re.I)
_LANG = re.compile(r"<html[^<>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_HREF = re.compile(r"<a\s[^<>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s<>\"']+))", re.I)
_CHARSET = re.compile(rb"<meta\s[^<>]*?\bcharset\s*=\s*[\"']?\s*([\w-]+)", re.I)
_SPACE = re.compile(r"[^\S\n]+")

RECORD = "record_id string, type string, refers_to string, target_uri string, date string, content_type string, headers string, block binary, block_digest string, payload_digest string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def text_of_html(page: str) -> str:
    def replaced(m: re.Match) -> str:
        name = m.group(2)
        return "\n" if name and name.lower() in _BLOCK else " " if name is None else ""

    text = html.unescape(_TAG.sub(replaced, page))
    lines = (_SPACE.sub(" ", line).strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def links_of(page: str) -> list[str]:
    return [html.unescape(a or b or c).strip() for a, b, c in _HREF.findall(page)]


def _clean(value: str) -> str:
    return _SPACE.sub(" ", value.replace("\r", " ").replace("\n", " ")).strip()


def header_block(fields: list[tuple[str, str | None]], length: int) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in fields if v) + f"Content-Length: {length}\r\n"


def write_record(headers: str, block: bytes, compress: bool = True) -> bytes:
    record = headers.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(record, mtime=0) if compress else record


def read_records(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC file, one in memory at a time."""
    source = io.BufferedReader(io.BytesIO(data) if isinstance(data, bytes) else data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=source)) if source.peek(2)[:2] == b"\x1f\x8b" else source
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where {line[:20]!r} stands")
        fields: dict[str, str] = {}
        name = ""
        while (line := stream.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and name:
                fields[name] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                name = name.strip().lower()
                fields[name] = value.strip()
        size = int(fields.get("content-length", "0"))
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"a record of {size} bytes ends after {len(block)}")
        yield fields, block


RESPONSE = "record_id string, target_uri string, date string, warc_headers string, http_headers string, payload binary"


def responses_of_files(spark: SparkSession, path: str) -> DataFrame:
    """The response records (``RESPONSE``) of the WARC files at a path or glob of any store that Spark reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for fields, block in read_records(pa.BufferReader(content.as_buffer())):
                    if fields.get("warc-type") == "response":
                        head, payload = split_http(block)
                        row = (fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), "\r\n".join(f"{k}: {v}" for k, v in fields.items()), head, payload)
                        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.string()) for x in row[:5]), pa.array([payload], pa.binary())], names=[f.split()[0] for f in RESPONSE.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RESPONSE)


def split_http(block: bytes) -> tuple[str, bytes]:
    """HTTP status line and headers, and payload, of a response record's block."""
    head, found, payload = block.partition(b"\r\n\r\n")
    return (head.decode("latin-1"), payload) if found else ("", block)


def _plain_body(body: bytes, fields: list[tuple[str, str]]) -> bytes | None:
    """The body without its transfer and content codings; null if they can't be undone."""
    coding = {k.lower(): v.lower() for k, v in fields}
    try:
        if "chunked" in coding.get("transfer-encoding", "") and re.match(rb"[0-9A-Fa-f]+[^\r\n]*\r\n", body):
            parts, at = [], 0
            while at < len(body):
                end = body.index(b"\r\n", at)
                size = int(body[at:end].split(b";")[0], 16)
                parts.append(body[end + 2 : end + 2 + size])
                at = end + 4 + size if size else len(body)
            body = b"".join(parts)
        for name in reversed([x.strip() for x in coding.get("content-encoding", "").split(",") if x.strip()]):
            if name in ("gzip", "x-gzip"):
                body = gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body  # some crawlers store it undone
            elif name == "deflate":
                try:
                    body = zlib.decompress(body)
                except zlib.error:
                    body = zlib.decompress(body, -15)
            elif name != "identity":
                return None
    except (ValueError, OSError, EOFError, zlib.error):
        return None
    return body


def _decoded(body: bytes, content_type: str, is_html: bool) -> str:
    m = re.search(r"charset=[\"']?([\w-]+)", content_type, re.I)
    own = None if m or not is_html else _CHARSET.search(body[:2048])
    try:
        return body.decode(m[1] if m else own[1].decode() if own else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    return [tuple(x.strip() for x in line.partition(":")[::2]) for line in lines if ":" in line]


def derivatives(record_id: str | None, uri: str | None, date: str | None, warc: str | None, http: str | None, payload: bytes | None) -> list[tuple]:
    """The metadata and the conversion record (``RECORD``) of one response with its WARC and HTTP header lines."""
    payload, http = payload or b"", http or ""
    lines = http.split("\r\n") if http else []
    fields = _fields(lines[1:])
    kind = next((v for k, v in fields if k.lower() == "content-type"), "text/html; charset=utf-8")
    source_payload, source_block = digest(payload), digest((http.encode("latin-1", "replace") + b"\r\n\r\n" if http else b"") + payload)
    record_id = record_id or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, (uri or '') + ' ' + source_payload)}>"
    is_html = "html" in kind.lower()
    body = _plain_body(payload, fields) if is_html or kind.lower().startswith("text/") else None
    page = _decoded(body, kind, is_html) if body is not None else ""
    text = text_of_html(page) if is_html else page
    about: list[tuple[str, str]] = [("source-block-digest", source_block), ("source-payload-digest", source_payload), ("source-payload-length", str(len(payload)))]
    about += [(f"source-header-{k.lower()}", v) for k, v in _fields((warc or "").split("\r\n"))]
    if lines:
        about.append(("http-status", lines[0]))
    about += [(f"http-header-{k.lower()}", v) for k, v in fields]
    if is_html:
        title, lang = _TITLE.search(page), _LANG.search(page)
        about += [("title", html.unescape(title[1]))] if title else []
        about += [("language", lang[1])] if lang else []
        about += [("outlink", x) for x in links_of(page)]
    out = []
    for what, content, block in (("metadata", "application/warc-fields", "".join(f"{k}: {_clean(v)}\r\n" for k, v in about).encode("utf-8", "replace")), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, what + ' ' + record_id)}>"
        mark = digest(block)
        head = [("WARC-Type", what), ("WARC-Record-ID", own), ("WARC-Refers-To", record_id), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Block-Digest", mark), ("Content-Type", content)]
        out.append((own, what, record_id, uri, date, content, header_block(head, len(block)), block, mark, source_payload))
    return out


def derive(responses: DataFrame, *, slice_bytes: int = 4 << 20) -> DataFrame:
    """Two rows (``RECORD``) for every row of record_id, target_uri, date, http_headers, payload (binary or text) and,
    where there is such a column, warc_headers (the response's own header lines). Narrow: no shuffle."""
    modest_batches(responses.sparkSession)
    warc = F.col("warc_headers").cast("string") if "warc_headers" in responses.columns else F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = responses.select(text("record_id"), text("target_uri"), text("date"), warc.alias("warc_headers"), text("http_headers"), F.col("payload").cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "payload", slice_bytes):
            out: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                out += derivatives(*r)
            columns = list(zip(*out))
            types = [pa.string()] * 7 + [pa.binary()] + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[f.split()[0] for f in RECORD.split(", ")])

    return rows.mapInArrow(run, RECORD)


def responses_of_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Crawled pages (page_id, url, html) as response records, with ids made from page_id and url."""
    key = F.sha1(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    name: Column = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(key, 1, 8), F.substring(key, 9, 4), F.substring(key, 13, 4), F.substring(key, 17, 4), F.substring(key, 21, 12)), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"))
    return pages.select("page_id", name.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), F.col("html").alias("payload"))
