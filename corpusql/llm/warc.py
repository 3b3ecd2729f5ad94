"""WARC derivative builder: from response records to linked metadata and plain-text conversion records.

Every response gives one metadata record (application/warc-fields: title, language, outlinks, the source's
status and headers) and one conversion record (text/plain, UTF-8). Both carry WARC-Refers-To with the
response's identifier, its target URI and date, its payload digest and its HTTP headers. Digests are SHA-1 in
base 32, identifiers name-based UUIDs of the source's identifier, the record's type and its content, so
a second run gives the same records. There is no shuffle: records are derived where the response is read.

Text: comments, scripts, styles and the like go; block elements end lines; entities are resolved; white
space is joined. Titles, noscripts, templates and svgs go; of one that isn't closed only the tag does. Whole pages are
read, each in a single pass, so that no page costs more than its length. ``read_responses`` reads WARC files; the
table ``pages`` has no headers, so op4's responses get a status line, a type and a length of their own.

Nulls and edges: a null or empty page gives records of no text; a null URL gives none of that header;
repeated rows give repeated records; an empty table gives no rows; other columns aren't read."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.common import settle, table

DATE = "2024-01-01T00:00:00Z"
#: A tag: what isn't quoted in it holds no "<", and nothing is tried twice, so a page is read in one pass whatever it holds.
_TOKEN = re.compile(r"<(?:!--|(?P<shut>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*+)(?P<rest>(?:[^'\"<>]++|\"[^\"]*+\"|'[^']*+')*+)>|[!?][^<>]*+>)")
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Elements whose contents aren't text; of those in _OPEN the rest of the page goes if they aren't closed, of the others the tag only.
_GONE, _OPEN = frozenset("script style noscript template svg title".split()), frozenset("script style".split())
_CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in _GONE}
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_HREF = re.compile(r"(?:^|\s|[\"'])href\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_SPACES = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def parsed(page: str | None) -> tuple[str, str | None, str | None, list[str]]:
    """(text, title, language, links) of a page, in one pass."""
    page = page or ""
    out, links, title, lang = [], [], None, None
    at, unclosed = 0, set()
    for m in iter(lambda: _TOKEN.search(page, at), None):
        out.append(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        name = (m["tag"] or "").lower()
        if not m["shut"] and name in _GONE and name not in unclosed and not (name == "svg" and m["rest"].endswith("/")):
            if end := _CLOSE[name].search(page, at):
                if name == "title" and title is None:
                    title = page[at : end.start()]
                at = end.end()
            elif name in _OPEN:
                at = len(page)
            else:
                unclosed.add(name)  # nor is it closed further on
        elif not m["shut"] and name == "a" and (h := _HREF.search(m["rest"])):
            links.append(next((x for x in h.groups() if x is not None), ""))
        elif not m["shut"] and name == "html" and lang is None and (h := _LANG.search(m["rest"])):
            lang = h[1].lower()
        if name in _BLOCKS:
            out.append("\n")
    text = html.unescape("".join([*out, page[at:]]))
    return "\n".join(x for x in (_SPACES.sub(" ", ln).strip() for ln in text.split("\n")) if x), title, lang, links


def plain_text(page: str | None) -> str:
    return parsed(page)[0]


def _clean(s: str) -> str:
    return " ".join(html.unescape(s).split())


def fields(page: str | None, headers: str) -> str:
    """application/warc-fields of a page: one a line."""
    return _fields(*parsed(page)[1:], headers)


def _fields(title: str | None, lang: str | None, links: list[str], headers: str) -> str:
    out = [] if title is None else [f"title: {_clean(title)}"]
    out += [] if lang is None else [f"language: {lang}"]
    lines = headers.split("\r\n")
    out += [f"source-status: {lines[0]}", *(f"source-header: {x}" for x in lines[1:] if x)]
    out += [f"outlink: {_clean(x)}" for x in links]
    return "".join(x + "\r\n" for x in out)


RECORD = "record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, source_headers string, payload_digest string, block_digest string, content_length long, content string"


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of pages(page_id, url, html): page_id, record_id, target_uri, warc_date, http_headers, payload."""
    body = F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body))
    hexes = F.sha1(F.concat_ws("\0", F.col("page_id").cast("string"), "url", body).cast("binary"))
    version, variant = F.concat(F.lit("5"), F.substring(hexes, 14, 3)), F.concat(F.lit("a"), F.substring(hexes, 18, 3))
    name = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), version, variant, F.substring(hexes, 21, 12))
    return pages.select("page_id", F.concat(F.lit("<urn:uuid:"), name, F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), body.alias("payload"))


def derivatives(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records, RECORD with ``key`` in front, of each response(key: long, record_id, target_uri, warc_date, http_headers, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *(c.split()[0] for c in RECORD.split(", "))]
        for x in batches:
            rows = []
            for k, rid, uri, date, headers, page in zip(*(x[c].to_pylist() for c in (key, "record_id", "target_uri", "warc_date", "http_headers", "payload")), strict=True):
                source, headers = digest((page or "").encode("utf-8", "replace")), headers or ""
                text, *found = parsed(page)
                for kind, mime, content in (("metadata", "application/warc-fields", _fields(*found, headers)), ("conversion", "text/plain; charset=utf-8", text)):
                    block = content.encode("utf-8", "replace")
                    d = digest(block)
                    rows.append((k, identifier(rid or "", kind, d), kind, rid, uri, date, mime, headers, source, d, len(block), content))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            types = [pa.int64(), *[pa.string()] * 9, pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    settle(records.sparkSession)
    return records.select(key, "record_id", "target_uri", "warc_date", "http_headers", "payload").mapInArrow(run, f"{key} long, {RECORD}")


def to_warc(row) -> bytes:
    """The bytes of one record, WARC/1.1; the source's HTTP headers go along in base 64, as a header of their own."""
    heads = [("WARC-Type", row.warc_type), ("WARC-Record-ID", row.record_id), ("WARC-Refers-To", row.refers_to), ("WARC-Target-URI", row.target_uri), ("WARC-Date", row.warc_date), ("WARC-Block-Digest", row.block_digest), ("WARC-Payload-Digest", row.payload_digest), ("X-Source-Headers", base64.b64encode((row.source_headers or "").encode()).decode()), ("Content-Type", row.content_type), ("Content-Length", str(row.content_length))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads if v is not None).encode() + b"\r\n" + row.content.encode("utf-8", "replace") + b"\r\n\r\n"


def from_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file, plain or gzip (a member a record, or all in one).

    Names of headers come in lower case; lines that go on are joined, lines without a colon left out. Bytes that are no
    record raise ValueError; a block that the file cuts off comes as far as it goes."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = re.sub(r"\r\n[ \t]+", " ", data[at:end].decode("utf-8", "replace")).split("\r\n")[1:]
        heads = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}
        n = int(heads.get("content-length", 0))
        yield heads, data[end + 4 : end + 4 + n]
        at = end + 4 + n


RESPONSE = "record_id string, target_uri string, warc_date string, http_headers string, payload string, digest_ok boolean"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """RESPONSE rows of the WARC files at ``path`` that any of Spark's file systems reads, for ``derivatives``.

    Of each response record the HTTP headers as they stand and the body as text (charset of Content-Type, else UTF-8);
    digest_ok: whether its payload digest is right (null: none, or not of SHA-1). A file is one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for data in x["content"].to_pylist():
                rows = []
                for h, block in from_warc(data):
                    if h.get("warc-type") != "response":
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    http = head.decode("utf-8", "replace")
                    charset = re.search(r"(?im)^content-type:[^\r\n]*charset=\"?([\w-]+)", http)
                    try:
                        text = body.decode(charset[1] if charset else "utf-8", "replace")
                    except LookupError:
                        text = body.decode("utf-8", "replace")
                    said = h.get("warc-payload-digest", "")
                    rows.append((h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), http, text, said == digest(body) if said.startswith("sha1:") else None))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                types = [*[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in RESPONSE.split(", ")])

    settle(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RESPONSE)


def warc_blocks(records: DataFrame) -> DataFrame:
    """warc: binary, the bytes of each derived record; files are any concatenation of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from types import SimpleNamespace

        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.array([to_warc(SimpleNamespace(**r)) for r in x.to_pylist()], pa.binary())], ["warc"])

    return records.select(*(c.split()[0] for c in RECORD.split(", "))).mapInArrow(run, "warc binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))
