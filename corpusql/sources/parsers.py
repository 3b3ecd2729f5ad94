"""Document parsers over binary files: one row a page, from txt, docx, pptx and xlsx.

Result of parse(): path, status (ok, encrypted, error, unsupported, too_large), page_no (from 1; 0 where there
is no page), text. A file that can't be read gives one row of its status and never fails the job; a null or
empty file of a zip format is an error, an empty text file has one row without text. A file is the unit of
work; the size gate stands below the parser, so contents above it aren't sent to Python."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TXT_LINES, MAX_BYTES = 50, 60 << 20
#: The namespaces of the formats and the first bytes of an encrypted package.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
D = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"

Pages = Iterator[tuple[int, str]]


def _txt(data: bytes) -> Pages:
    for encoding in ("utf-8-sig", "gbk", "latin-1"):
        try:
            text = data.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    lines = text.splitlines()
    blocks = ("\n".join(lines[i : i + TXT_LINES]) for i in range(0, len(lines), TXT_LINES))
    yield from enumerate((b for b in blocks if b.strip()), 1)


def _paragraphs(root: ElementTree.Element, ns: str) -> list[str]:
    return ["".join(t.text or "" for t in p.iter(f"{ns}t")) for p in root.iter(f"{ns}p")]


def _rels(z: zipfile.ZipFile, part: str) -> list[tuple[str, str, str]]:
    """(id, kind, target part) of a part's relations; none if it has no such file."""
    folder, name = posixpath.split(part)
    at = f"{folder}/_rels/{name}.rels"
    if at not in z.namelist():
        return []
    full = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return [(r.get("Id"), r.get("Type", "").rsplit("/", 1)[-1], full(r.get("Target", ""))) for r in ElementTree.fromstring(z.read(at))]


def _docx(data: bytes) -> Pages:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = _paragraphs(ElementTree.fromstring(z.read("word/document.xml")), W)
    yield from enumerate((p for p in found if p.strip()), 1)


def _pptx(data: bytes) -> Pages:
    """Slides in the order of the presentation's list, whatever their files are called; a broken slide is an empty page."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        part = "ppt/presentation.xml"
        where = {i: t for i, _, t in _rels(z, part)}
        for n, slide in enumerate(ElementTree.fromstring(z.read(part)).iter(f"{P}sldId"), 1):
            try:
                at = where[slide.get(REL)]
                others = sorted(t for _, kind, t in _rels(z, at) if kind in ("notesSlide", "diagramData"))
                lines = [x for p in [at, *others] for x in _paragraphs(ElementTree.fromstring(z.read(p)), D) if x.strip()]
            except (KeyError, ElementTree.ParseError, zipfile.BadZipFile):
                lines = []
            yield n, "\n".join(lines)


def _xlsx(data: bytes) -> Pages:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")]
        where = {i: t for i, _, t in _rels(z, "xl/workbook.xml")}
        for n, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"), 1):
            cells = []
            for c in ElementTree.fromstring(z.read(where[sheet.get(REL)])).iter(f"{S}c"):
                v = c.findtext(f"{S}v") or ""
                cells.append("".join(t.text or "" for t in c.iter(f"{S}t")) if c.get("t") == "inlineStr" else shared[int(v)] if c.get("t") == "s" and v else v)
            yield n, " ".join(x for x in cells if x.strip())


#: By file type in lower case; further parsers may be added: bytes -> pairs (page number, text).
PARSERS: dict[str, Callable[[bytes], Pages]] = {"txt": _txt, "docx": _docx, "pptx": _pptx, "xlsx": _xlsx}


def parse_one(path: str, data: bytes | None) -> list[tuple[str, int, str | None]]:
    """(status, page_no, text) of one file."""
    ext = re.sub(r".*\.", "", path.lower())
    if ext not in PARSERS:
        return [("unsupported", 0, None)]
    data = data or b""
    if ext != "txt" and data.startswith(OLE):
        return [("encrypted", 0, None)]
    try:
        return [("ok", n, t) for n, t in PARSERS[ext](data)] or [("ok", 0, None)]
    except (KeyError, IndexError, ValueError, ElementTree.ParseError, zipfile.BadZipFile, NotImplementedError, RuntimeError):
        return [("error", 0, None)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "status", "page_no", "text"]
    for x in batches:
        for path, data in zip(x["path"], x["content"], strict=True):  # one file at a time in memory
            name = path.as_py()
            rows = parse_one(name, data.as_py())
            cols = zip(*((name, *r) for r in rows), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names)


def parse(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files(path, length, content), as Spark's binaryFile source gives them -> pages."""
    fits = F.col("length") <= max_bytes
    large = files.where(~fits).select("path", F.lit("too_large").alias("status"), F.lit(0).cast("long").alias("page_no"), F.lit(None).cast("string").alias("text"))
    return files.where(fits).select("path", "content").mapInArrow(_parse, "path string, status string, page_no long, text string").unionByName(large)


def scan(spark: SparkSession, root: str, exts: tuple[str, ...] = tuple(PARSERS)) -> DataFrame:
    """The files under root of the types asked for, lock files (~$name) left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*exts) & ~F.startswith(name, F.lit("~$")))
