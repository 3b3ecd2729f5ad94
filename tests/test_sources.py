import io
import zipfile

from corpusql.sources import parsers as X

A = "http://schemas.openxmlformats.org/drawingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(*of: tuple[str, str, str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{R}/{k}" Target="{t}"/>' for i, k, t in of) + "</Relationships>"


def slide(*lines: str) -> str:
    return f'<s xmlns:a="{A}">' + "".join(f"<a:p><a:r><a:t>{x[:2]}</a:t></a:r><a:r><a:t>{x[2:]}</a:t></a:r></a:p>" for x in lines) + "</s>"


def deck() -> bytes:
    ns = X.P[1:-1]
    return package({
        "ppt/presentation.xml": f'<p:x xmlns:p="{ns}" xmlns:r="{R}"><p:sldId r:id="r2"/><p:sldId r:id="r1"/><p:sldId r:id="r9"/></p:x>',
        "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide("second"), "ppt/slides/slide2.xml": slide("first", "line"),
        "ppt/slides/_rels/slide2.xml.rels": rels(("n", "notesSlide", "../notesSlides/n1.xml")), "ppt/notesSlides/n1.xml": slide("a note"),
    })


def test_slides_follow_the_list_and_a_broken_one_is_empty():
    assert X.parse_one("a.PPTX", deck()) == [("ok", 1, "first\nline\na note"), ("ok", 2, "second"), ("ok", 3, "")]


def test_text_blocks_and_encodings():
    text = "\n".join(["x"] * 50 + [" "] * 50 + ["y"])
    assert [r[1:] for r in X.parse_one("a.txt", text.encode())] == [(1, "\n".join(["x"] * 50)), (2, "y")]
    assert X.parse_one("a.txt", "﻿ab".encode()) == [("ok", 1, "ab")]
    assert X.parse_one("a.txt", "算力".encode("gbk")) == [("ok", 1, "算力")]
    assert X.parse_one("a.txt", b"") == [("ok", 0, None)]


def test_documents_and_sheets():
    w, s = X.W[1:-1], X.S[1:-1]
    doc = package({"word/document.xml": f'<w:d xmlns:w="{w}"><w:p><w:t>ab</w:t><w:t>c</w:t></w:p><w:p/><w:tbl><w:p><w:t>cell</w:t></w:p></w:tbl></w:d>'})
    assert X.parse_one("a.docx", doc) == [("ok", 1, "abc"), ("ok", 2, "cell")]
    book = package({
        "xl/workbook.xml": f'<x xmlns="{s}" xmlns:r="{R}"><sheet r:id="r1"/></x>', "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/s.xml")),
        "xl/sharedStrings.xml": f'<x xmlns="{s}"><si><t>one</t></si></x>', "xl/worksheets/s.xml": f'<x xmlns="{s}"><c t="s"><v>0</v></c><c><v>2</v></c><c t="inlineStr"><is><t>in</t></is></c></x>',
    })
    assert X.parse_one("a.xlsx", book) == [("ok", 1, "one 2 in")]


def test_what_cannot_be_read_has_a_status():
    assert [X.parse_one(n, d)[0][0] for n, d in [("a.bin", b""), ("a.pptx", X.OLE + b"x"), ("a.docx", b"junk"), ("a.pptx", None)]] == ["unsupported", "encrypted", "error", "error"]


def test_scan_and_parse(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in [("a.txt", b"one"), ("in/b.pptx", deck()), ("~$c.txt", b"lock"), ("d.exe", b""), ("big.txt", b"z" * 9000)]:
        (tmp_path / name).write_bytes(data)
    got = {(r.path.rsplit("/", 1)[-1], r.status, r.page_no) for r in X.parse(X.scan(spark, str(tmp_path)), max_bytes=8000).collect()}
    assert got == {("a.txt", "ok", 1), ("b.pptx", "ok", 1), ("b.pptx", "ok", 2), ("b.pptx", "ok", 3), ("big.txt", "too_large", 0)}
