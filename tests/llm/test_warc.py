import base64
import gzip
import hashlib
import time

import pytest

from corpusql.llm.warc import derivatives, fields, from_warc, plain_text, read_responses, responses, warc_blocks

PAGE = '<!DOCTYPE html><html lang="FR"><head><title>A &amp; B\n c</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/x">x</a> <a href=\'y?a=1&amp;b\'>y</a></nav><!-- gone <p> --><p>One <b>two</b>&nbsp;three<br>four</p><div title="a>b">&lt;five&gt; 漢</div></body></html>'


def test_plain_text():
    assert plain_text(PAGE) == "x y\nOne two three\nfour\n<five> 漢"
    assert plain_text(None) == plain_text("") == plain_text("<p></p><!-- open") == ""
    assert plain_text("a < b and c") == "a < b and c"


def test_records_link_and_round_trip(spark):
    rows = [(1, "http://a/", PAGE), (2, None, None), (3, "http://b/", ""), (1, "http://a/", PAGE)]
    r = responses(spark.createDataFrame(rows, "page_id long, url string, html string"))
    source = {x.page_id: x for x in r.collect()}
    out = derivatives(r)
    got = out.collect()
    assert len(got) == 8 and len({x.record_id for x in got}) == 6
    for x in got:
        s = source[x.page_id]
        assert x.refers_to == s.record_id and x.target_uri == s.target_uri and x.source_headers == s.http_headers
        assert x.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(s.payload.encode()).digest()).decode()
    meta = next(x.content for x in got if x.page_id == 1 and x.warc_type == "metadata")
    assert meta.split("\r\n") == ["title: A & B c", "language: fr", "source-status: HTTP/1.1 200 OK", "source-header: Content-Type: text/html; charset=utf-8", f"source-header: Content-Length: {len(PAGE.encode())}", "outlink: /x", "outlink: y?a=1&b", ""]
    back = list(from_warc(b"".join(bytes(x.warc) for x in warc_blocks(out).collect())))
    assert sorted((h["warc-record-id"], h["warc-refers-to"], h.get("warc-target-uri"), b.decode()) for h, b in back) == sorted((x.record_id, x.refers_to, x.target_uri, x.content) for x in got)
    for h, b in back:
        assert h["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert base64.b64decode(h["x-source-headers"]).decode().startswith("HTTP/1.1 200 OK")
    assert derivatives(r.limit(0)).collect() == []


def test_a_page_survives_tags_that_are_not_closed():
    assert plain_text("<html><head><title>t</title><body><p>all the text</p>") == "all the text"
    assert plain_text("<head lang=en><meta a='>'><link x><!-- c --><style>p{}</style>\n<script>a</script><p>one<p>two") == "one\ntwo"
    assert plain_text("<head><title>t</title><body><p>one</p><script>x='</head>'</script><p>two") == "one\ntwo"
    assert plain_text("<head><title>t</title>words stand in no head") == "words stand in no head"
    for tag in ("noscript", "template", "svg"):
        assert plain_text(f"<p>one<{tag} a='b'>two<p>three") == "onetwo\nthree"
        assert plain_text(f"<p>one<{tag}>gone</{tag} >two") == "onetwo"
    assert plain_text("<p>one<svg a='b'/>two<svg>gone</svg>three") == "onetwothree"
    assert plain_text("<p>one<script>gone") == "one" and plain_text("<header>top</header>x") == "top\nx"


def test_hostile_pages_take_one_pass():
    for piece in ("<a ", "<a href='", "<svg>", "<noscript>", "<title>", "<!x", "<a \"x\" '", "<", "<!-- ", "<script>", "</p", "<a href=x "):
        page = piece * (3_000_000 // len(piece))
        began = time.process_time()
        plain_text(page), fields(page, "")
        assert time.process_time() - began < 30, piece


def test_reads_warc_files(spark, tmp_path):
    def record(kind, block, *heads):
        return b"WARC/1.0\r\n" + b"".join(h + b"\r\n" for h in (b"WARC-Type: " + kind, b"content-length:%d" % len(block), *heads)) + b"\r\n" + block + b"\r\n\r\n"

    body = PAGE.encode()
    right = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Long: a\r\n b\r\n\r\n"
    one = record(b"warcinfo", b"x: y\r\n") + record(b"response", http + body, b"WARC-Record-ID: <urn:a>", b"WARC-Target-URI: http://a/", b"WARC-Date: 2020-01-01T00:00:00Z", b"WARC-Payload-Digest: " + right.encode(), b"no colon here", b"Folded: a", b"  b")
    two = record(b"response", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>\xe9", b"WARC-Record-ID: <urn:b>", b"WARC-Payload-Digest: sha1:AAAA") + record(b"request", b"GET / HTTP/1.1\r\n\r\n")
    three = record(b"response", b"", b"WARC-Record-ID: <urn:c>") + record(b"response", b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=none\r\n\r\ngone", b"WARC-Record-ID: <urn:d>")
    (tmp_path / "a.warc").write_bytes(one)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (two, three)))
    r = read_responses(spark, str(tmp_path))
    got = {x.record_id: x for x in r.collect()}
    assert sorted(got) == ["<urn:a>", "<urn:b>", "<urn:c>", "<urn:d>"]
    assert got["<urn:a>"].payload == PAGE and got["<urn:a>"].digest_ok and got["<urn:a>"].http_headers.startswith("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Long")
    assert got["<urn:b>"].payload == "<p>é" and got["<urn:b>"].digest_ok is False and got["<urn:c>"].payload == "" and got["<urn:c>"].digest_ok is None and got["<urn:d>"].payload == "gone"
    made = derivatives(r.selectExpr("cast(1 as bigint) as page_id", "*")).collect()
    assert {(x.refers_to, x.warc_type) for x in made} == {(k, t) for k in got for t in ("metadata", "conversion")}
    assert next(x.content for x in made if x.refers_to == "<urn:b>" and x.warc_type == "conversion") == "é"
    with pytest.raises(ValueError):
        list(from_warc(b"no warc at all\r\n\r\n"))
