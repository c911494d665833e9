from __future__ import annotations

import base64
import gzip
import hashlib
import html.parser
import time
from pathlib import Path

import pytest

from scholia.llm import warc

PAGE = """<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>A &amp; B</title><style>p{}</style>
<script>var t="</p>";</script></head><body><!-- ad --><nav><a href="/x?a=1&amp;b=2">one</a><a href='/y'>two</a></nav>
<p>Caf&eacute; &lt;b&gt;   here<br>next <b>bold</b>line</p><table><tr><td>1</td><td>2</td></tr></table><script>x"""


class Visible(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.hidden, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


class Reference(html.parser.HTMLParser):
    """Title, language, links and visible text by the standard library's parser."""

    HIDING = ("script", "style", "head", "noscript", "template", "svg")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.out, self.links, self.title, self.lang, self.in_title = 0, [], [], "", "", False

    def handle_starttag(self, tag, attrs):
        own = dict(reversed(attrs))
        self.hidden += tag in self.HIDING
        self.in_title = tag == "title"
        if tag == "a" and " ".join((own.get("href") or "").split()):
            self.links.append(" ".join(own["href"].split()))
        if tag == "html":
            self.lang = (own.get("lang") or "").lower()

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDING
        self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.out.append(data)


def test_text_of_a_page():
    assert warc.plain_text(PAGE) == "onetwo\nCafé <b> here\nnext boldline\n1 2"
    clean = "<html><head><title>t</title></head><body><p>a &amp; b</p><div>c<span>d</span></div></body></html>"
    parsed = Visible()
    parsed.feed(clean)
    assert "".join(warc.plain_text(clean).split()) == "".join("".join(parsed.out).split())


def test_records_are_linked_and_digests_hold(spark):
    rows = [(1, "http://a/", PAGE), (2, None, None), (None, "http://b/", ""), (1, "http://a/", PAGE), (3, "http://c/", "no markup at all")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as headers", "'y' as block")
    got = warc.build(pages).collect()
    assert len(got) == 3 * len(rows)
    responses = {r.record_id for r in got if r.warc_type == "response"}
    assert len(responses) == 4
    for r in got:
        h = {x.name: x.value for x in r.headers}
        assert h["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r.block).digest()).decode()
        assert int(h["Content-Length"]) == len(r.block) and h["WARC-Record-ID"] == r.record_id
        assert ("WARC-Target-URI" in h) == (r.url is not None)
        if r.warc_type != "response":
            assert r.refers_to in responses and h["WARC-Refers-To"] == r.refers_to
    by = {(r.page_id, r.warc_type): bytes(r.block).decode() for r in got}
    assert "title: A & B\r\nlanguage: fr\r\n" in by[1, "metadata"] and "outlink: /x?a=1&b=2\r\n" in by[1, "metadata"]
    assert "httpHeader: Content-Type: text/html; charset=utf-8\r\n" in by[1, "metadata"]
    assert "sourceHeader: WARC-Type: response\r\n" in by[1, "metadata"]
    assert by[2, "conversion"] == "" and by[3, "conversion"] == "no markup at all"
    report = warc.report(pages)
    assert report.count() == 2 * len(rows) and report.filter("content_length <> octet_length(content)").count() == 0
    assert warc.report(pages.limit(0)).count() == 0


def test_files_round_trip(spark, tmp_path):
    records = [r for k in range(3) for r in warc.derivatives(k, f"http://h/{k}", PAGE * k)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.record_bytes(r) for r in records))
    got = {r.record_id: r for r in warc.read_records(spark, str(tmp_path)).collect()}
    assert len(got) == len(records)
    for r in records:
        back = got[r["record_id"]]
        assert bytes(back.block) == r["block"] and back.refers_to == r["refers_to"] and [(h.name, h.value) for h in back.headers] == r["headers"]


def test_pages_without_optional_end_tags_keep_their_text():
    assert warc.plain_text("<html><head><title>t</title><body><p>Hello world</p><p>more</p></html>") == "Hello world\nmore"
    assert warc.plain_text("<head><meta charset=x><title>t</title><p>Hello <b>you</b>") == "Hello you"
    assert warc.plain_text("<p>a</p><svg viewBox='0 0 1 1'/><p>b</p><svg><text>x</text><svg/></svg><p>c") == "a\nb\nc"
    assert warc.plain_text("<p>a</p><noscript><p>b</p><template>") == "a\nb"
    assert warc.plain_text("<p>a<template>x<template>y</template>z</template>b</p><head>") == "a b"
    assert warc.plain_text("<p>a<script>b</p>") == "a"


DATA = Path("/root/testdata/sf0.01/pages.parquet")


@pytest.mark.skipif(not DATA.is_file(), reason="needs the driver's tables")
def test_every_page_agrees_with_a_parser(spark):
    pages = {r.page_id: r for r in spark.read.parquet(str(DATA)).collect()}
    rows = warc.report(spark.read.parquet(str(DATA))).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        parser = Reference()
        parser.feed(pages[r.page_id].html)
        parser.close()
        if r.warc_type == "conversion":
            assert "".join(r.content.split()) == "".join("".join(parser.out).split())
        else:
            fields = [x.split(": ", 1) for x in r.content.split("\r\n") if ": " in x]
            assert [v for k, v in fields if k == "outlink"] == list(dict.fromkeys(parser.links))
            want = " ".join(parser.title.split())
            assert dict(fields).get("title", "") == want and dict(fields).get("language", "") == parser.lang


def response(body, head="Content-Type: text/html", record="<urn:uuid:1>", more=()):
    block = b"HTTP/1.1 200 OK\r\n" + head.encode() + b"\r\nServer: s\r\n\r\n" + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record), ("WARC-Date", "2020-02-03T04:05:06Z"), ("WARC-Target-URI", "http://h/p"), *more, ("Content-Length", str(len(block)))]
    return {"headers": headers, "block": block}


def test_derivatives_of_files(spark, tmp_path):
    """What a response of a file says of itself stays in the records derived from it."""
    page = "<html lang=de><title>T</title><p>Gr\u00fc\u00dfe<a href=/x>l</a>"
    packed = gzip.compress(page.encode())
    chunked = b"%x\r\n" % 10 + page.encode()[:10] + b"\r\n%x\r\n" % (len(page.encode()) - 10) + page.encode()[10:] + b"\r\n0\r\n\r\n"
    made = [
        response(page.encode(), record="<urn:a>", more=[("WARC-Payload-Digest", "sha1:GIVEN"), ("WARC-IP-Address", "1.2.3.4")]),
        response(page.encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1", "<urn:b>"),
        response(packed, "Content-Type: text/html\r\nContent-Encoding: gzip", "<urn:c>"),
        response(chunked, "Content-Type: text/html\r\nTransfer-Encoding: chunked", "<urn:d>"),
        response(b"\x89PNG", "Content-Type: image/png", "<urn:e>"),
        response(b"a <b", "Content-Type: text/plain", "<urn:f>"),
        response(b"xx", "Content-Type: text/html\r\nContent-Encoding: br", "<urn:g>"),
        response(page.replace("<title>", "<meta charset=latin-1><title>").encode("latin-1"), record="<urn:h>"),
    ]
    other = {"headers": [("WARC-Type", "request"), ("WARC-Record-ID", "<urn:q>"), ("Content-Length", "1")], "block": b"x"}
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.record_bytes(r) for r in [*made, other]))
    rows = warc.derivatives_of(warc.read_records(spark, str(tmp_path))).collect()
    by = {(r.refers_to, r.warc_type): r for r in rows}
    assert len(rows) == len(by) == 14
    text = {k: bytes(r.block).decode() for k, r in by.items()}
    for name in "abcdh":
        assert text[f"<urn:{name}>", "conversion"] == "Gr\u00fc\u00dfel", name
        assert "title: T\r\nlanguage: de\r\n" in text[f"<urn:{name}>", "metadata"] and "outlink: /x\r\n" in text[f"<urn:{name}>", "metadata"]
    assert text["<urn:f>", "conversion"] == "a <b"
    assert not {("<urn:e>", "conversion"), ("<urn:g>", "conversion")} & set(by)
    for (source, _), r in by.items():
        h = {x.name: x.value for x in r.headers}
        assert h["WARC-Refers-To"] == source and h["WARC-Refers-To-Date"] == h["WARC-Date"] == "2020-02-03T04:05:06Z"
        assert h["WARC-Refers-To-Target-URI"] == h["WARC-Target-URI"] == r.url == "http://h/p"
        assert h["WARC-Block-Digest"] == warc.digest(bytes(r.block)) and int(h["Content-Length"]) == len(r.block)
    get = lambda name: {x.name: x.value for x in by[f"<urn:{name}>", "metadata"].headers}["WARC-Source-Payload-Digest"]
    assert get("a") == "sha1:GIVEN" and get("c") == warc.digest(packed)
    assert "sourceHeader: WARC-IP-Address: 1.2.3.4\r\n" in text["<urn:a>", "metadata"] and "httpHeader: Server: s\r\n" in text["<urn:a>", "metadata"]
    again = {r.record_id for r in warc.derivatives_of(warc.read_records(spark, str(tmp_path))).collect()}
    assert again == {r.record_id for r in rows} and len(again) == 14


def test_broken_files_do_not_stop_reading():
    good = warc.record_bytes(response(b"one"))
    plain = gzip.decompress(good)
    assert [b[-3:] for _, b in warc.parse(plain * 3)] == [b"one"] * 3
    assert [b[-3:] for _, b in warc.parse(good * 3)] == [b"one"] * 3
    assert len(list(warc.parse(plain + b"WARC/1.1\r\nWARC-Type: x\r\n\r\nabc\r\n" + plain))) == 2  # no length
    assert len(list(warc.parse(plain + b"WARC/1.1\r\nContent-Length: -4\r\n\r\nabc" + plain))) == 2
    assert len(list(warc.parse(plain + b"WARC/1.1\r\nContent-Le"))) == 1  # a header that is cut off
    assert [len(b) for _, b in warc.parse(plain[:-10])] == [len(response(b"one")["block"]) - 6]
    assert len(list(warc.parse(good + good[:20]))) == 1
    assert len(list(warc.parse(good + b"\x1f\x8bgarbage"))) == 1
    assert list(warc.parse(b"")) == [] and list(warc.parse(b"nothing here")) == []
    big = warc.record_bytes(response(b"y" * 3_000_000))
    assert [len(b) > 2_999_999 for _, b in warc.parse(big * 2 + good)] == [True, True, False]


def test_hostile_markup_takes_linear_time():
    for part in ("<a ", "<a href='", '<a b="', "<", "</", "<!--", "<!", "<title", "<title>", "<script>", "<svg>", "<head>", "&", "<a =", "<p/", "<a b=\"c\"'"):
        page = part * (400_000 // len(part))
        began = time.perf_counter()
        warc.derivatives(1, "u", page)
        assert time.perf_counter() - began < 3, part
