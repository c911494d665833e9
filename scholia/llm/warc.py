"""WARC derivatives: responses to linked metadata and plain-text conversion records.

``derivatives_of`` takes the records of WARC files, as ``read_records`` gives
them, and derives two records from each response. The metadata record
(warc-fields) holds the response's own WARC and HTTP headers, title, language,
charset and outlinks; the conversion record holds the visible text of HTML and
plain text. Both carry the response's id in WARC-Refers-To, its target URI and
date, its payload digest as WARC-Source-Payload-Digest, and digests of their own
blocks. Record ids are name-based UUIDs of the source's id and the record type, so
reruns agree. ``build`` first makes response records of a table of pages and
derives from these in the same way. One Arrow pass, no shuffle; a response's size
bounds a task's memory beyond its batch.

HTML is read by one scan from tag to tag, as the standard's tokenizer does; what
a scan has passed is not read again, so time is linear for any markup.

Digests are ``sha1:`` and base 32, as in WARC/1.1. ``record_bytes`` writes a
record as a gzip member, so records can be stored as ``.warc.gz`` and come back
unchanged. Files are inflated a record at a time.

Defined results for odd input: null html is an empty payload, with an empty
conversion; a null url leaves out WARC-Target-URI; a null page id is part of the
name as it stands, so rows with equal id, url and html share their record ids;
repeated rows repeat their records; other columns are not read. A response
without an HTTP header has its whole block as payload; one whose encoding is
unknown or broken, or that is neither HTML nor text, has metadata but no
conversion. A response without a record id refers to nothing. In files, a record
that is cut off keeps what is there; one without a length, or with a wrong one,
is left out and reading goes on at the next record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import small_batches

DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-records")

# --- HTML --------------------------------------------------------------------

#: A tag from its "<". Quotes count after "=" only; no part is tried twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>")
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?")
#: Elements whose content is no markup, and the end of each.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")}
_SHOWN_RAW = {"textarea", "xmp"}
#: Elements whose content is not text, if they end.
_HIDING = {"noscript", "template", "svg"}
_IN_HEAD = {"title", "meta", "link", "base", "basefont", "bgsound", "noframes", "script", "style", "noscript", "template", "head"}
_BLOCKS = set("p div article section header footer nav main aside ul ol li table tr h1 h2 h3 h4 h5 h6 blockquote pre form figure dl dt dd br hr".split())


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes or content) of a page: text, start, end; raw elements are a start with their content."""
    at = 0
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            break
        following = page[lt + 1 : lt + 2]
        if following not in ("/", "!", "?") and not (following.isascii() and following.isalpha()):
            yield "text", page[at : lt + 1], ""
            at = lt + 1
            continue
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)  # "<!-->" is a whole comment
            at = len(page) if end < 0 else end + 3
            yield "comment", "", ""
            continue
        m = _TAG.match(page, lt)
        if not m:
            # Markup declarations and the like end at ">"; a tag without an end takes the rest.
            end = page.find(">", lt) if following in "!?" or (following == "/" and not page[lt + 2 : lt + 3].isalpha()) else -1
            if end < 0:
                return
            at = end + 1
            yield "comment", "", ""
            continue
        name, at = m[2].lower(), m.end()
        if not m[1] and name in _RAW:
            end = _RAW[name].search(page, at)
            yield "start", name, m[3]
            yield "raw", name, page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
            yield "end", name, ""
        else:
            yield ("end" if m[1] else "start"), name, m[3]
    if at < len(page):
        yield "text", page[at:], ""


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag, the first of a name."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        value = value[1:-1] if value[:1] in "\"'" and len(value) > 1 and value[-1] == value[0] else value
        out.setdefault(name.lower(), entities.unescape(value))
    return out


def _spaced(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


class Page:
    """What the derived records say of an HTML page: title, language, charset, links, text."""

    def __init__(self, page: str):
        self.title, self.language, self.charset, self.links = "", "", "", []
        every = list(tokens(page))
        hidden = _hidden(every)
        out, in_head, seen_head, k = [], False, False, 0
        links: dict[str, None] = {}
        titled = False
        for k, (kind, name, more) in enumerate(every):
            if kind == "start":
                self._read(name, more, links)
                if name == "head" and not seen_head:
                    in_head = seen_head = True
                elif in_head and name not in _IN_HEAD:
                    in_head = False
            elif kind == "end" and in_head and name in ("head", "body", "html"):
                in_head = False
            elif kind == "raw" and name == "title" and not titled:
                titled, self.title = True, _spaced(entities.unescape(more))
            elif kind == "text" and in_head and not hidden[k] and name.strip():
                in_head = False
            if hidden[k]:
                out += [] if k and hidden[k - 1] else [" "]
                continue
            if kind == "text":
                out.append(name if not in_head else " ")
            elif kind == "raw" and name in _SHOWN_RAW:
                out.append(more)
            elif kind in ("raw", "comment"):
                out.append(" ")
            elif kind == "end" and name in ("td", "th"):
                out.append(" \t")
            elif name in _BLOCKS and kind in ("start", "end"):
                out.append("\n")
        self.links = list(links)
        lines = (_spaced(x) for x in entities.unescape("".join(out)).split("\n"))
        self.text = "\n".join(x for x in lines if x)

    def _read(self, name: str, more: str, links: dict[str, None]) -> None:
        if name not in ("a", "html", "meta"):
            return
        own = attributes(more)
        if name == "a" and (link := _spaced(own.get("href", ""))):
            links.setdefault(link)
        elif name == "html" and not self.language:
            self.language = _spaced(own.get("lang", "")).lower()
        elif name == "meta" and not self.charset:
            found = own.get("charset") or ("charset" in own.get("content", "").lower() and _parameter(own["content"], "charset")) or ""
            self.charset = _spaced(found).lower()


def _hidden(every: list[tuple[str, str, str]]) -> list[bool]:
    """Tokens inside elements whose content is not text; one that has no end hides nothing."""
    opened: dict[str, list[int]] = {}
    change = [0] * (len(every) + 1)
    for k, (kind, name, more) in enumerate(every):
        if name not in _HIDING:
            continue
        if kind == "start" and not (name == "svg" and more.rstrip().endswith("/")):
            opened.setdefault(name, []).append(k)
        elif kind == "end" and opened.get(name):
            change[opened[name].pop()] += 1
            change[k] -= 1
    out, depth = [], 0
    for k in range(len(every)):
        depth += change[k]
        out.append(depth > 0)
    return out


def plain_text(page: str) -> str:
    """Visible text: a line for each block, spaces collapsed, entities resolved."""
    return Page(page).text


# --- Records -----------------------------------------------------------------


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(kind: str, *parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(31).join([kind, *map(repr, parts)]))}>"


def _parameter(value: str, name: str) -> str:
    """A parameter of a header value such as a content type."""
    for part in value.split(";")[1:]:
        k, _, v = part.partition("=")
        if k.strip().lower() == name:
            return v.strip().strip("\"'")
    return ""


def _record(kind: str, own: str, date: str | None, url: str | None, more: list[tuple[str, str]], content_type: str, block: bytes) -> dict:
    headers = [("WARC-Type", kind), ("WARC-Record-ID", own)]
    headers += [("WARC-Date", date)] if date else []
    headers += [("WARC-Target-URI", _spaced(url))] if url is not None else []
    headers += [*more, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return {"url": url, "warc_type": kind, "record_id": own, "refers_to": dict(more).get("WARC-Refers-To"), "headers": headers, "block": block}


_CHUNK = re.compile(rb"\s*([0-9a-fA-F]+)[^\n]*\n")


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        size, at = int(m[1], 16), m.end()
        if not size:
            break
        out.append(body[at : at + size])
        at += size
    return b"".join(out) if out else body


def _http(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers, payload) of a response's block; a block without an HTTP status line is its own payload."""
    if not block.startswith(b"HTTP/"):
        return [], block
    ends = [(k, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (k := block.find(mark)) >= 0]
    at, width = min(ends, default=(len(block), 0))
    lines = block[:at].decode("utf-8", "replace").splitlines()[1:]
    headers = [(k.strip(), v.strip()) for k, colon, v in (x.partition(":") for x in lines) if colon]
    body = block[at + width :]
    if any(k.lower() == "transfer-encoding" and "chunked" in v.lower() for k, v in headers):
        body = _unchunked(body)
    return headers, body


def _decoded(payload: bytes, coding: str) -> bytes | None:
    """The payload without its content coding; None if it is unknown or broken."""
    for name in reversed([x.strip().lower() for x in coding.split(",") if x.strip()]):
        if name in ("gzip", "x-gzip", "deflate"):
            try:
                payload = zlib.decompressobj(47 if name != "deflate" else 15 if payload[:1] == b"\x78" else -15).decompress(payload)
            except zlib.error:
                return None
        elif name != "identity":
            return None
    return payload


def _text(content: bytes, charset: str) -> str:
    try:
        return content.decode(charset or "utf-8", "replace")
    except (LookupError, ValueError):
        return content.decode("utf-8", "replace")


def _derived(record: str | None, date: str | None, url: str | None, source: list[tuple[str, str]], block: bytes) -> list[dict]:
    """The metadata and the conversion record of a response."""
    http, payload = _http(block)
    get = {k.lower(): v for k, v in reversed(http)}
    given = {k.lower(): v for k, v in reversed(source)}
    kind = get.get("content-type", "").split(";")[0].strip().lower()
    content = _decoded(payload, get.get("content-encoding", ""))
    is_html = kind in ("text/html", "application/xhtml+xml") or (not kind and b"<" in (content or b"")[:1024])
    charset = _parameter(get.get("content-type", ""), "charset").lower()
    page = None
    if content is not None and is_html:
        first = Page(_text(content, charset or "utf-8"))
        # A page may name its charset itself; only then its text is decoded again.
        page = Page(_text(content, first.charset)) if not charset and first.charset not in ("", "utf-8", "utf8") else first
        charset = charset or first.charset
    body = given.get("warc-payload-digest") or digest(payload)
    links = [("WARC-Refers-To", record)] if record else []
    links += [("WARC-Refers-To-Date", date)] if date else []
    links += [("WARC-Refers-To-Target-URI", _spaced(url))] if url is not None else []
    links.append(("WARC-Source-Payload-Digest", body))
    fields = [("title", page.title if page else ""), ("language", page.language if page else ""), ("charset", charset or ("utf-8" if page else ""))]
    fields += [("sourceHeader", f"{k}: {v}") for k, v in source] + [("httpHeader", f"{k}: {v}") for k, v in http]
    fields += [("outlink", x) for x in (page.links if page else [])]
    meta = "".join(f"{k}: {_spaced(v)}\r\n" for k, v in fields).encode("utf-8", "replace")
    key = (record, url, date, body) if record is None else (record,)
    out = [_record("metadata", record_id("metadata", *key), date, url, links, "application/warc-fields", meta)]
    text = page.text if page else _text(content, charset) if content is not None and kind.startswith("text/") else None
    if text is not None:
        out.append(_record("conversion", record_id("conversion", *key), date, url, links, "text/plain;charset=utf-8", text.encode("utf-8", "replace")))
    return out


def derivatives(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> list[dict]:
    """The response, metadata and conversion records of one page of a table."""
    payload = (page or "").encode("utf-8", "replace")
    # The table's text is decoded already, so its bytes are UTF-8 whatever the page says.
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = record_id("response", page_id, url, hashlib.sha1(payload).hexdigest())
    response = _record("response", own, date, url, [("WARC-Payload-Digest", digest(payload))], "application/http;msgtype=response", http + payload)
    return [{"page_id": page_id, **r} for r in [response, *_derived(own, date, url, response["headers"], response["block"])]]


_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
        ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary()),
    ]
)
SCHEMA = "page_id bigint, url string, warc_type string, record_id string, refers_to string, headers array<struct<name:string,value:string>>, block binary"
_OWN = pa.schema([f for f in _SCHEMA if f.name != "page_id"])


#: Bytes of responses whose records leave a task together.
OUT_BYTES = 8_000_000


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    each = [{**r, "headers": [{"name": k, "value": v} for k, v in r["headers"]]} for r in rows]
    return pa.RecordBatch.from_pylist(each, schema=schema)


def _streamed(found: Iterator[tuple[int, list[dict]]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size from (bytes read, records)."""
    rows, held = [], 0
    for size, own in found:
        rows += own
        held += size
        if held > OUT_BYTES:
            yield _batch(rows, schema)
            rows, held = [], 0
    if rows:
        yield _batch(rows, schema)


def build(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Records of ``SCHEMA``, three for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = zip(*(b.column(k) for k in range(3)), strict=True)
            yield from _streamed(((len(h.as_py() or ""), derivatives(i.as_py(), u.as_py(), h.as_py(), date)) for i, u, h in each), _SCHEMA)

    small_batches(pages)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, SCHEMA)


def derivatives_of(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of the responses among ``records``, as ``read_records`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own(b: pa.RecordBatch) -> Iterator[tuple[int, list[dict]]]:
            for k in range(b.num_rows):
                record, headers, block = (b.column(c)[k].as_py() for c in range(3))
                source = [(h["name"] or "", h["value"] or "") for h in headers or []]
                get = {k.lower(): v for k, v in reversed(source)}
                yield len(block or b""), _derived(record, get.get("warc-date"), get.get("warc-target-uri"), source, block or b"")

        for b in batches:
            yield from _streamed(own(b), _OWN)

    small_batches(records)
    responses = records.filter("warc_type = 'response'").select("record_id", "headers", "block")
    return responses.mapInArrow(run, SCHEMA.split("bigint, ", 1)[1])


def header(name: str):
    """A header's value, as a column of ``build``'s rows."""
    return F.get(F.filter("headers", lambda h: h["name"] == name), F.lit(0))["value"]


def report(pages: DataFrame) -> DataFrame:
    """The derived records (metadata and conversion) with their links, digests and text."""
    rows = build(pages).filter("warc_type <> 'response'")
    return rows.select(
        "page_id", "url", "warc_type", "record_id", "refers_to", header("WARC-Block-Digest").alias("block_digest"),
        header("WARC-Source-Payload-Digest").alias("source_digest"), F.col("block").cast("string").alias("content"),
        F.length("block").cast("long").alias("content_length"),
        F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\r\n").alias("headers"),
    )


# --- Files -------------------------------------------------------------------


def record_bytes(record: dict) -> bytes:
    """One record as a gzip member."""
    headers = [(h["name"], h["value"]) if isinstance(h, dict) or hasattr(h, "asDict") else h for h in record["headers"]]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return gzip.compress(head.encode() + bytes(record["block"]) + b"\r\n\r\n", 6, mtime=0)


_STEP = 1 << 16


class _Source:
    """The bytes of a plain or gzipped file, inflated as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held = memoryview(data), 0, bytearray()
        self.zipped = data[:2] == b"\x1f\x8b"
        self.member = zlib.decompressobj(31) if self.zipped else None
        self.pending = b""

    def more(self) -> bool:
        """Reads on; False at the end, or where a member is broken."""
        if not self.zipped:
            part = self.data[self.at : self.at + _STEP]
            self.held += part
            self.at += len(part)
            return len(part) > 0
        while True:
            part = self.pending or bytes(self.data[self.at : self.at + _STEP])
            self.at += 0 if self.pending else len(part)
            self.pending = b""
            if not part:
                return False
            if self.member.eof:
                part = part.lstrip(b"\0")
                self.member = zlib.decompressobj(31)
                if not part:
                    continue
            try:
                out = self.member.decompress(part, 16 * _STEP)
            except zlib.error:
                self.at = len(self.data)
                return False
            self.pending = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if out:
                self.held += out
                return True

    def find(self, mark: bytes, at: int = 0) -> int:
        while (k := self.held.find(mark, at)) < 0:
            at = max(at, len(self.held) - len(mark) + 1)
            if not self.more():
                return -1
        return k

    def upto(self, n: int) -> bool:
        while len(self.held) < n:
            if not self.more():
                return False
        return True


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of a plain or gzipped WARC file, one at a time."""
    source = _Source(data)
    while (at := source.find(b"WARC/")) >= 0:
        del source.held[:at]
        end = source.find(b"\r\n\r\n")
        if end < 0:
            return
        lines = source.held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
        size = next((v for k, v in headers if k.lower() == "content-length"), "")
        if not (size.isascii() and size.isdigit()):
            del source.held[:5]  # not a record, or one without an end
            continue
        del source.held[: end + 4]
        source.upto(int(size))
        yield headers, bytes(source.held[: int(size)])
        del source.held[: int(size)]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(warc_type, record_id, refers_to, headers, block) of the WARC files under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([f for f in _SCHEMA if f.name not in ("page_id", "url")])

        def own(content: bytes) -> Iterator[tuple[int, list[dict]]]:
            for headers, block in parse(content):
                h = {k.lower(): v for k, v in reversed(headers)}
                yield len(block), [{"warc_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "refers_to": h.get("warc-refers-to"), "headers": headers, "block": block}]

        for b in batches:
            for content in b.column(0):
                yield from _streamed(own(content.as_py()), schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(run, SCHEMA.split("url string, ")[1])
