"""From source files to comments and functions.

``parsed`` runs the lexer over a DataFrame of files, one Arrow pass and no
shuffle, and returns a row for each file with nested comments and functions;
``comments_of`` and ``functions_of`` explode them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions import fixed
from scholia.sources.config import MARK
from scholia.sources.languages import Language, language_of, steers_tools
from scholia.sources.lexer import Function, scan

_IMPORT = re.compile(fixed.IMPORT_LINE)
_GO_DECLARATION = re.compile(r"\s*(?:func|type|const|var|package)\b")
_CGO = re.compile(r"import\s+\"C\"")
_VISIBLE = re.compile(rb"[^\n]")
_QUOTES = re.compile(r"[rRuUbBfF]{0,3}(\"\"\"|'''|\"|')")
_OPENERS = ("/*!", "/**", "/*", "//!", "///", "//")

COMMENT = "struct<comment_ord:int,kind:string,attachment:string,text:string,content:string,start_line:int,end_line:int,col:int,attached_code:string,in_function:boolean,function_name:string,is_directive:boolean>"
FUNCTION = "struct<fn_ord:int,name:string,start_line:int,end_line:int,body_line_count:int>"
PARSED = f"file_ord int, path string, rel string, lang string, code_line_count int, comment_line_count int, comments array<{COMMENT}>, functions array<{FUNCTION}>"


def _trimmed(rows: list[str]) -> str:
    filled = [k for k, r in enumerate(rows) if r]
    return "\n".join(rows[filled[0] : filled[-1] + 1]) if filled else ""


def plain(text: str, marker: str = "//") -> str:
    """A comment's own words: one marker off each line, blank edges off the whole."""

    def bare(line: str) -> str:
        line = line.strip()
        if marker == "#":
            return line.removeprefix("#").strip()
        opener = next((o for o in _OPENERS if line.startswith(o)), None)
        if opener:
            line = line[len(opener) :]
        elif line.startswith("*") and not line.startswith("*/"):
            line = line[1:]
        return line.removesuffix("*/").strip()

    return _trimmed([bare(x) for x in text.splitlines()])


def plain_docstring(text: str) -> str:
    m = _QUOTES.match(text)
    body = text[m.end() :].removesuffix(m[1]) if m else text
    return _trimmed([x.strip() for x in body.splitlines()])


class _File:
    """One file's bytes as rows, with what the lexer found in it."""

    def __init__(self, text: str, language: Language, mark: str):
        self.data = text.removeprefix("\ufeff").encode("utf-8", "replace")
        self.language, self.mark = language, mark
        s = self.data.decode("latin-1")
        comments, self.functions, docs, _ = scan(s, language)
        self.starts = [0, *(m.end() for m in re.finditer("\n", s))]
        self.rows = self.data.split(b"\n")
        self.found = sorted([(t.start, t.end, None) for t in comments] + [(d.start, d.end, d) for d in docs], key=lambda x: x[0])
        masked = bytearray(self.data)
        held: set[int] = set()
        for a, b, _ in self.found:
            masked[a:b] = _VISIBLE.sub(b" ", masked[a:b])
            held.update(range(self.row(a), self.row(b) + 1))
        self.comment_rows = len(held)
        self.code_rows = [r.rstrip(b"\r").decode("utf-8", "replace") for r in bytes(masked).split(b"\n")]
        self.with_code = {k for k, r in enumerate(bytes(masked).split(b"\n")) if r.strip()}
        self.first_code = min(self.with_code, default=None)
        self.begins = [f.start for f in self.functions]
        self.outer: list[int] = []  # the function around each function, or -1
        for k, f in enumerate(self.functions):
            around = k - 1
            while around >= 0 and self.functions[around].end <= f.start:
                around = self.outer[around]
            self.outer.append(around)

    def row(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def line(self, row: int) -> str:
        return self.rows[row].rstrip(b"\r").decode("utf-8", "replace").strip() if row < len(self.rows) else ""

    def before(self, at: int) -> str:
        return self.data[self.starts[self.row(at)] : at].decode("utf-8", "replace").strip()

    def after(self, at: int) -> str:
        row = self.row(at)
        end = self.starts[row + 1] if row + 1 < len(self.starts) else len(self.data)
        return self.data[at:end].decode("utf-8", "replace").strip()

    def inner(self, at: int) -> Function | None:
        """The innermost function around a position."""
        k = bisect_right(self.begins, at) - 1
        while k >= 0 and self.functions[k].end <= at:
            k = self.outer[k]
        return self.functions[k] if k >= 0 else None


def _doc_prefix(text: str, language: Language) -> str:
    return next((p for p in language.doc_lines if text.startswith(p)), "")


def _grouped(file: _File) -> list[list[tuple]]:
    """Line comments that continue one another: same column, next row, same nature, no code before them."""
    language, groups, previous = file.language, [], None
    for a, b, doc in file.found:
        text = file.data[a:b].decode("utf-8", "replace").rstrip("\r\n")
        row, column = file.row(a), a - file.starts[file.row(a)]
        nature = None
        if doc is None and text.startswith(language.line) and not file.before(a):
            own = plain(text.splitlines()[0] if text else "", language.line)
            nature = (column, _doc_prefix(text, language), steers_tools(own, language.name, False), own.startswith(file.mark))
        item = (a, b, doc, text)
        if nature is not None and previous == (row - 1, nature):
            groups[-1].append(item)
        else:
            groups.append([item])
        previous = (file.row(b), nature) if nature is not None else None
    return groups


def _attached(file: _File, group: list[tuple], text: str) -> tuple[str, str]:
    """(attachment, attached code) of a comment that is no docstring."""
    a, b = group[0][0], group[-1][1]
    if code := file.before(a):
        return "trailing", code
    if code := file.after(b):
        return "preceding", code
    if text.startswith(("//!", "/*!")):
        return "file_header", ""
    below = file.row(b) + 1
    follows = below in file.with_code
    if (file.first_code is None or file.row(a) < file.first_code) and (not follows or _IMPORT.match(file.line(below))):
        return "file_header", ""
    return ("preceding", file.line(below)) if follows else ("floating", "")


def _kind(text: str, language: Language) -> str:
    if text.startswith(language.doc_blocks) and not text.startswith("/**/") or _doc_prefix(text, language):
        return "doc"
    return "block" if text.startswith("/*") else "line"


def _comment(file: _File, group: list[tuple]) -> dict:
    language = file.language
    a, b, doc, text = group[0]
    b = group[-1][1]
    inner = file.inner(a if doc is None else doc.place) if doc is None or doc.place >= 0 else None
    out = {
        "text": "\n".join(x[3] for x in group), "start_line": file.row(a) + 1, "end_line": file.row(b) + 1, "col": a - file.starts[file.row(a)],
        "in_function": inner is not None, "function_name": inner.name if inner else "", "is_directive": False,
    }
    if doc is not None:
        module = doc.owner == "module"
        return out | {"kind": "doc", "attachment": "file_header" if module else "preceding", "attached_code": "" if module else file.line(doc.row), "content": plain_docstring(text)}
    whole = out["text"]
    attachment, code = _attached(file, group, whole)
    kind = _kind(whole, language)
    if language.name == "go" and kind != "doc" and attachment in ("preceding", "file_header") and not inner and _GO_DECLARATION.match(file.line(file.row(b) + 1)):
        kind = "doc"
    content = plain(whole, language.line)
    filled = [x for x in content.splitlines() if x.strip()]
    directive = bool(filled) and steers_tools(filled[0], language.name, kind != "line") and (kind == "line" or len(filled) == 1)
    cgo = language.name == "go" and _CGO.match(code.strip()) is not None
    return out | {"kind": kind, "attachment": attachment, "attached_code": code, "content": content, "is_directive": directive or cgo}


def extract(text: str, language: Language, mark: str = MARK) -> dict:
    """Comments, functions and line counts of one source text."""
    file = _File(text, language, mark)
    comments = [_comment(file, g) | {"comment_ord": k} for k, g in enumerate(_grouped(file))]
    functions = [
        {"fn_ord": k, "name": f.name, "start_line": file.row(f.start) + 1, "end_line": file.row(max(f.end - 1, f.start)) + 1, "body_line_count": file.row(max(f.body_end - 1, f.body_start)) - file.row(f.body_start) + 1}
        for k, f in enumerate(f for f in file.functions if f.spoken)
    ]
    return {"comments": comments, "functions": functions, "code_line_count": len(file.with_code), "comment_line_count": file.comment_rows, "code_lines": file.code_rows}


def fingerprint(text: str, language: Language) -> list[str]:
    """Code without comments and blank lines: equal for texts that differ in comments only."""
    return [x.rstrip() for x in extract(text, language)["code_lines"] if x.strip()]


def decoded(content: bytes | None) -> str:
    return (content or b"").decode("utf-8-sig", "replace")


_ARROW = {
    "comments": pa.list_(
        pa.struct(
            [("comment_ord", pa.int32()), ("kind", pa.string()), ("attachment", pa.string()), ("text", pa.string()), ("content", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("col", pa.int32()),
             ("attached_code", pa.string()), ("in_function", pa.bool_()), ("function_name", pa.string()), ("is_directive", pa.bool_())]
        )
    ),
    "functions": pa.list_(pa.struct([("fn_ord", pa.int32()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("body_line_count", pa.int32())])),
}
_SCHEMA = pa.schema([("file_ord", pa.int32()), ("path", pa.string()), ("rel", pa.string()), ("lang", pa.string()), ("code_line_count", pa.int32()), ("comment_line_count", pa.int32()), *_ARROW.items()])


def parsed(files: DataFrame, mark: str = MARK, batch: int = 64, code: bool = False) -> DataFrame:
    """Files (file_ord, path, rel, content) as rows of ``PARSED``; paths of other languages are left out.

    ``code`` adds ``code_lines``: all lines with comments blanked, about as large as the files.
    """
    schema = _SCHEMA.append(pa.field("code_lines", pa.list_(pa.string()))) if code else _SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ord_, path, rel, content in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                language = language_of(path)
                if language is not None:
                    rows.append({"file_ord": ord_, "path": path, "rel": rel, "lang": language.name} | extract(decoded(content), language, mark))
                if len(rows) >= batch:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select(F.col("file_ord").cast("int"), "path", "rel", F.col("content").cast("binary")).mapInArrow(run, PARSED + ", code_lines array<string>" * code)


def comments_of(files: DataFrame) -> DataFrame:
    names = ("kind", "attachment", "text", "content", "start_line", "end_line", "col", "attached_code", "in_function", "function_name", "is_directive")
    rows = files.select("path", "lang", F.explode("comments").alias("c"))
    return rows.select("path", "c.comment_ord", "lang", *(f"c.{n}" for n in names))


def functions_of(files: DataFrame) -> DataFrame:
    return files.select("path", F.inline("functions"))
