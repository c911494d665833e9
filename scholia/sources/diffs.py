"""Unified diffs: parsing, and the old text from the new one.

A diff is read as a stream of lines by a small machine that knows, inside a hunk,
how many old and new lines are still due. Lines end at \\n only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scholia.sources.config import UsageError

_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_SECTION = re.compile(r"diff --git (\S+) (\S+)\Z")
_ESCAPE = re.compile(rb"\\([0-7]{3}|.)", re.S)
#: Prefixes of paths in diffs of git, and in plain ones.
GIT_PREFIXES = ("a/", "b/", "c/", "i/", "w/", "o/")
PLAIN_PREFIXES = ("a/", "b/")

PATCHES = (
    "patch_ord int, old_path string, new_path string, binary boolean, "
    "hunks array<struct<old_start:int,new_start:int,old_lines:array<string>,new_lines:array<string>>>"
)


@dataclass
class Hunk:
    old_start: int
    new_start: int
    old_lines: list[str] = field(default_factory=list)
    new_lines: list[str] = field(default_factory=list)


@dataclass
class Patch:
    """One file's change; a path is None where that side does not exist."""

    old_path: str | None = None
    new_path: str | None = None
    hunks: list[Hunk] = field(default_factory=list)
    binary: bool = False


def unquoted(name: str) -> str:
    """A path as git quotes it: C escapes, octal for bytes."""

    def byte(m: re.Match) -> bytes:
        e = m[1]
        return bytes([int(e, 8) & 255]) if len(e) == 3 else {b"n": b"\n", b"t": b"\t", b'"': b'"', b"\\": b"\\"}.get(e, m[0])

    return _ESCAPE.sub(byte, name[1:-1].encode("utf-8")).decode("utf-8", "replace")


def clean_path(name: str, git: bool) -> str | None:
    name = name.partition("\t")[0].strip()
    if len(name) >= 2 and name[0] == name[-1] == '"':
        name = unquoted(name)
    if name in ("", "/dev/null"):
        return None
    prefix = next((p for p in (GIT_PREFIXES if git else PLAIN_PREFIXES) if name.startswith(p)), "")
    return name[len(prefix) :]


class _Reader:
    def __init__(self):
        self.patches: list[Patch] = []
        self.git = False
        self.has_old = False
        self.due = [0, 0]

    @property
    def last(self) -> Patch | None:
        return self.patches[-1] if self.patches else None

    def inside(self, line: str) -> None:
        tag, rest = line[:1], line[1:]
        if tag == "\\":
            return
        sides = {"": (1, 1), " ": (1, 1), "-": (1, 0), "+": (0, 1)}.get(tag)
        if sides is None:
            raise UsageError(f"cannot read the diff: a hunk holds {line!r}")
        hunk = self.last.hunks[-1]
        for k, rows in enumerate((hunk.old_lines, hunk.new_lines)):
            if sides[k]:
                rows.append(rest)
                self.due[k] -= 1

    def outside(self, line: str) -> None:
        if line.startswith("diff --git "):
            m = _SECTION.match(line)
            self.patches.append(Patch(*(clean_path(m[k], True) for k in (1, 2))) if m else Patch())
            self.git, self.has_old = True, False
        elif line.startswith("--- "):
            if self.last is None or self.last.hunks or self.has_old:
                self.patches.append(Patch())
                self.git = False
            self.last.old_path, self.has_old = clean_path(line[4:], self.git), True
        elif line.startswith("@@") and (m := _HUNK.match(line)):
            if self.last is None:
                raise UsageError(f"cannot read the diff: no file is named before {line!r}")
            self.last.hunks.append(Hunk(int(m[1]), int(m[3])))
            self.due = [int(m[2] or 1), int(m[4] or 1)]
        elif self.last is not None:
            if line.startswith("+++ "):
                self.last.new_path = clean_path(line[4:], self.git)
            elif line.startswith("Binary files ") or line == "GIT binary patch":
                self.last.binary = True
            elif line.startswith("rename from "):
                self.last.old_path = line[12:].strip()
            elif line.startswith("rename to "):
                self.last.new_path = line[10:].strip()


def parse(text: str) -> list[Patch]:
    reader = _Reader()
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if max(reader.due) > 0:
            reader.inside(line)
        else:
            reader.outside(line)
    if text.strip() and not reader.patches:
        raise UsageError("no unified diff: nothing in it names a file")
    return reader.patches


def split_lines(text: str) -> list[str]:
    rows = text.split("\n")
    return rows[:-1] if rows[-1] == "" else rows


def reversed_lines(hunks: list[Hunk], rows: list[str], label: str) -> list[str]:
    """The old lines. Every new line of a hunk is held against the file: a stale diff is an error."""
    out, done = [], 0
    for h in hunks:
        at = h.new_start - bool(h.new_lines)
        end = at + len(h.new_lines)
        if not done <= at <= len(rows):
            raise UsageError(f"stale diff: {label} has no line {h.new_start} for a hunk")
        if [x.rstrip("\r") for x in rows[at:end]] != [x.rstrip("\r") for x in h.new_lines]:
            raise UsageError(f"stale diff: {label} reads otherwise from line {at + 1} on")
        out += rows[done:at] + h.old_lines
        done = end
    return out + rows[done:]


def old_text(patch: Patch, new: str, label: str | None = None) -> str:
    """The text before the change; empty if the change made the file."""
    if patch.old_path is None:
        return ""
    rows = reversed_lines(patch.hunks, split_lines(new), label or patch.new_path or "")
    return "".join(f"{x}\n" for x in rows)


# --- As DataFrames ------------------------------------------------------------------


def _rows(text: str) -> list[dict]:
    return [
        {"patch_ord": k, "old_path": p.old_path, "new_path": p.new_path, "binary": p.binary, "hunks": [vars(h) for h in p.hunks]}
        for k, p in enumerate(parse(text))
    ]


def patches(spark: SparkSession, text: str) -> DataFrame:
    """``PATCHES`` rows of one diff."""
    return spark.createDataFrame(_rows(text), PATCHES)


def parse_column(diffs: DataFrame, text_col: str = "diff") -> DataFrame:
    """``PATCHES`` rows of a table of diffs."""
    hunk = pa.struct([("old_start", pa.int32()), ("new_start", pa.int32()), ("old_lines", pa.list_(pa.string())), ("new_lines", pa.list_(pa.string()))])
    schema = pa.schema([("patch_ord", pa.int32()), ("old_path", pa.string()), ("new_path", pa.string()), ("binary", pa.bool_()), ("hunks", pa.list_(hunk))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                if text and (rows := _rows(text)):
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return diffs.select(text_col).mapInArrow(run, PATCHES)


def reverse_column(rows: DataFrame) -> DataFrame:
    """(new_path, old_text) of rows of ``PATCHES`` with a column ``new_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            olds = [old_text(Patch(r["old_path"], r["new_path"], [Hunk(**h) for h in r["hunks"]]), r["new_text"]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(olds, pa.string())], names=["new_path", "old_text"])

    return rows.select("old_path", "new_path", "hunks", "new_text").mapInArrow(run, "new_path string, old_text string")
