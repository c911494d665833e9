from __future__ import annotations

import pytest

from scholia.operators import rules as R
from scholia.plans.gate import check
from scholia.plans.queries import inline_files
from scholia.sources.config import Config
from scholia.sources.extract import parsed

#: path, source, findings at warn or error, hints that must be there.
CASES = [
    ("restate.py", "# increase the counter\ncounter += 1\n# keep it low because memory is tight\ncounter = min(counter, 9)\n", [("UC001", 1)], []),
    ("why.js", "// avoid a second call to load because it blocks\nload();\n", [], []),
    ("steps.py", "def f():\n    # 1. open the door\n    a()\n    # 2) walk in\n    b()\n\n# 1. outside a function\nx = 1\n", [("UC002", 2), ("UC002", 4)], []),
    ("product.js", "// Let's Encrypt issues the certificates here\nconst a = 1;\n// let's iterate over them\nconst b = 2;\n", [("UC002", 3)], []),
    ("doc.go", "package p\n\n// Now returns the time of the clock.\nfunc Now() {}\n", [], []),
    ("edit.c", "// Removed from the list on close\nint a;\n// Simplified for clarity\nint b;\n// the old implementation was slow\nint c;\n// Fixed-point scale\nint d;\n", [("UC003", 3), ("UC003", 5)], []),
    ("dead.java", "class A {\n  // int a = 1;\n  // call(a);\n  int b;\n  // return a\n  int c;\n}\n", [("UC005", 2), ("UC005", 5)], []),
    ("wrapped.py", "# the parser reads until\n# return (or the end of\n# the input) is seen\nx = 1\n", [], []),
    ("table.c", "// +-------+-----+\n// | a     | b   |\n// +-------+-----+\nint a;\n", [], []),
    ("license.c", "// Copyright 2026 someone, now we grant a license\n// ----------------------------------------------\nint a;\n", [], []),
    ("label.cs", "class A {\n  // private methods\n  int B;\n  // End of region for drawing.\n  int C;\n}\n", [("UC010", 2), ("UC010", 4)], []),
    ("long.rs", "let a = 1; // a very long trailing remark about a value that is only one, and its unit\n", [("UC009", 1)], []),
    ("todo.ts", "// TODO: later\nlet a = 1;\n// TODO(ann): with an owner\nlet b = 2;\n// FIXME ABC-12 tracked\nlet c = 3;\n", [], [("UC011", 1)]),
    ("star.swift", "// Ready ⭐ set\nlet a = 1\n// naïve café → fine\nlet b = 2\n", [("UC012", 1)], []),
    ("enum.swift", "enum E {\n    /// The open state\n    case openState\n}\n", [], []),
    ("tags.ts", "/**\n * Adds a row.\n * @param row the row\n */\nexport function addRow(row) {}\n", [], []),
    ("essay.py", "def f():\n" + "".join(f"    # the {w} part matters here\n" for w in "abcdefg") + "    return 1\n", [("UC006", 1)], [("UC008", 2)]),
    ("passive.kt", "// The value is cached by callers of this\nval a = 1\n// utilize it in order to read\nval b = 2\n", [], [("STE02", 1), ("STE03", 3)]),
    ("marker.py", "# scholia-ignore[UC010]: kept\n# imports\nimport os\n# imports\nx = 1\n", [("UC010", 4)], []),
    ("bare.py", "# scholia-ignore: quoted\n# imports\nimport os\n", [], []),
    ("wide.py", "# scholia-ignore-file[UC010, UC003]: style\nimport os\n# imports\nx = 1\n# Changed as requested\ny = 2\n", [], []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = check(inline_files(spark, {p: s for p, s, _, _ in CASES})).collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r.path, []).append(r)
    return out


@pytest.mark.parametrize(("path", "exact", "hints"), [(p, e, h) for p, _, e, h in CASES])
def test_findings(found, path, exact, hints):
    own = found.get(path, [])
    assert sorted((r.rule, r.line) for r in own if r.severity > 0) == sorted(exact)
    assert set(hints) <= {(r.rule, r.line) for r in own if r.severity == 0}


def test_messages(found):
    by = {(r.path, r.rule): r for rows in found.values() for r in rows}
    assert by["restate.py", "UC001"].message == "comment repeats the adjacent code (100% of its words appear in the code)"
    assert by["essay.py", "UC006"].message == "function 'f' has 7 comment lines in a 1-line body (700%)"
    assert by["essay.py", "UC008"].message == "7-line essay inside function 'f'"
    assert by["star.swift", "UC012"].message == "comment contains emoji/decorative symbols: ⭐"
    assert by["passive.kt", "STE03"].message == "non-simple wording: 'in order to' → to, 'utilize' → use"
    assert by["passive.kt", "STE02"].message == "passive voice ('is cached')"
    assert by["todo.ts", "UC011"].message == "TODO has no owner or ticket"
    assert [r.message for r in found["dead.java"] if r.rule == "UC005"] == [f"commented-out code ({k} of {k} lines look like code)" for k in (2, 1)]


def test_order_is_by_file_line_and_rule(found):
    rows = found["essay.py"]
    assert [(r.line, r.rule) for r in rows] == sorted((r.line, r.rule) for r in rows)


def test_settings(spark):
    files = inline_files(spark, {"a.py": "# imports\nimport os\n# TODO: x\na = 1\n# ok: MY-LINT off\nb = 2\n# é\nc = 3\n"})
    cfg = Config(disable=["UC01"], severity={"UC011": "error"})
    assert [(r.rule, r.severity) for r in check(files, cfg).collect()] == []
    cfg = Config(disable=["UC010"], severity={"UC011": "error"}, ascii_comments=True, directive_patterns=["MY-LINT"])
    assert [(r.rule, r.severity) for r in check(files, cfg).collect()] == [("UC011", 2), ("UC012", 1)]


def test_hint_cap_keeps_warnings(spark):
    source = "".join(f"# TODO: part {k}\nx{k} = {k}\n" for k in range(11)) + "# imports\nimport os\n"
    rows = check(inline_files(spark, {"a.py": source})).collect()
    todo = [r for r in rows if r.rule == "UC011"]
    assert len(todo) == 9 and [r.line for r in todo] == [1, 3, 5, 7, 9, 11, 13, 15, 15]
    assert todo[-1].message == "3 more UC011 hint(s) in this file, not listed"
    assert any(r.rule == "UC010" for r in rows)


def test_code_lines_on_demand(spark):
    files = inline_files(spark, {"a.py": "x = 1  # one\n# two\n", "b.txt": "no"})
    assert "code_lines" not in parsed(files).columns
    assert [(r.path, r.code_lines) for r in parsed(files, code=True).collect()] == [("a.py", ["x = 1       ", "     ", ""])]


def test_no_rules_and_no_rows(spark):
    files = inline_files(spark, {"a.py": "# imports\nimport os\n"})
    assert check(files, Config(disable=["UC", "STE"])).count() == 0
    assert check(files.limit(0)).count() == 0
    view = R.comment_view(spark.createDataFrame([(None, None), (1, "")], "id int, text string"), "id", "text")
    assert R.evaluate(view).count() == 0
