from __future__ import annotations

import pytest

from scholia.sources.extract import extract, fingerprint, plain, plain_docstring
from scholia.sources.languages import LANGUAGES, language_of, suffix_of


def comments(lang, source):
    return extract(source, LANGUAGES[lang])["comments"]


def functions(lang, source):
    return [(f["name"], f["start_line"], f["end_line"]) for f in extract(source, LANGUAGES[lang])["functions"]]


def test_routing():
    assert language_of("a/b.PY").name == "python" and language_of("x.d.ts").name == "typescript"
    assert language_of("a.txt") is None and language_of("py") is None and language_of(".py") is None
    assert suffix_of("a/b.tar.gz") == ".gz" and suffix_of("a.b/c") == ""


def test_grouping():
    rows = comments("c", "int a;\n// one\n// two\n  // three\nint b; // four\n// five\n")
    assert [(r["content"], r["attachment"]) for r in rows] == [("one\ntwo", "floating"), ("three", "preceding"), ("four", "trailing"), ("five", "floating")]
    rows = comments("rust", "//! a\n/// b\n// c\n// d\nfn f() {}\n")
    assert [(r["kind"], r["content"]) for r in rows] == [("doc", "a"), ("doc", "b"), ("line", "c\nd")]
    rows = comments("python", "# noqa\n# prose\n# scholia-ignore[UC001]: x\n# more\nx = 1\n")
    assert [r["content"] for r in rows] == ["noqa", "prose", "scholia-ignore[UC001]: x", "more"] and rows[0]["is_directive"]


def test_headers():
    rows = comments("c", "// tool\n#include <a.h>\n// next\nint x;\n")
    assert [r["attachment"] for r in rows] == ["file_header", "preceding"]
    assert comments("c", "// only\n")[0]["attachment"] == "file_header"
    assert comments("c", "// about x\nint x;\n")[0]["attachment"] == "preceding"


def test_rows_and_columns_count_bytes_and_newlines():
    r = comments("javascript", 'const s = "é\u2028";\n\x0clet b = 1; // note\r\n')[0]
    assert (r["start_line"], r["col"], r["attached_code"], r["text"]) == (2, 12, "let b = 1;", "// note")
    r = comments("c", "\ufeff/* Copyright */\nint x;\n")[0]
    assert (r["start_line"], r["col"], r["attachment"]) == (1, 0, "preceding")
    r = comments("python", "x = 'é'  # café\n")[0]
    assert r["col"] == 10 and r["content"] == "café"


@pytest.mark.parametrize(
    ("lang", "source", "found"),
    [
        ("c", 'char *s = "// no"; char c = \'"\'; // yes\n', ["yes"]),
        ("c", "int n = 1'000'000; // yes\n", ["yes"]),
        ("c", "// a \\\n b\nint x;\n", ["a \\\nb"]),
        ("cpp", 'auto s = R"x(// no )" )x"; // yes\n', ["yes"]),
        ("javascript", "const a = b / c / d; // yes\nconst r = /[/]\\/\\/ no/g; // also\n", ["yes", "also"]),
        ("javascript", "const t = `a ${f(`// ${x}`)} // no`; // yes\n", ["yes"]),
        ("tsx", "const a = <p>it's // text</p>;\n", ["text</p>;"]),
        ("rust", "let a: &'static str = r#\"// \"no\"#; let c = '\"'; // yes\n", ["yes"]),
        ("rust", "/* a /* b */ c */ fn f() {}\n", ["a /* b */ c"]),
        ("go", "s := `// no\n// no`\n// yes\n", ["yes"]),
        ("java", 'String s = """\n// no\n""";\n// yes\n', ["yes"]),
        ("csharp", 'var s = @"c:\\"; var t = $@"{a}"; // yes\n', ["yes"]),
        ("kotlin", 'val s = "${f("//")} //"; // yes\n/* a /* b */ */\n', ["yes", "a /* b */"]),
        ("swift", 'let s = #"// no"#; let t = "\\(f("//"))" // yes\n', ["yes"]),
        ("python", "s = '''# no\n'''\nf\"# no\"  # yes\n", ["yes"]),
        ("python", "x = r'\\'  # no'\n# yes\n", ["yes"]),
    ],
)
def test_strings_hide_comments(lang, source, found):
    assert [r["content"] for r in comments(lang, source)] == found


@pytest.mark.parametrize(
    ("lang", "source", "found"),
    [
        ("c", "static struct s *get(void)\n{\n  switch (x) { case 1: { } }\n}\nint a[] = { 1 };\nFOO(x) { }\n", [("get", 1, 4)]),
        ("cpp", "#define A 1\ntemplate <class T> T f(T a) { return a; }\nFoo::Foo(int a) : x(a), y{b} { }\nnamespace n { void g() const { if (x) { } } }\n", [("f", 2, 2), ("Foo", 3, 3), ("g", 4, 4)]),
        ("java", "class A {\n  @Test(expected = X.class) public void foo() {\n  }\n  A(int x) { }\n  void g() { for (;;) { } }\n}\n", [("foo", 2, 3), ("A", 4, 4), ("g", 5, 5)]),
        ("csharp", "class A {\n  int F(int x) => x + 1;\n  int P { get { return 1; } }\n  A(int y) : base(y) { }\n}\n", [("F", 2, 2), ("A", 4, 4)]),
        ("javascript", "class A { get x() { return 1; } async m(a) { } }\nconst f = async (a) => { b(); };\nif (a) { }\n", [("x", 1, 1), ("m", 1, 1), ("<anonymous>", 2, 2)]),
        ("typescript", "type F = (x: number) => void;\nclass A { m(x: number): Promise<void> { } }\n", [("m", 2, 2)]),
        ("rust", "impl A { pub async fn go<T: X>(&self) -> R { xs.map(|x| x + 1) } fn decl(&self); }\n", [("go", 1, 1), ("<anonymous>", 1, 1)]),
        ("go", "func (t *T) M(a int) (b int, err error) {\n  go func() { x() }()\n}\ntype I interface { M() }\nvar f func() time.Time\n", [("M", 1, 3), ("<anonymous>", 2, 2)]),
        ("kotlin", "fun one() = x + 1\nfun <T> T.ext() {\n  if (a) { }\n}\n", [("one", 1, 1), ("ext", 2, 4)]),
        ("swift", "class A { init(x: Int) { }\n func f<T>(a: T) -> T where T: B { guard a else { } }\n var p: Int { return 1 } }\nprotocol P { func q() }\n", [("init", 1, 1), ("f", 2, 2)]),
        ("python", "@dec\nasync def f(a,\n    b):\n    x = lambda q: q\n\n    def g(): return 1\n    # tail\n# out\n", [("f", 2, 7), ("<anonymous>", 4, 4), ("g", 6, 6)]),
    ],
)
def test_function_spans(lang, source, found):
    assert functions(lang, source) == found


def test_enclosing_functions():
    rows = comments("python", "class A:\n    def f(self):\n        '''Doc.'''\n        # in\n        def g():\n            # deep\n            pass\n# out\n")
    assert [(r["content"], r["in_function"], r["function_name"]) for r in rows] == [("Doc.", False, ""), ("in", True, "f"), ("deep", True, "g"), ("out", False, "")]


def test_docstrings():
    rows = comments("python", '"""Module."""\n\nclass A:\n    r"""Class\n\n    more"""\n    x = 1\n    "no"\n')
    assert [(r["content"], r["kind"], r["attachment"], r["attached_code"]) for r in rows] == [("Module.", "doc", "file_header", ""), ("Class\n\nmore", "doc", "preceding", "class A:")]
    assert extract('def f():\n    """Doc.\n\n    More.\n    """\n    return 1\n', LANGUAGES["python"])["code_line_count"] == 2


def test_go_docs_and_cgo():
    rows = comments("go", '// Package p.\npackage p\n\n// #include <a.h>\nimport "C"\n\n// F does.\nfunc F() {\n\t// in\n}\n')
    assert [(r["kind"], r["is_directive"]) for r in rows] == [("doc", False), ("line", True), ("doc", False), ("line", False)]


def test_block_directives_hold_nothing_else():
    rows = comments("javascript", "/* global foo */\n\n// global foo\n\n/* eslint-disable\n * prose */\nx;\n")
    assert [r["is_directive"] for r in rows] == [True, False, False]


def test_markers_and_quotes():
    assert plain("/* one\n * two\n */") == "one\ntwo" and plain("//! a") == "a" and plain("/** d */") == "d"
    assert plain("##### x", "#") == "#### x" and plain("#!/bin/sh", "#") == "!/bin/sh"
    assert plain_docstring("r'''a\n  b'''") == "a\nb"


def test_empty_and_long_files():
    for name in LANGUAGES:
        out = extract("", LANGUAGES[name])
        assert out["comments"] == [] and out["functions"] == [] and out["code_line_count"] == 0
        body = "x = 1\n" if name == "python" else "f(a);\n"
        assert extract(body * 4000, LANGUAGES[name])["code_line_count"] == 4000


def test_unclosed_code_does_not_fail():
    for name in LANGUAGES:
        for source in ("/* open", '"open', "f(a {", "}} ) ]", "'", "`${", '"""', "//", "#", "def f(", "fun f() {", "\\(", "=> {", "a => "):
            extract(source, LANGUAGES[name])


def test_fingerprint_ignores_comments_and_blanks():
    c = LANGUAGES["c"]
    assert fingerprint("int a; // x\n\n/* y */ int b;\n", c) == fingerprint("int a;\n        int b; // z\n", c)
    assert fingerprint("int a;\n", c) != fingerprint("int b;\n", c)
