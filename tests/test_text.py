from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import text as T


def run(spark, f, values):
    rows = spark.createDataFrame([(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(values)])
    columns = [F.col(c) for c in rows.columns[1:]]
    return [r[0] for r in rows.orderBy("_1").select(f(*columns)).collect()]


def test_stems(spark):
    words = ["loops", "Incrementing", "running", "calling", "passes", "parties", "carried", "frobnicates", "frobnicate", "bus", "is", "red", "buzzed", "the", "ices"]
    assert run(spark, T.stem, words) == ["loop", "increment", "run", "call", "pass", "party", "carry", "frobnicat", "frobnicat", "bus", "is", "red", "buzz", "the", "ice"]


def test_lines_are_pythons(spark):
    texts = ["", "a", "a\n", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i", "a\n\n", " \n b"]
    assert run(spark, T.lines, texts) == [t.splitlines() for t in texts]


def test_words_and_stripping_are_pythons(spark):
    texts = ["", "  ", "a b", "\x1ca\x1fb ", "a\u00a0b\u2003c\n", "\ta\nb\t", "é \u3000 x"]
    assert run(spark, T.word_count, texts) == [len(t.split()) for t in texts]
    assert run(spark, T.strip, texts) == [t.strip() for t in texts]
    assert run(spark, T.rstrip, texts) == [t.rstrip() for t in texts]
    assert run(spark, T.normalised, texts) == [" ".join(t.split()).lower() for t in texts]


def test_first_line(spark):
    assert run(spark, T.first_line, ["", "a\nb", "x" * 72, "y" * 73]) == ["", "a", "x" * 72, "y" * 71 + "…"]


def test_names_and_code(spark):
    assert run(spark, T.split_identifier, ["user_name", "getUserName", "HTTPServer2", "A"]) == [["user", "name"], ["get", "user", "name"], ["http", "server"], ["a"]]
    words = run(spark, lambda x: F.sort_array(T.code_words(x)), ["i++", "a->b != c", ""])
    assert words == [["i", "increment"], ["a", "abov", "b", "c", "compar", "differ", "equal", "greater", "minu", "not", "subtract"], []]


def test_overlap(spark):
    pairs = [("increment the counter", "counter++;"), ("the", "x"), ("one two three", "one"), ("calls calls miss", "call()")]
    assert run(spark, T.overlap_ratio, pairs) == [1.0, 0.0, 1 / 3, 2 / 3]


def test_percent_is_half_to_even(spark):
    values = [0.625, 0.375, 0.5, 1.0, 2 / 3, 0.0]
    assert run(spark, T.percent, values) == [f"{v:.0%}" for v in values]


def test_code_lines(spark):
    code = ["x = compute()", "return result", "if (a) {", "foo();", "import os", "@decorator", "p->next", "break", "for x in y:", "#include <a.h>", "a.b(c)(d)"]
    prose = ["lo = first index that might match;", "{current rate, selected rate}", "state=TIMEOUT(3)", "LRCLK = BCK+1 in both of them.", "if already valid, pass; otherwise stop", "events -> keys", "Cyrillic (basic + more)", "", "import the settings from the file"]
    assert run(spark, T.looks_like_code, code) == [True] * len(code)
    assert run(spark, T.looks_like_code, prose) == [False] * len(prose)
    assert run(spark, T.surely_code, ["total = a", "total = a(b)"]) == [False, True]
    assert run(spark, T.looks_like_code, ["total = a"]) == [True]


def test_banners_and_diagrams(spark):
    assert run(spark, T.banner_line, ["==========", "---- init ----", "-------", "== a b c d ==========", "── Section ──────", "a/b/c/d/e/f/g/h/i", "https://a-b-c.d/e-f-g"]) == [True, True, False, False, True, False, False]
    rows = [["+------+"], ["| a | b |"], ["┌──┐"], ["====="], ["a | b"]]
    assert run(spark, T.diagram, rows) == [True, True, True, False, False]


def test_sentences(spark):
    text = "One two. Three; four - five.\n- item one\n  goes on\n@param x the y\n\nLast"
    assert run(spark, T.sentences, [text]) == [["One two.", "Three;", "four", "five.", "- item one goes on", "@param x the y", "Last"]]
    assert run(spark, T.flowing_sentences, ["A b. C d! E\n- f. g. h."]) == [["A b.", "C d!", "E"]]


def test_ascii(spark):
    assert run(spark, T.to_ascii, ["a → b…", "“é”\u00a0—"]) == ["a -> b...", '"?" --']


def test_terms(spark):
    f = lambda x: T.without_terms(x, ["Let's Encrypt", "c++", "leverage"])
    assert run(spark, f, ["Let's Encrypt it", "let's encrypt it", "Leverage C++ now", "leveraged"]) == [" it", "let's encrypt it", "  now", "leveraged"]
