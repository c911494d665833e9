from __future__ import annotations

import difflib
import random

import pytest

from scholia.sources import diffs
from scholia.sources.config import UsageError


def made(old, new, n=3):
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), "a/x.py", "b/x.py", n=n))


@pytest.mark.parametrize("context", [0, 1, 3])
def test_round_trips(context):
    rng = random.Random(context)
    for _ in range(200):
        old = [rng.choice("abcd") + "\n" for _ in range(rng.randint(1, 12))]
        new = [x for x in old if rng.random() > 0.3] + [rng.choice("xyz") + "\n" for _ in range(rng.randint(0, 3))]
        rng.shuffle(new) if rng.random() < 0.2 else None
        text = made("".join(old), "".join(new), context)
        if text:
            (patch,) = diffs.parse(text)
            assert (patch.old_path, patch.new_path) == ("x.py", "x.py")
            assert diffs.old_text(patch, "".join(new)) == "".join(old)


def test_git_sections():
    text = (
        "commit 1\ndiff --git a/a b/b\nsimilarity index 90%\nrename from a\nrename to b\n--- a/a\n+++ b/b\n@@ -1 +1 @@\n-x\n+y\n\\ No newline at end of file\n"
        'diff --git "a/\\303\\251.py" "b/\\303\\251.py"\ndeleted file mode 100644\n--- "a/\\303\\251.py"\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n'
        "--- c.txt\t2024-01-01\n+++ c.txt\t2024-01-02\n@@ -1,2 +1,2 @@\n-a\n+b\n\ndiff --git i/p.png w/p.png\nBinary files i/p.png and w/p.png differ\n"
    )
    rows = diffs.parse(text)
    assert [(p.old_path, p.new_path, p.binary, len(p.hunks)) for p in rows] == [("a", "b", False, 1), ("é.py", None, False, 1), ("c.txt", "c.txt", False, 1), ("p.png", "p.png", True, 0)]
    assert rows[2].hunks[0].new_lines == ["b", ""]


def test_carriage_returns_do_not_count():
    (patch,) = diffs.parse(made("a\nb\n", "a\nc\n").replace("\n", "\r\n"))
    assert diffs.old_text(patch, "a\r\nc\r\n") == "a\r\nb\n" or diffs.old_text(patch, "a\r\nc\r\n") == "a\nb\n"


def test_bad_diffs():
    assert diffs.parse("") == [] and diffs.parse(" \n") == []
    for text in ("hello", "@@ -1 +1 @@\n-a\n+b\n", "--- a\n+++ b\n@@ -1 +1 @@\n*a\n"):
        with pytest.raises(UsageError):
            diffs.parse(text)
    (patch,) = diffs.parse(made("a\n", "b\n"))
    with pytest.raises(UsageError, match="reads otherwise"):
        diffs.old_text(patch, "c\n")
    with pytest.raises(UsageError, match="has no line"):
        diffs.old_text(diffs.parse(made("a\n" * 9, "a\n" * 8 + "b\n", 0))[0], "a\n")


def test_new_files_have_no_old_text():
    assert diffs.old_text(diffs.Patch(None, "x", []), "a\n") == ""
    assert diffs.split_lines("a\n\x0cb c\n") == ["a", "\x0cb c"]
