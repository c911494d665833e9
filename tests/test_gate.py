from __future__ import annotations

import subprocess

import pytest

from scholia.plans import runs
from scholia.plans.gate import gate
from scholia.plans.queries import inline_files
from scholia.sources.config import Config, UsageError

OLD = "// Debounce keeps the request count low.\nexport function debounce(fn, delay = 250) {\n  let timer = null;\n  return () => fn();\n}\n"
NEW = OLD.replace("  let", "  // Changed the timer handling as requested\n  let").replace("  return", "  // Then we return the wrapped callback\n  return")


def run(spark, old, new, tree=None, cfg=None):
    olds = spark.createDataFrame([(k, bytearray(old[p].encode())) for k, p in enumerate(new) if p in old], "file_ord int, content binary")
    got = gate(inline_files(spark, new), olds, (lambda: inline_files(spark, tree)) if tree else None, cfg)
    return [(r.path, r.rule, r.line) for r in got.findings.collect() if r.severity], got.stats.first().asDict()


def test_only_new_comments_count(spark):
    found, stats = run(spark, {"a.js": OLD, "same.js": NEW, "move.js": "// Keeps latency low.\nconst a = 1;\n"}, {"a.js": NEW, "same.js": NEW, "move.js": "const a = 1;\n// Keeps latency low.\nconst b = 2;\n"})
    assert found == [("a.js", "UC003", 3), ("a.js", "UC002", 5)]
    assert stats == {"files_scanned": 3, "new_comments": 2, "new_comment_lines": 2, "added_code_lines": 1}


def test_equal_comments_are_a_multiset(spark):
    one = "# kept for the reader\nx = 1\n"
    _, stats = run(spark, {"a.py": one}, {"a.py": one * 3})
    assert stats["new_comments"] == 2


def test_signals_honour_rule_lists(spark):
    noise = "".join(f"// then we run filler step number {k} of the plan\n" for k in range(14))
    body = "export function f() {\n  return 1;\n}\n"
    new = {"a.js": noise + body, "b.js": noise + body + "// scholia-ignore[UC100]: generated steps\n"}
    found, stats = run(spark, dict.fromkeys(new, body), new, cfg=Config(disable=["UC100"]))
    assert [x for x in found if x[1] == "UC100"] == [("a.js", "UC100", 1)]
    assert stats["added_code_lines"] == 0


def test_hints_are_capped_before_the_gate_looks(spark):
    old = "".join(f"# TODO: part {k}\nx{k} = {k}\n" for k in range(9))
    olds = spark.createDataFrame([(0, bytearray(old.encode()))], "file_ord int, content binary")
    got = gate(inline_files(spark, {"a.py": old + "# TODO: last part of all\ny = 1\n"}), olds)
    assert [r.rule for r in got.findings.collect()] == []


def git(cwd, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=cwd, check=True, capture_output=True)


@pytest.fixture
def repository(tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    git(tmp_path, "init", "-q")
    (tmp_path / "src/a.js").write_text(OLD)
    (tmp_path / "src/moved.py").write_text("# The retry budget is shared between endpoints.\nx = 1\n")
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-q", "-m", "base")
    (tmp_path / "src/a.js").write_text(NEW)
    (tmp_path / "src/moved.py").unlink()
    (tmp_path / "src/ünïcode.py").write_text("# The retry budget is shared between endpoints.\nx = 1\n")
    monkeypatch.chdir(tmp_path)
    return tmp_path


def test_git_baselines(spark, repository):
    for got in (runs.gate_paths(spark, ["src"], "git:HEAD", Config()), runs.gate_changes(spark, "git:HEAD", Config())):
        rows = [(r.path, r.rule) for r in got.findings.collect() if r.severity]
        assert rows == [("src/a.js", "UC003"), ("src/a.js", "UC002")]
        assert got.stats["new_comments"] == 2 and got.stats["files_scanned"] == 2
    with pytest.raises(UsageError, match="not found"):
        runs.gate_paths(spark, ["src"], "git:nowhere", Config())
    with pytest.raises(UsageError, match="needs a git"):
        runs.gate_changes(spark, "src", Config())


def test_diff_baselines_and_verify(spark, repository):
    text = subprocess.run(["git", "diff"], capture_output=True, text=True, check=True).stdout
    got = runs.gate_diff(spark, text, Config())
    assert [(r.path, r.rule) for r in got.findings.collect() if r.severity] == [("src/a.js", "UC003"), ("src/a.js", "UC002")]
    assert runs.verify(spark, text) == [("src/moved.py", "the file is gone")]
    (repository / "src/a.js").write_text(NEW.replace("null", "0"))
    with pytest.raises(UsageError, match="stale diff"):
        runs.gate_diff(spark, text, Config())
    text = subprocess.run(["git", "diff", "src/a.js"], capture_output=True, text=True, check=True).stdout
    assert runs.verify(spark, text) == [("src/a.js", "code differs at 'let timer = 0;'")]


def test_path_baselines(spark, tmp_path):
    for name, text in (("old/a.js", OLD), ("new/a.js", NEW), ("new/b.js", "// Debounce keeps the request count lower.\nlet b = 1;\n"), ("old/c.js", "// Debounce keeps the request count lower.\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = runs.gate_paths(spark, [str(tmp_path / "new")], str(tmp_path / "old"), Config())
    assert got.stats["new_comments"] == 2 and got.stats["baseline"].endswith("old")
    one = runs.gate_paths(spark, [str(tmp_path / "new/a.js")], str(tmp_path / "old/a.js"), Config())
    assert one.stats["files_scanned"] == 1 and one.stats["new_comments"] == 2
    with pytest.raises(UsageError):
        runs.gate_paths(spark, [str(tmp_path / "new")], str(tmp_path / "absent"), Config())
